"""A perturbation experiment drawn from the star schema, for queries and benchmarks.

Cells are customers, genes are brands, counts are quantities; the side (0
measured, 1 predicted) is the parity of the order, the perturbation the nation
(0 is the control).  An additive effect, different by side, makes genes respond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import cells as packing
from effectlens.sources import staging
from effectlens.sources.store import listing

GENES = 25
TABLES = ("lineitem", "orders", "part", "customer")
#: Gene axes: number of genes, and the gene of a part.  ``brand`` is narrow; ``part`` is wide enough for every top-k.
AXES = {"brand": (GENES, "cast(regexp_extract(p_brand, '[0-9]+', 0) as int)"), "part": (1000, "cast(p_partkey % 1000 + 1 as int)")}
#: Bytes of tables for which a join gets one more task, and values of cells that a task spells out over all genes at one time.
SHARE, SPELLED = 8_000_000, 100_000
CELL = ["side", "pert", "cell"]


def shares(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of a join: a number that grows with the tables, so that none sorts more in larger ones."""
    return max(8, -(-(listing(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])["bytes"] or 0) // SHARE))


def _spelled(rows: pa.Table, n: int, packed: bool = False) -> Iterator[pa.RecordBatch]:
    """side, pert, cell, gene, x, lib of whole cells, given as sorted rows (side, pert, cell, gene, q): sums of genes, with the effect; ``packed`` a row a cell."""
    side, pert, cell = (rows.column(c).fill_null(-1).to_numpy() for c in CELL)
    new = np.r_[True, (side[1:] != side[:-1]) | (pert[1:] != pert[:-1]) | (cell[1:] != cell[:-1])]
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    gene = rows.column("gene").fill_null(0).to_numpy().astype(np.int64)
    known = (~rows.column("gene").is_null().to_numpy()) & (gene >= 1) & (gene <= n)
    q, some = rows.column("q").fill_null(0.0).to_numpy(), rows.column("q").is_valid().to_numpy()
    named_by = [rows.column(c).combine_chunks() for c in CELL]
    step = max(1, SPELLED // n)
    for lo in range(0, len(first), step):
        at = first[lo : lo + step]
        end = first[lo + step] if lo + step < len(first) else len(of)
        mine = slice(at[0], end)
        m, inside = len(at), known[mine]
        local, g = of[mine] - lo, gene[mine]
        place = local[inside] * n + g[inside] - 1
        effect = ((7 * pert[at].astype(np.int64)[:, None] + np.arange(1, n + 1)) % 5 < np.where(side[at] == 0, 2, 3)[:, None]) & (pert[at] > 0)[:, None]
        effect = effect.ravel()
        x = np.bincount(place, q[mine][inside], m * n) + 40.0 * effect
        there = np.flatnonzero((np.bincount(place, minlength=m * n) > 0) | effect)
        valid = (np.bincount(place, some[mine][inside], m * n) > 0) | effect
        lib = x.reshape(m, n).sum(axis=1)
        cells, genes, sums, full = there // n, there % n + 1, x[there], valid[there]
        named = np.ones(len(there), bool)
        if not inside.all():  # genes off the axis have no effect, nor has a part without one
            null = rows.column("gene").is_null().to_numpy()[mine][~inside]
            keys, back = np.unique(np.c_[local[~inside], g[~inside], null], axis=0, return_inverse=True)
            back = back.ravel()
            other = np.bincount(back, q[mine][~inside], len(keys))
            lib += np.bincount(keys[:, 0], other, m)
            cells, genes, sums, named = np.r_[cells, keys[:, 0]], np.r_[genes, keys[:, 1]], np.r_[sums, other], np.r_[named, keys[:, 2] == 0]
            full = np.r_[full, np.bincount(back, some[mine][~inside], len(keys)) > 0]
        if packed:
            if not inside.all():
                order = np.argsort(cells, kind="stable")
                cells, genes, sums, named, full = (a[order] for a in (cells, genes, sums, named, full))
            own = np.unique(cells)  # a cell without a gene is none
            cuts = np.r_[np.searchsorted(cells, own), len(cells)]
            genes, sums = np.where(named, genes, packing.NO_GENE).astype(np.int32), np.where(full, sums, packing.UNKNOWN)
            cols = [c.take(pa.array(at[own])) for c in named_by]
            yield pa.record_batch([*cols, pa.array(lib[own]), pa.array(np.bincount(cells, full)[own] > 0), *packing.packed(cuts, genes, sums)], [*CELL, "lib", "known", "genes", "xs"])
            continue
        from_ = pa.array(at[cells])
        cols = [c.take(from_) for c in named_by]
        yield pa.record_batch([*cols, pa.array(genes.astype(np.int32), mask=~named), pa.array(sums, mask=~full), pa.array(lib[cells])], [*CELL, "gene", "x", "lib"])


def _cells(n: int, packed: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_spelled`` over batches of sorted rows; the last cell of a batch waits for the next one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1] for c in CELL]
            if held and [held[-1].column(c)[held[-1].num_rows - 1] for c in CELL] == last:  # one cell all along
                held.append(batch)
                continue
            same = np.ones(batch.num_rows, bool)
            for c, value in zip(CELL, last, strict=True):
                column = batch.column(c)
                same &= (column.is_null() if not value.is_valid else pc.fill_null(pc.equal(column, value), False)).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(same))
            yield from _spelled(pa.Table.from_batches([*held, batch.slice(0, cut)]), n, packed) if held or cut else ()
            held = [batch.slice(cut)]
        if held:
            yield from _spelled(pa.Table.from_batches(held), n, packed)

    return run


def _rows(spark: SparkSession, sf_dir: str, axis: str) -> DataFrame:
    """side, pert, cell, gene, q of every line, those of a cell together and in order."""
    staging.ship(spark)
    gene = AXES[axis][1]
    parts = shares(spark, sf_dir)
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    met = lambda a, x, b, y: a.repartition(parts, x).join(b.repartition(parts, y), F.col(x) == F.col(y))
    parted = met(read("lineitem", "l_orderkey", "l_partkey", "l_quantity"), "l_partkey", read("part", "p_partkey", F.expr(gene).alias("gene")), "p_partkey")
    ordered = met(read("orders", "o_orderkey", "o_custkey"), "o_custkey", read("customer", "c_custkey", F.col("c_nationkey").cast("int").alias("pert")), "c_custkey")
    base = met(parted.select("l_orderkey", "gene", "l_quantity"), "l_orderkey", ordered.select("o_orderkey", "o_custkey", "pert"), "o_orderkey")
    rows = base.select((F.col("o_orderkey") % 2).cast("int").alias("side"), "pert", F.col("o_custkey").cast("long").alias("cell"), "gene", F.col("l_quantity").cast("double").alias("q"))
    return rows.repartitionByRange(parts, *CELL).sortWithinPartitions(*CELL)


def counts(spark: SparkSession, sf_dir: str, axis: str = "brand", lib: bool = False) -> DataFrame:
    """side, pert, cell, gene, x: nonzero counts; with ``lib`` also the total of the cell.

    Rows of a cell meet once; its sums and its effect are made from them there,
    and leave in order of side, perturbation and cell.
    """
    out = _rows(spark, sf_dir, axis).mapInArrow(_cells(AXES[axis][0]), "side int, pert int, cell bigint, gene int, x double, lib double")
    return out if lib else out.drop("lib")


def packed(spark: SparkSession, sf_dir: str, axis: str = "brand") -> DataFrame:
    """side, pert, cell, lib, known (any count is), genes, xs: the same counts, a row a cell, as ``operators.cells`` takes them."""
    return _rows(spark, sf_dir, axis).mapInArrow(_cells(AXES[axis][0], packed=True), "side int, pert int, cell bigint, lib double, known boolean, genes binary, xs binary")


def genes(spark: SparkSession, axis: str = "brand") -> DataFrame:
    return spark.range(1, AXES[axis][0] + 1).select(F.col("id").cast("int").alias("gene"))


def own_genes(spark: SparkSession) -> DataFrame:
    """pert, gene: the gene that a perturbation targets."""
    return spark.range(1, 25).select(F.col("id").cast("int").alias("pert"), F.col("id").cast("int").alias("gene"))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, replicate: customers of one market segment are a replicate of their nation."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("replicate"))
