"""Counts kept a row a cell: side, pert, cell, lib, and its genes (32-bit integers) and counts (doubles) as bytes.

Sums of groups and rank sums are taken from whole arrays in tasks, so that no
row is made for a value.  What they give is what ``profiles`` and ``de`` give of
the same counts, a row a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.sources import staging

GROUP = ["side", "pert"]
SUMS = ["total", "s", "ls", "lss", "lx"]
#: A gene and a count that are null.
NO_GENE, UNKNOWN = -(2**31), np.array([0x7FF8_0000_0000_0A11]).view(np.float64)[0]
#: Values that a task sums, or deals, at one time, and places of values (cells times genes) for which there is one more range.
SUMMED, DEALT, SPAN = 100_000, 1_000_000, 4_000_000
#: Cells that bounds of ranges are read from.
ASKED = 2000


def packed(cuts: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Columns cut at ``cuts`` (from 0 to their length) into one value of bytes for each piece."""
    return [pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c in columns]


def _bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and where those of each row begin, and the end."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks > 1 else column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    cuts = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", kind, int(cuts[-1] - cuts[0]) // size, int(cuts[0])), (cuts - cuts[0]) // size


def unknown(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) == np.array([UNKNOWN]).view(np.int64)[0]


def unpacked(cells: DataFrame) -> DataFrame:
    """side, pert, cell, gene, x, lib: a row a value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, gene, x, of in _taken(batches, SUMMED):
            cols = [some.column(c).take(pa.array(of)) for c in (*GROUP, "cell", "lib")]
            yield pa.record_batch([*cols[:3], pa.array(gene, mask=gene == NO_GENE), pa.array(x, mask=unknown(x)), cols[3]], [*GROUP, "cell", "gene", "x", "lib"])

    kinds = dict(cells.dtypes)
    return cells.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in (*GROUP, "cell")], "gene int, x double, lib double"]))


def libraries(cells: DataFrame) -> DataFrame:
    """side, pert, cell, lib: totals of cells; null where no count is known."""
    return cells.select(*GROUP, "cell", F.when(F.col("known"), F.col("lib")).alias("lib"))


def _taken(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of about ``most`` values at a time: their rows, and of every value gene, x and whose it is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (gene, cuts), (x, _) = _bytes(batch.column("genes"), np.int32), _bytes(batch.column("xs"), np.float64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + most, "right")) - 1)
            mine = slice(cuts[lo], cuts[hi])
            yield batch.slice(lo, hi - lo), gene[mine], x[mine], np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))
            lo = hi


def _scaled(batches: Iterable[pa.RecordBatch], most: int, total: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``_taken`` without values that have no gene, and x * total / lib."""
    for some, gene, x, of in _taken(batches, most):
        if gene.min(initial=0) == NO_GENE:
            known = gene != NO_GENE
            gene, x, of = gene[known], x[known], of[known]
        if not len(gene):
            continue
        lib = some.column("lib").to_numpy()
        if not lib[of[np.flatnonzero(~unknown(x))] if not lib.all() else slice(0)].all():
            raise ZeroDivisionError("a cell with counts has a total of 0")
        yield some, gene, x, x * total / np.where(lib == 0, 1.0, lib)[of], of


def _groups(some: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    """For each row the number of its group, and the columns of groups."""
    values = [some.column(c) for c in GROUP]
    new = np.zeros(some.num_rows, bool)
    new[:1] = True
    for c in values:  # nulls are a group
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new) - 1, [c.take(pa.array(np.flatnonzero(new))) for c in values]


def sums(cells: DataFrame, total: float) -> DataFrame:
    """side, pert, gene with total, s, ls, lss, lx: the sums that ``profiles.from_sums`` takes."""

    def log1p(a: np.ndarray) -> np.ndarray:
        return np.log1p(a if a.min() > -1 else np.where(a <= -1, 0.0, a))  # as SQL has it: no logarithm, nothing to add

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, gene, x, v, of in _scaled(batches, SUMMED, total):
            group, names = _groups(some)
            first, n = int(gene.min()), int(gene.max()) - int(gene.min()) + 1
            at = group[of] * n + gene - first
            there = np.flatnonzero(np.bincount(at))
            if (null := unknown(x)).any():
                x, v = np.where(null, 0.0, x), np.where(null, 0.0, v)
            logged = log1p(v)
            added = [np.bincount(at, w)[there] for w in (x, v, logged, logged * logged, log1p(x))]
            yield pa.record_batch([*[c.take(pa.array(there // n)) for c in names], pa.array((there % n + first).astype(np.int32)), *map(pa.array, added)], [*GROUP, "gene", *SUMS])

    kinds = dict(cells.dtypes)
    part = cells.select(*GROUP, "lib", "genes", "xs").mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in GROUP], "gene int", *[f"{c} double" for c in SUMS]]))
    return part.groupBy(*GROUP, "gene").agg(*[F.sum(c).alias(c) for c in SUMS])


def _bounds(cells: DataFrame, total: float, n: int, ranges: int) -> list[float]:
    """Values that cut those of some cells into ranges; they deal the work and change no result."""
    some = cells.filter(F.pmod(F.xxhash64("cell"), F.lit(max(1, n // ASKED))) == 0)
    v = unpacked(some).filter("lib <> 0").select((F.col("x") * total / F.col("lib")).alias("v"))
    at = v.agg(F.percentile("v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]))).first()[0] if ranges > 1 else None
    return sorted(set(at or []))


def _dealt(total: float, bounds: list[float]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Values and genes of cells by range of value and group; the smallest of all values stands for an unknown one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds)
        for some, gene, x, v, of in _scaled(batches, DEALT, total):
            if (null := unknown(x)).any():
                v = np.where(null, -np.inf, v)
            group, names = _groups(some)
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])  # values of a cell are mostly alike
            held = np.diff(np.r_[first, len(v)])
            known, which = np.unique(v[first], return_inverse=True)
            which = which.ravel()
            place = np.repeat(np.searchsorted(cuts, known, "right")[which], held)
            group, t = group[of], np.ones(len(v), np.int32)
            often = np.repeat((np.bincount(which, held) > 2 * (int(gene.max()) - int(gene.min()) + 1))[which], held)
            if often.any():  # a value that very many have is counted by gene here, or one range would get them all
                code, low, n = np.repeat(which, held), int(gene.min()), int(gene.max()) - int(gene.min()) + 1
                _, one, times = np.unique((group[often] * len(known) + code[often]) * n + gene[often] - low, return_index=True, return_counts=True)
                at = np.flatnonzero(often)[one]
                t[at] = times
                kept = ~often
                kept[at] = True
                gene, v, t, place, group = gene[kept], v[kept], t[kept], place[kept], group[kept]
            key = group * (len(cuts) + 1) + place
            order = np.argsort(key.astype(np.uint16) if key.max() < 2**16 else key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lists = packed(np.r_[first, len(key)], gene[order], v[order], t[order])
            which = pa.array(key[first] // (len(cuts) + 1))
            yield pa.record_batch([pa.array((key[first] % (len(cuts) + 1)).astype(np.int32)), *[c.take(which) for c in names], *lists], ["range", *GROUP, "genes", "vs", "ts"])

    return run


def _ranked(control: object, control_side: int) -> Callable[[pa.Table], pa.Table]:
    """Of all values of a range, by gene: what each group's add to its rank sum and ties, and (control) what it has there itself."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.select(GROUP).group_by(GROUP).aggregate([])
        which = {(s, p): i + 1 for i, (s, p) in enumerate(zip(rows.column("side").to_pylist(), rows.column("pert").to_pylist(), strict=True))}
        named = [(control_side, control), *which]
        code = np.array([0 if (s, p) == (control_side, control) else which[s, p] for s, p in zip(t.column("side").to_pylist(), t.column("pert").to_pylist(), strict=True)])
        (gene, cuts), (v, _), (times, _) = _bytes(t.column("genes"), np.int32), _bytes(t.column("vs"), np.float64), _bytes(t.column("ts"), np.int32)
        group = np.repeat(code, np.diff(cuts))
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        known, place = np.unique(v[first], return_inverse=True)
        place = np.repeat(place.ravel(), np.diff(np.r_[first, len(v)]))
        low, many, values = int(gene.min()), len(named), len(known)
        key = ((gene.astype(np.int64) - low) * values + place) * many + group
        alone = times.max() == 1
        order = None if alone else np.argsort(key)
        key = np.sort(key) if alone else key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count, key = (np.diff(np.r_[first, len(key)]) if alone else np.add.reduceat(times[order].astype(np.int64), first)).astype(np.float64), key[first]
        at, group = key // many, key % many
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # one gene and value; the control comes first
        held = np.where(group[first] == 0, count[first], 0.0)
        of = at[first] // values
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        before = np.cumsum(held) - held
        before -= np.repeat(before[start], np.diff(np.r_[start, len(of)]))
        sizes = np.diff(np.r_[first, len(at)])
        eq, lt, g = np.repeat(held, sizes), np.repeat(before, sizes), np.repeat(of, sizes)
        to = g * many + group
        tgt = group > 0
        n = int(to.max()) + 1
        own = np.where(tgt, count + eq, count)
        u = np.bincount(to, np.where(tgt, count * (lt + eq / 2), 0.0), n)
        ties = np.bincount(to, own**3 - own - np.where(tgt, eq**3 - eq, 0.0), n)
        nz = np.bincount(to, count, n)
        there = np.union1d(np.flatnonzero(nz), np.unique(g) * many)  # every gene has a row of the control, which later ranges count on
        pad = lambda a: np.r_[a, np.zeros(many)][there]
        side, pert = (pa.array([x[i] for x in named], t.schema.field(c).type).take(pa.array(there % many)) for i, c in enumerate(GROUP))
        range_ = pa.array(np.full(len(there), t.column("range")[0].as_py(), np.int32))
        return pa.table([range_, side, pert, pa.array((there // many + low).astype(np.int32)), pa.array(there % many == 0), *[pa.array(pad(a)) for a in (u, nz, ties)]], ["range", *GROUP, "gene", "ctrl", "u", "nz", "ties"])

    return run


def rank_parts(cells: DataFrame, sizes: DataFrame, genes: int, total: float, control: object, control_side: int, side: int | None = None) -> tuple[DataFrame, DataFrame]:
    """side, pert, gene, u, nz, ties of targets and gene, cnz, cties of the control: what ``de.rank_sum`` ends from.

    Values are dealt by ranges, all genes of a range together; a range counts the
    control's values in it, and those of the ranges before come from their sums.
    """
    staging.ship(cells.sparkSession)
    mine = (F.col("side") == control_side) & (F.col("pert") == control) | (F.col("pert") != control) & (F.lit(True) if side is None else F.col("side") == side)
    cells = cells.filter(mine)
    n = sizes.filter(mine).agg(F.sum("n")).first()[0] or 0
    ranges = max(8, -(-n * genes // SPAN))
    kinds = dict(cells.dtypes)
    group = ", ".join(f"{c} {kinds[c]}" for c in GROUP)
    dealt = cells.select(*GROUP, "lib", "genes", "xs").mapInArrow(_dealt(total, _bounds(cells, total, n, ranges)), f"range int, {group}, genes binary, vs binary, ts binary")
    parts = dealt.repartition(ranges, "range").groupBy("range").applyInArrow(_ranked(control, control_side), f"range int, {group}, gene int, ctrl boolean, u double, nz double, ties double")
    parts = staging.written(parts, "rank-parts")
    ctrl = parts.filter("ctrl")
    before = ctrl.select("range", "gene", (F.sum("nz").over(Window.partitionBy("gene").orderBy("range")) - F.col("nz")).alias("_before"))
    tgt = parts.filter("not ctrl").join(before, ["range", "gene"]).groupBy(*GROUP, "gene")
    added = tgt.agg(F.sum(F.col("u") + F.col("_before") * F.col("nz")).alias("u"), F.sum("nz").cast("bigint").alias("nz"), F.sum("ties").alias("ties"))
    return added, ctrl.groupBy("gene").agg(F.sum("nz").cast("bigint").alias("cnz"), F.sum("ties").alias("cties"))
