"""Expression metrics: errors of profiles and effects, unbiased distances, discrimination ranks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.functions import numeric
from effectlens.operators import profiles
from effectlens.sources import staging

#: Perturbations of a block of distances.
BLOCK = 1024

def paired(profile: DataFrame, value: str, control: int, control_source: str = "real") -> DataFrame:
    """pert, gene, p, r, c, cp: predicted and measured profile, measured control, and the control of the prediction."""
    side = lambda s, name: profile.filter((F.col("side") == s) & (F.col("pert") != control)).select("pert", "gene", F.col(value).alias(name))
    ref = lambda s, name: profile.filter((F.col("side") == s) & (F.col("pert") == control)).select("gene", F.col(value).alias(name))
    both = side(1, "p").join(side(0, "r"), ["pert", "gene"]).join(ref(0, "c"), "gene")
    return both.join(ref(1, "cp"), "gene") if control_source == "pred" else both.withColumn("cp", F.col("c"))


def errors(profile: DataFrame, value: str, control: int, control_source: str = "real") -> DataFrame:
    """pert, expr_mae, expr_mse, delta_mae, delta_mse, delta_pearson (-1 where undefined), expr_real_mass (sum of expm1)."""
    d = paired(profile, value, control, control_source).select("pert", (F.col("p") - F.col("r")).alias("d"), (F.col("p") - F.col("cp")).alias("x"), (F.col("r") - F.col("c")).alias("y"), "r")
    s, n = F.sum, F.count("*").cast("double")
    x, y = F.col("x"), F.col("y")
    r = numeric.pearson(n, s(x), s(y), s(x * x), s(y * y), s(x * y))
    return d.groupBy("pert").agg(
        F.avg(F.abs("d")).alias("expr_mae"), F.avg(F.col("d") * F.col("d")).alias("expr_mse"), F.avg(F.abs(x - y)).alias("delta_mae"),
        F.avg((x - y) * (x - y)).alias("delta_mse"), F.when(F.isnan(r), -1.0).otherwise(r).alias("delta_pearson"), s(F.expm1("r")).alias("expr_real_mass"),
    )


def _corrected(profile: DataFrame, jk: DataFrame, own: DataFrame, control: int, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows of pairs with ``use`` (0 for own genes); and one row a perturbation: err, gap, g, jp, jr, jc."""
    rows = paired(profile, value, control).join(own.withColumn("own", F.lit(True)), ["pert", "gene"], "left")
    rows = rows.withColumn("use", F.when(F.col("own"), 0.0).otherwise(1.0))
    sq: Column = lambda c: F.sum(F.col("use") * c * c)
    dist = rows.groupBy("pert").agg(sq(F.col("p") - F.col("r")).alias("err"), sq(F.col("r") - F.col("c")).alias("gap"), F.sum("use").alias("g"))
    j = lambda s, name: jk.filter((F.col("side") == s) & (F.col("pert") != control)).select("pert", F.col("jk").alias(name))
    ctrl = jk.filter((F.col("side") == 0) & (F.col("pert") == control)).select(F.col("jk").alias("jc"))
    return rows, dist.join(j(1, "jp"), "pert").join(j(0, "jr"), "pert").join(F.broadcast(ctrl), F.lit(True))  # one row


def correction_budget(profile: DataFrame, jk: DataFrame, own: DataFrame, control: int, value: str = "bulk") -> DataFrame:
    """budget, claim (one row): the weighted scatter of predictions across perturbations, and what sampling correction asks of it."""
    rows, dist = _corrected(profile, jk, own, control, value)
    weights = rows.groupBy("pert").agg(F.sum("use").alias("g")).select("pert", (1 / F.col("g")).alias("w"))
    mean = rows.groupBy("gene").agg(F.avg("p").alias("mean"))
    dev = rows.join(weights, "pert").join(mean, "gene").filter("use = 1").withColumn("v", F.col("p") - F.col("mean"))
    w, v = F.col("w"), F.col("v")
    per = dev.groupBy("gene").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2")).filter("n >= 2 and sw > 0")
    budget = per.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("sw"))), F.lit(0.0)).alias("budget"))
    return budget.join(dist.agg(F.sum(F.least("jp", "jr") / F.col("g")).alias("claim")), F.lit(True))


def unbiased(profile: DataFrame, jk: DataFrame, own: DataFrame, control: int, value: str = "bulk", budget: DataFrame | None = None) -> DataFrame:
    """pert, expr_mse_unbiased, expr_mse_unbiased_capped, expr_distance_unbiased; own genes leave the distances.

    ``budget`` is that of the whole panel where ``profile`` holds a part of it.
    """
    _, dist = _corrected(profile, jk, own, control, value)
    term = F.least("jp", "jr")
    scale = F.when(F.col("claim") > 0, F.least(F.lit(1.0), F.try_divide("budget", "claim"))).otherwise(1.0)
    out = dist.join(F.broadcast(budget or correction_budget(profile, jk, own, control, value)), F.lit(True))  # one row
    return out.select(
        "pert", ((F.col("err") - F.col("jp") - F.col("jr")) / F.col("g")).alias("expr_mse_unbiased"),
        ((F.col("err") - term * scale - F.col("jr")) / F.col("g")).alias("expr_mse_unbiased_capped"),
        ((F.col("gap") - F.col("jr") - F.col("jc")) / F.col("g")).alias("expr_distance_unbiased"),
    )


MEASURES = ("l1", "l2", "cosine")
#: Measured vectors that are set against a predicted one at a time.
ROWS = 64


def _vectors(profile: DataFrame, value: str, own: DataFrame, control: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """(pert, genes, effects, own) of the prediction and (pert, genes, effects) as measured; ``panel`` removes all own genes, ``row`` names each perturbation's."""
    e = profiles.effects(profile, value, control)
    if scope == "panel":
        e = e.join(own.select("gene").distinct(), "gene", "left_anti")
    cells = F.sort_array(F.collect_list(F.struct("gene", "e")))
    vectors = e.groupBy("side", "pert").agg(cells.alias("x")).select("side", "pert", F.col("x.gene").alias("genes"), F.col("x.e").alias("effects"))
    pred, real = (vectors.filter(F.col("side") == s).select(*[F.col(c).alias(c) for c in ("pert", "genes", "effects")]) for s in (1, 0))
    if scope == "row":
        return pred.join(own.groupBy("pert").agg(F.collect_list("gene").alias("own")), "pert", "left"), real
    return pred.withColumn("own", F.lit(None).cast("array<int>")), real


def _between(a: np.ndarray, b: np.ndarray, skip: list[np.ndarray]) -> np.ndarray:
    """MEASURES x rows of a x rows of b, without the columns ``skip[k]`` of row k.

    Products of all rows come from one matrix product; skipped columns are taken
    off again.  Where that leaves too few digits of l2 it is spelled out.
    """
    out = np.empty((3, len(a), len(b)))
    aa, bb, ab = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :], a @ b.T
    aa, bb = np.repeat(aa, len(b), axis=1), np.repeat(bb, len(a), axis=0)
    for k, columns in enumerate(skip):
        if len(columns):
            x, y = a[k, columns], b[:, columns]
            aa[k] -= (x * x).sum()
            bb[k] -= (y * y).sum(axis=1)
            ab[k] -= y @ x
    square = aa + bb - 2 * ab
    for k in range(len(a)):
        for at in range(0, len(b), ROWS):
            d = np.abs(b[at : at + ROWS] - a[k])
            if len(skip[k]):
                d[:, skip[k]] = 0.0
            out[0, k, at : at + ROWS] = d.sum(axis=1)
            near = np.flatnonzero(square[k, at : at + ROWS] <= 1e-4 * (aa[k, at : at + ROWS] + bb[k, at : at + ROWS]))
            square[k, at + near] = (d[near] * d[near]).sum(axis=1)
    out[1] = np.sqrt(np.maximum(square, 0.0))
    norm = np.sqrt(np.maximum(aa, 0.0) * np.maximum(bb, 0.0))
    out[2] = np.where(norm > 0, np.clip(1 - np.divide(ab, norm, out=np.zeros_like(ab), where=norm > 0), 0, 2), 1.0)
    return out


def _matrices(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Effects of both tables on the genes that both have, and the own columns of each row of the first; genes of one side only have no partner to differ from."""
    flat = [pc.list_flatten(t.column("genes")).to_numpy() for t in (left, right)]
    genes = np.intersect1d(*flat)

    def matrix(t: pa.Table, mine: np.ndarray) -> np.ndarray:
        keep = np.isin(mine, genes)
        of = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column("genes")).to_numpy())
        out = np.zeros((t.num_rows, len(genes)))
        out[of[keep], np.searchsorted(genes, mine[keep])] = pc.list_flatten(t.column("effects")).to_numpy()[keep]
        return out

    skip = [np.flatnonzero(np.isin(genes, x)) if x else np.empty(0, np.int64) for x in left.column("own").to_pylist()]
    return matrix(left, flat[0]), matrix(right, flat[1]), skip


def _blocks(pred: DataFrame, real: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides in about equal blocks, each pair of which meets in one task: what is shuffled grows with P x P / block vectors."""
    m = max(1, -(-real.count() // block))
    own_block, every = F.pmod(F.xxhash64("pert"), F.lit(m)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    return pred.select("*", own_block.alias("i"), every.alias("j")), real.select(*[F.col(c).alias(c) for c in real.columns], every.alias("i"), own_block.alias("j"))


def distances(profile: DataFrame, value: str, own: DataFrame, control: int, scope: str, block: int = BLOCK) -> DataFrame:
    """pert, other, l1, l2, cosine: each predicted effect to each measured one."""
    staging.ship(profile.sparkSession)
    pred, real = _blocks(*_vectors(profile, value, own, control, scope), block)
    kind = dict(profile.dtypes)["pert"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        of = left.schema.field("pert").type
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("pert", of), ("other", of), *((x, pa.float64()) for x in MEASURES))})
        d = _between(*_matrices(left, right))
        n, m = d.shape[1:]
        p, o = (t.column("pert").combine_chunks().take(pa.array(at)) for t, at in ((left, np.repeat(np.arange(n), m)), (right, np.tile(np.arange(m), n))))
        return pa.table({"pert": p, "other": o} | {c: d[i].ravel() for i, c in enumerate(MEASURES)})

    return pred.groupBy("i", "j").cogroup(real.groupBy("i", "j")).applyInArrow(compare, f"pert {kind}, other {kind}, l1 double, l2 double, cosine double")


def standing(profile: DataFrame, value: str, own: DataFrame, control: int, scope: str, block: int = BLOCK) -> DataFrame:
    """pert, n, and for each measure less, same and lower: how many measured effects lie nearer to the predicted one than its own does, as near (others only), and as near with a smaller label.

    The distance to its own effect travels with each perturbation, so that a
    pair of blocks returns counts and no distances.  Distances are compared at 9
    digits; perturbations that weren't measured have no row.
    """
    staging.ship(profile.sparkSession)
    pred, real = _vectors(profile, value, own, control, scope)
    kinds = dict(profile.dtypes)
    width = {"int": "int", "bigint": "bigint"}.get(kinds["gene"], kinds["gene"])

    def to_own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_d = np.empty((3, batch.num_rows))
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                mine = row.select(["pert", "genes", "effects", "own"])
                theirs = row.select(["pert", "real_genes", "real_effects"]).rename_columns(["pert", "genes", "effects"])
                own_d[:, i] = np.round(_between(*_matrices(mine, theirs))[:, 0, 0], 9)
            yield pa.record_batch([*(batch.column(c) for c in ("pert", "genes", "effects", "own")), *map(pa.array, own_d)], ["pert", "genes", "effects", "own", *(f"s_{c}" for c in MEASURES)])

    both = pred.join(real.select("pert", F.col("genes").alias("real_genes"), F.col("effects").alias("real_effects")), "pert")
    pred = both.mapInArrow(to_own, f"pert {kinds['pert']}, genes array<{width}>, effects array<double>, own array<int>, " + ", ".join(f"s_{c} double" for c in MEASURES))
    pred, real = _blocks(pred, real, block)
    counts = [f"{what}_{c}" for c in MEASURES for what in ("less", "same", "lower")]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        of = left.schema.field("pert").type
        if not left.num_rows or not right.num_rows:
            return pa.table({"pert": pa.array([], of), "n": pa.array([], pa.int64())} | {c: pa.array([], pa.int64()) for c in counts})
        d = np.round(_between(*_matrices(left, right)), 9)
        p, o = (np.array(t.column("pert").to_pylist()) for t in (left, right))
        other, before = o[None, :] != p[:, None], o[None, :] < p[:, None]
        out = {"pert": left.column("pert"), "n": pa.array(np.full(len(p), len(o)))}
        for i, c in enumerate(MEASURES):
            own_d = left.column(f"s_{c}").to_numpy()[:, None]
            same = (d[i] == own_d) & other
            for name, hit in (("less", (d[i] < own_d) & other), ("same", same), ("lower", same & before)):
                out[f"{name}_{c}"] = pa.array(hit.sum(axis=1))
        return pa.table(out)

    schema = f"pert {kinds['pert']}, n bigint, " + ", ".join(f"{c} bigint" for c in counts)
    parts = pred.groupBy("i", "j").cogroup(real.groupBy("i", "j")).applyInArrow(count, schema)
    return parts.groupBy("pert").agg(*[F.sum(c).alias(c) for c in ("n", *counts)])


def discrimination(stands: DataFrame, metric: str, ties: str = "midrank", denominator: str = "n-1") -> DataFrame:
    """pert, value: 1 - rank / D of the own profile among all, from ``standing``."""
    rank = F.col(f"less_{metric}") + (F.col(f"same_{metric}") / 2 if ties == "midrank" else F.col(f"lower_{metric}"))
    n = F.col("n") - (1 if denominator == "n-1" else 0)
    return stands.select("pert", (1 - numeric.ratio(rank, n, 0.0)).alias("value"))
