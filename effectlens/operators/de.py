"""Differential expression: fold changes, tie-corrected rank sums, false-discovery rates, preparation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.functions import numeric
from effectlens.sources import staging

KEY = ["target", "feature"]


def rank_sum(values: DataFrame, sizes: DataFrame, profile: DataFrame, control: int, control_side: int = 0) -> DataFrame:
    """side, pert, gene, z, p_value: every target against the control of ``control_side``, zeros as one tie.

    The control isn't copied to each target: within a gene, running counts of
    control values meet the targets' distinct values in one ordered pass.
    """
    v = values.select("side", "pert", "gene", "v")
    ctrl = v.filter((F.col("side") == control_side) & (F.col("pert") == control)).groupBy("gene", "v").agg(F.count("*").alias("c"))
    tgt = v.filter(F.col("pert") != control).groupBy("side", "pert", "gene", "v").agg(F.count("*").alias("t"))
    none = F.lit(None).cast("int")
    rows = tgt.withColumn("c", F.lit(0).cast("bigint")).unionByName(ctrl.select(none.alias("side"), none.alias("pert"), "gene", "v", F.lit(0).cast("bigint").alias("t"), "c"))
    upto = F.sum("c").over(Window.partitionBy("gene").orderBy("v"))
    same = F.sum("c").over(Window.partitionBy("gene", "v"))
    rows = rows.withColumn("eq", same).withColumn("lt", upto - same).filter("side is not null")
    cube: Column = lambda c: c * c * c - c
    d = lambda c: F.col(c).cast("double")
    part = rows.groupBy("side", "pert", "gene").agg(
        F.sum(d("t") * (d("lt") + d("eq") / 2)).alias("u"), F.sum("t").alias("nz"), F.sum(cube(d("t") + d("eq")) - cube(d("eq"))).alias("ties")
    )
    base = ctrl.groupBy("gene").agg(F.sum("c").alias("cnz"), F.sum(cube(d("c"))).alias("cties"))
    return from_parts(part, base, sizes, profile, control, control_side)


def from_parts(part: DataFrame, base: DataFrame, sizes: DataFrame, profile: DataFrame, control: int, control_side: int = 0) -> DataFrame:
    """``rank_sum`` of nonzeros' u, nz and ties by target and gene, and the control's cnz and cties by gene."""
    cube: Column = lambda c: c * c * c - c
    d = lambda c: F.col(c).cast("double")
    n2 = sizes.filter((F.col("side") == control_side) & (F.col("pert") == control)).select(F.col("n").alias("n2"))
    grid = profile.filter(F.col("pert") != control).select("side", "pert", "gene", F.col("n").alias("n1"))
    full = grid.join(part, ["side", "pert", "gene"], "left").join(base, "gene", "left").join(F.broadcast(n2), F.lit(True)).fillna(0)
    zt, zc = d("n1") - d("nz"), d("n2") - d("cnz")
    n = d("n1") + d("n2")
    u = d("u") + d("nz") * zc + zt * zc / 2
    ties = d("ties") + d("cties") + cube(zt + zc)
    var = d("n1") * d("n2") / 12 * ((n + 1) - F.try_divide(ties, n * (n - 1)))
    z = F.when(var > 1e-12, (u - d("n1") * d("n2") / 2) / F.sqrt(F.when(var > 1e-12, var).otherwise(1.0))).otherwise(F.lit(0.0))
    out = full.select("side", "pert", "gene", z.alias("z")).withColumn("_x", F.abs("z") / F.sqrt(F.lit(2.0)))
    return out.select("side", "pert", "gene", "z", F.expr(numeric.erfc_sql("_x")).alias("p_value"))


def benjamini_hochberg(df: DataFrame, p: str, scope: list[str], order: list[str]) -> DataFrame:
    """``df`` with p_adj by step-up within ``scope`` (all rows if empty); NaN and null stay."""
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    by = [F.when(usable, 0).otherwise(1).alias("_unusable"), *[F.col(c) for c in scope]]
    up = Window.partitionBy(*by).orderBy(F.col(p), *order)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = df.withColumn("_step", F.col(p) * n / F.row_number().over(up))
    down = Window.partitionBy(*by).orderBy(F.col(p).desc(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adj", F.when(usable, F.least(F.lit(1.0), F.min("_step").over(down))).otherwise(F.col(p))).drop("_step")


def benjamini_hochberg_wide(df: DataFrame, p: str, scope: list[str], order: list[str]) -> DataFrame:
    """As ``benjamini_hochberg``, for few scopes of very many rows: none is sorted in one task.

    Rows are dealt by ranges of p; a range knows its ranks from the sizes of the
    ranges before it, and its least step from the least ones of those after it.
    """
    df = staging.written(df, "unadjusted")  # p is computed once, not again for the bounds of ranges
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    by = [F.col(c) for c in scope]
    dealt = df.filter(usable).repartitionByRange(*by, F.col(p), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    dealt = staging.written(dealt, "ranges")
    w = lambda *c: Window.partitionBy(*by).orderBy(*c)
    ranges = dealt.groupBy("_part", *by).agg(F.count("*").alias("_rows"))  # a row for each range and scope
    ranges = ranges.select("_part", *by, (F.sum("_rows").over(w("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(*by)).alias("_n"))
    local = Window.partitionBy("_part", *by)
    rank = F.row_number().over(local.orderBy(F.col(p), *order)) + F.col("_before")
    ranked = dealt.join(ranges, ["_part", *scope]).withColumn("_step", F.col(p) * F.col("_n") / rank)
    down = local.orderBy(F.col(p).desc(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = staging.written(ranked.withColumn("_least", F.min("_step").over(down)), "steps")
    later = ranked.groupBy("_part", *by).agg(F.min("_step").alias("_own"))
    later = later.select("_part", *by, F.min("_own").over(w(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    out = ranked.join(later, ["_part", *scope]).withColumn("p_adj", F.least(F.lit(1.0), F.col("_least"), F.col("_later")))
    return out.select(*df.columns, "p_adj").unionByName(df.filter(~usable).withColumn("p_adj", F.col(p).cast("double")))


def gated_genes(profile: DataFrame, control: int, least: float) -> DataFrame:
    """gene, cpm, kept: counts per million of the measured control cells, which no prediction can move, above the gate or not."""
    ref = profile.filter((F.col("side") == 0) & (F.col("pert") == control))
    return ref.select("gene", F.col("normalized").alias("cpm"), (F.col("normalized") > least).alias("kept"))


def de_table(values: DataFrame, sizes: DataFrame, profile: DataFrame, control: int, epsilon: float = 1e-9, cpm_gate: float = 5.0, scope: str = "per_pert", clip: float | None = None, mean: str = "normalized", control_source: str = "real", parts: Callable | None = None) -> DataFrame:
    """side, target, feature, log2_fold_change, p_value, p_adj of both sides, against the measured control or (``pred``) each side's own.

    ``parts`` gives, for the control's side and the one side meant (or None), what ``from_parts`` takes in place of ``values``.
    """
    out = None
    for side, of in ((None, 0),) if control_source == "real" else ((0, 0), (1, 1)):
        mine = lambda df: df if side is None else df.filter(F.col("side") == side)  # noqa: B023, E731
        ref = profile.filter((F.col("side") == of) & (F.col("pert") == control)).select("gene", F.col(mean).alias("ref"))
        lfc = mine(profile.filter(F.col("pert") != control)).join(ref, "gene")
        lfc = lfc.select("side", "pert", "gene", numeric.log2_ratio(F.col(mean), F.col("ref"), epsilon, clip).alias("log2_fold_change"))
        ranked = from_parts(*parts(of, side), sizes, profile, control, of) if parts else rank_sum(mine(values) if side is not None else values, sizes, profile, control, of)
        part = lfc.join(mine(ranked), ["side", "pert", "gene"])
        out = part if out is None else out.unionByName(part)
    if cpm_gate >= 0:
        out = out.join(gated_genes(profile, control, cpm_gate).filter("kept").select("gene"), "gene", "left_semi")
    out = out.select("side", F.col("pert").alias("target"), F.col("gene").alias("feature"), "log2_fold_change", "p_value")
    if scope == "per_pert":
        return benjamini_hochberg(out, "p_value", ["side", "target"], ["target", "feature"])
    return benjamini_hochberg_wide(out, "p_value", ["side"], ["target", "feature"])


def apply_policies(de: DataFrame, nan_lfc: str = "mask", min_abs_lfc: float = 0.0) -> DataFrame:
    """p_adj 1 where the fold change is NaN ("mask"), and below the effect floor."""
    lfc = F.col("log2_fold_change")
    p = F.col("p_adj")
    if nan_lfc == "mask":
        p = F.when(F.isnan(lfc), F.lit(1.0)).otherwise(p)
    if min_abs_lfc > 0:
        p = F.when(F.coalesce((F.abs(lfc) < min_abs_lfc) & ~F.isnan(lfc), F.lit(False)), F.lit(1.0)).otherwise(p)
    return de.withColumn("p_adj", p)


def refuse_duplicates(de: DataFrame) -> None:
    found = de.groupBy(*KEY).count().filter("count > 1").limit(5).collect()
    if found:
        raise ValueError(f"duplicate (target, feature) keys: {[tuple(r)[:2] for r in found]}")


def resolve_own(de: DataFrame, given: DataFrame | None) -> DataFrame:
    """target, feature: an explicit map first, else the target itself where it is measured."""
    targets, features = de.select("target").distinct(), de.select(F.col("feature").alias("own")).distinct()
    same = targets.join(features, F.col("target").cast("string") == F.col("own").cast("string")).select("target", F.col("own").alias("feature"))
    if given is None:
        return same
    return given.unionByName(same.join(given.select("target"), "target", "left_anti"))


def significance_ranks(de: DataFrame, threshold: float, by: str = "abs_log2_fold_change") -> DataFrame:
    """target, feature, rnk of significant rows: largest effect first, ties by feature."""
    key = F.abs("log2_fold_change").desc() if by == "abs_log2_fold_change" else F.col(by).asc()
    w = Window.partitionBy("target").orderBy(key, "feature")
    return de.filter((F.col("p_adj") < threshold) & ~F.isnan("p_adj")).select(*KEY, F.row_number().over(w).alias("rnk"))
