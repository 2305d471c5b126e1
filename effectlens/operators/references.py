"""References that a score is read against: split halves of the measured cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.functions import numeric
from effectlens.operators import profiles
from effectlens.sources import staging

#: Metrics whose half-against-half value is carried to whole data by 2 r / (1 + r).
CORRELATIONS = ("delta_pearson", "lfc_spearman", "lfc_spearman_pos", "lfc_spearman_neg", "nsig_spearman")


def split(counts: DataFrame, libs: DataFrame, seed: int, control: int) -> DataFrame:
    """Counts of measured cells, side 0 and 1 being two disjoint halves of each group.

    Groups of one cell are left out; the control must have two.
    """
    dealt = profiles.halves(libs.filter("side = 0"), seed)
    if dealt.filter(F.col("pert") == control).limit(1).count() == 0:
        raise ValueError("the control has fewer than two cells")
    real = counts.filter("side = 0").select("pert", "cell", "gene", "x")
    return real.join(dealt.select("pert", "cell", "half"), ["pert", "cell"]).select(F.col("half").cast("int").alias("side"), "pert", "cell", "gene", "x")


def half_profiles(values: DataFrame, libs: DataFrame, genes: DataFrame, seeds: tuple[int, ...], control: int, bulk_sum: float = profiles.BULK_SUM) -> tuple[DataFrame, DataFrame]:
    """Profiles and group sizes of all halvings of the measured cells in one pass: sides 2 i and 2 i + 1 are the halves of split i.

    ``values`` holds x and v of nonzeros.  Each value is read once and multiplied
    only within the task that sums it up.
    """
    mine = libs.filter("side = 0")
    dealt = staging.written(profiles.halvings(mine, seeds).select("pert", "cell", (2 * F.col("split_index") + F.col("half")).cast("int").alias("side")), "halvings")
    if dealt.filter(F.col("pert") == control).limit(1).count() == 0:
        raise ValueError("the control has fewer than two cells")
    sizes = staging.written(profiles.group_sizes(dealt.join(mine.select("pert", "cell", "lib"), ["pert", "cell"])), "half-sizes")
    sides = dealt.groupBy("pert", "cell").agg(F.collect_list("side").alias("sides"))
    rows = values.filter("side = 0").select("pert", "cell", "gene", "x", "v").join(sides, ["pert", "cell"]).withColumn("side", F.explode("sides"))
    return profiles.profiles(rows, sizes, genes, bulk_sum), sizes


def ceiling(tidy: DataFrame) -> DataFrame:
    """perturbation, metric, value: 2 r / (1 + r) of positive correlations, else NaN."""
    v = F.col("value")
    return tidy.select("perturbation", "metric", F.when(v > 0, F.try_divide(2 * v, 1 + v)).otherwise(F.lit(numeric.NAN)).alias("value"))


def fold_changes(profile: DataFrame, control: int, epsilon: float = 1e-9, mean: str = "normalized") -> DataFrame:
    """side, target, feature, lfc: each side against its own control."""
    ref = profile.filter(F.col("pert") == control).select("side", "gene", F.col(mean).alias("ref"))
    rows = profile.filter(F.col("pert") != control).join(ref, ["side", "gene"])
    return rows.select("side", F.col("pert").alias("target"), F.col("gene").alias("feature"), numeric.log2_ratio(F.col(mean), F.col("ref"), epsilon).alias("lfc"))


def nmae_references(de: DataFrame, halves: DataFrame, own: DataFrame, threshold: float = 0.05, least: int = 10) -> DataFrame:
    """split_index, target, raw, scaled (raw / sqrt 2): error of one half's fold changes by the other's, sides 2 i and 2 i + 1 being the halves of split i.

    Gate and denominator come from the full measured table, as in the metric
    itself; own genes and targets of fewer than ``least`` genes are left out.
    """
    sig = de.filter((F.col("p_adj") < threshold) & ~F.isnan("p_adj") & (F.abs("log2_fold_change") < float("inf"))).select("target", "feature", F.col("log2_fold_change").alias("full"))
    sig = sig.join(own.select(F.col("pert").alias("target"), F.col("gene").alias("feature")), ["target", "feature"], "left_anti")
    split = F.floor(F.col("side") / 2).cast("int").alias("split_index")
    side = lambda s, name: halves.filter(F.col("side") % 2 == s).select(split, "target", "feature", F.col("lfc").alias(name))
    both = sig.join(side(0, "a"), ["target", "feature"]).join(side(1, "b"), ["split_index", "target", "feature"])
    g = both.groupBy("split_index", "target").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap"), F.avg(F.abs("full")).alias("size"))
    raw = F.try_divide("gap", "size")
    return g.filter((F.col("n") >= least) & (F.col("size") > 0)).select("split_index", "target", raw.alias("raw"), (raw / F.sqrt(F.lit(2.0))).alias("scaled"))


def nmae_reference(de: DataFrame, halves: DataFrame, own: DataFrame, threshold: float = 0.05, least: int = 10) -> DataFrame:
    """target, raw, scaled of one halving, sides 0 and 1."""
    return nmae_references(de, halves, own, threshold, least).drop("split_index")


def anchor(splits: DataFrame) -> DataFrame:
    """metric, replicate, replicate_sd, replicate_min, replicate_max over (split_index, metric, value)."""
    return splits.groupBy("metric").agg(
        F.avg("value").alias("replicate"), F.stddev_pop("value").alias("replicate_sd"), F.min("value").alias("replicate_min"), F.max("value").alias("replicate_max")
    )
