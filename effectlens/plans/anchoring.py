"""The replicate anchor: each metric between halves of the measured cells, over several halvings that share one pass."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.operators import references
from effectlens.plans import catalog, scoring
from effectlens.plans.evaluation import Evaluation
from effectlens.sources import staging

#: How a metric's value in a split comes about: one half against the other, or by the gate of the full table.
HALF, FULL_GATE = "split_half", "full_gate"
SPLITS = 5


def seeds(base: int = 0, n: int = SPLITS) -> tuple[int, ...]:
    """The seeds of the halvings."""
    if n < 1:
        raise ValueError(f"an anchor needs a halving, not {n}")
    return tuple(base + i for i in range(n))


def estimator(name: str) -> str:
    """HALF, or FULL_GATE for the errors of fold changes: half a table gates other genes than the full one."""
    return FULL_GATE if name.endswith("_lfc_nmae") else HALF


def half_evaluation(e: Evaluation, profile: DataFrame, sizes: DataFrame, split: int, seed: int) -> Evaluation:
    """Half 1 of a split as the prediction of half 0, each with its own control; counts are planned, and read only by tests of cells and the jackknife."""
    mine = lambda df: df.filter(F.col("side").between(2 * split, 2 * split + 1)).withColumn("side", (F.col("side") - 2 * split).cast("int"))
    one = Evaluation(references.split(e.counts, e.libs, seed, e.config.control), e.genes, e.own, replace(e.config, control_source="pred"), e.replicates)
    one.profile, one.sizes = mine(profile), mine(sizes)
    return one


def _nmae(e: Evaluation, profile: DataFrame, names: list[str]) -> DataFrame:
    """split_index, metric, value, n_perturbations of the fold-change errors of all splits."""
    halves = references.fold_changes(profile, e.config.control, e.config.epsilon, e.config.mean)
    per = references.nmae_references(e.de.filter("side = 0"), halves, e.own, e.config.p_adj_threshold)
    g = per.groupBy("split_index").agg(F.avg("raw").alias("value"), F.count("raw").alias("n_perturbations"))
    return g.select("split_index", F.explode(F.array(*[F.lit(n) for n in names])).alias("metric"), "value", "n_perturbations")


def split_values(e: Evaluation, names: list[str] | str, base_seed: int = 0, n_splits: int = SPLITS, whole: bool = True) -> DataFrame:
    """split_index, seed, metric, value, n_perturbations: aggregates of each split, for every wanted metric.

    Version 1 is refused, as its halves would be typed on their own.  A metric
    without a finite value in some split raises: an anchor that lacks it would
    change what a score is the average of.  Where it needn't be ``whole``,
    such values stay as they are, and splits that gate no target have no row.
    """
    c = e.config
    if not c.no_drop:
        raise ValueError("a replicate anchor needs the conventions of version 2")
    dealt = seeds(base_seed, n_splits)
    wanted = catalog.resolve(names, c.de_method)
    gated = [n for n in wanted if estimator(n) == FULL_GATE]
    halved = [n for n in wanted if n not in gated]
    profile, sizes = references.half_profiles(e.values, e.libs, e.genes, dealt, c.control, c.bulk_target_sum)
    profile = staging.written(profile, "half-profiles")
    out = _nmae(e, profile, [catalog.named(n, c.de_method) for n in gated]) if gated else None
    for i, seed in enumerate(dealt if halved else ()):
        tidy = staging.written(catalog.evaluate(half_evaluation(e, profile, sizes, i, seed), halved), "split")
        derived = {n: catalog.DERIVED[n] for n in halved if n in catalog.DERIVED}
        used = scoring.cohorts(tidy, derived).select("metric", F.col("n_used").alias("n_perturbations"))
        part = catalog.summarize(tidy, halved, c.de_method).join(used, "metric", "left").select(F.lit(i).alias("split_index"), "metric", F.col("mean").alias("value"), "n_perturbations")
        out = part if out is None else out.unionByName(part)
    seed_of = F.element_at(F.array(*[F.lit(s) for s in dealt]), F.col("split_index") + 1)
    found = staging.written(out.select("split_index", seed_of.alias("seed"), "metric", "value", F.col("n_perturbations").cast("long").alias("n_perturbations")), "splits")
    if whole:
        have = {(r["split_index"], r["metric"]) for r in found.collect() if r["value"] is not None and math.isfinite(r["value"])}  # a catalog's worth a split
        if lacking := [(i, n) for i in range(n_splits) for n in (catalog.named(w, c.de_method) for w in wanted) if (i, n) not in have]:
            raise ValueError(f"no usable value of these metrics, by split: {lacking}")
    return found


def anchor(splits: DataFrame) -> DataFrame:
    """references.anchor with n_perturbations_min, n_perturbations_max and how each value came about."""
    n = splits.groupBy("metric").agg(F.min("n_perturbations").alias("n_perturbations_min"), F.max("n_perturbations").alias("n_perturbations_max"))
    how = F.when(F.col("metric").endswith("_lfc_nmae"), FULL_GATE).otherwise(HALF)
    return references.anchor(splits).join(n, "metric").withColumn("estimator", how)
