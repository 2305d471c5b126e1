"""Aggregation of tidy results and scores on a scale between a baseline and an anchor."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


@dataclass(frozen=True)
class Policy:
    """How a metric scores: its better direction, best value, tail and clamps."""

    higher: bool = True
    anchor: float | None = 1.0
    low: float | None = 0.0
    high: float | None = 1.0
    tail: str = "linear"  # boxcox: losses beyond the baseline are stretched, down to -cap
    metric_min: float | None = None
    scored: bool = True


ERROR = Policy(False, 0.0, None, 1.0, "boxcox")
ERROR_LINEAR = Policy(False, 0.0, -6.0, 1.0)
BOUNDED = Policy()
UNFLOORED = Policy(low=None, metric_min=0.0)
OPEN = Policy(anchor=None, low=-2.0, high=2.0)
DIAGNOSTIC = Policy(scored=False)
CAPPED = Policy(False, 0.0, 0.0, 1.0, "boxcox")


def _finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def value_of(u: Column, base: Column, policy: Policy, anchor: Column | None = None, power: float = 2.0, cap: float = 6.0) -> Column:
    """Score of u: 0 at the baseline, 1 at the anchor; null where the scale is degenerate."""
    a = anchor if anchor is not None else (F.lit(policy.anchor) if policy.anchor is not None else None)
    if a is None:
        d = F.abs(base)
        s = (u - base) if policy.higher else (base - u)
    else:
        d = (a - base) if policy.higher else (base - a)
        s = (u - base) if policy.higher else (base - u)
    fine = _finite(base) & _finite(d) & (d > 0)
    score = F.try_divide(s, d)
    if policy.tail == "boxcox":
        r = 1 - score
        score = F.when(score < 0, F.greatest(F.lit(-cap), -(F.pow(r, F.lit(power)) - 1) / power)).otherwise(score)
    unusable = ~_finite(u)
    worst = F.lit(policy.low) if policy.low is not None else F.try_divide((F.lit(policy.metric_min) - base) if policy.metric_min is not None else F.lit(-cap), d if policy.metric_min is not None else F.lit(1.0))
    score = F.when(unusable, worst).otherwise(score)
    if policy.low is not None:
        score = F.greatest(F.lit(policy.low), score)
    if policy.high is not None:
        score = F.least(F.lit(policy.high), score)
    return F.when(fine, score)


def aggregate(tidy: DataFrame, medians: tuple[str, ...] = ()) -> DataFrame:
    """metric, mean (or median), agg: NaN and null rows are skipped; none left is NaN."""
    v = F.when(~F.isnan("value"), F.col("value"))
    median = F.col("metric").isin(*medians) if medians else F.lit(False)
    g = tidy.groupBy("metric").agg(F.avg(v).alias("_mean"), F.median(v).alias("_median"))
    return g.select("metric", F.coalesce(F.when(median, F.col("_median")).otherwise(F.col("_mean")), F.lit(NAN)).alias("mean"), F.when(median, "median").otherwise("mean").alias("agg"))


def statistics(tidy: DataFrame) -> DataFrame:
    """One row a metric: count and null_count of rows, then mean, sample deviation, min, max, median of numbers."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return tidy.groupBy("metric").agg(
        F.count("*").alias("count"), F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("null_count"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"),
    )


def wide_statistics(tidy: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a statistic, one column a metric."""
    rows = statistics(tidy.filter(F.col("metric").isin(*metrics)))
    names = [c for c in rows.columns if c != "metric"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("x")) for c in names]))
    return rows.select("metric", cells.alias("s")).groupBy("s.statistic").pivot("metric", metrics).agg(F.first("s.x"))


def cohorts(tidy: DataFrame, derived: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """n_rows, n_used, n_nan, n_null of each metric; a derived one counts the perturbations that are finite in both parts."""
    one: Column = lambda c: F.sum(F.when(c, 1).otherwise(0))
    null, nan = F.col("value").isNull(), F.coalesce(F.isnan("value"), F.lit(False))
    out = tidy.groupBy("metric").agg(F.count("*").alias("n_rows"), one(~null & ~nan).alias("n_used"), one(nan).alias("n_nan"), one(null).alias("n_null"))
    out = out.withColumn("derived", F.lit(False))
    for name, parts in (derived or {}).items():
        both = tidy.filter(F.col("metric").isin(*parts)).groupBy("perturbation").agg(one(_finite(F.col("value"))).alias("fine"), F.count("*").alias("n"))
        row = both.agg(F.count("*").alias("n_rows"), F.coalesce(one(F.col("fine") == 2), F.lit(0)).alias("n_used"))
        row = row.select(F.lit(name).alias("metric"), "n_rows", "n_used", (F.col("n_rows") - F.col("n_used")).alias("n_nan"), F.lit(0).cast("long").alias("n_null"), F.lit(True).alias("derived"))
        out = out.unionByName(row.filter("n_rows > 0"))
    return out


def hierarchy(tidy: DataFrame) -> DataFrame:
    """context, metric, value from (context, perturbation, metric, value): means of contexts, and their mean as ``overall``."""
    v = F.when(~F.isnan("value"), F.col("value"))
    per = tidy.groupBy("context", "metric").agg(F.avg(v).alias("value"))
    return per.unionByName(per.groupBy("metric").agg(F.avg("value").alias("value")).withColumn("context", F.lit("overall")))


def ratio_of_sums(tidy: DataFrame, numerator: str, denominator: str, name: str) -> DataFrame:
    """A derived metric over perturbations that are finite in both parts; NaN unless the denominator is positive."""
    fine = tidy.filter(_finite(F.col("value")))
    part = lambda m, c: fine.filter(F.col("metric") == m).select("perturbation", F.col("value").alias(c))
    g = part(numerator, "a").join(part(denominator, "b"), "perturbation").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return g.select(F.lit(name).alias("metric"), F.when(F.col("b") > 0, F.try_divide("a", "b")).otherwise(F.lit(NAN)).alias("value"))


def score(results: DataFrame, baseline: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """metric, from_baseline, and a last row avg_score, from (metric, mean) of a run and its baseline."""
    both = results.select("metric", F.col("mean").alias("u")).join(baseline.select("metric", F.col("mean").alias("b")), "metric")
    out = F.lit(None).cast("double")
    for name, p in policies.items():
        if p.scored:
            out = F.when(F.col("metric") == name, value_of(F.col("u"), F.col("b"), p)).otherwise(out)
    rows = both.withColumn("from_baseline", out).filter(F.col("from_baseline").isNotNull()).select("metric", "from_baseline")
    return rows.unionByName(rows.agg(F.avg("from_baseline").alias("from_baseline")).select(F.lit("avg_score").alias("metric"), "from_baseline"))


@dataclass(frozen=True)
class Scale:
    """A frozen scale: for each of its metrics the value that scores 0, and how it scores."""

    name: str
    entries: dict[str, tuple[float, Policy]]

    def __post_init__(self) -> None:
        if self.name in OWN_COLUMNS or not self.entries:
            raise ValueError(f"a scale needs a name of its own and entries: {self.name!r}")
        for metric, (base, p) in self.entries.items():
            room = None if p.anchor is None else (p.anchor - base if p.higher else base - p.anchor)
            if not p.scored or not math.isfinite(base) or room is None or not room > 0:
                raise ValueError(f"scale {self.name!r} gives {metric!r} no usable range")


OWN_COLUMNS = ("metric", "from_baseline", "from_reference", "from_replicate")
_FROM = lambda base, low: (base, Policy(True, 1.0, low, 1.0))
_TO = lambda base, low: (base, Policy(False, 0.0, low, 1.0))
#: Fixed values of the published scale: 0 is the random minimum, 1 is real input.
SCALES: dict[str, Scale] = {
    s.name: s
    for s in (
        Scale("low-random_high-1_v10", {
            "expr_mse_unbiased_capped_norm": _TO(1.0, -6.0),
            "de_wilcoxon_lfc_nmae": _TO(1.0, -1.0),
            "pds_cosine": _FROM(0.5, -1.0),
            "de_wilcoxon_direction_fidelity_yield_raw": _FROM(0.5, -1.0),
            "de_wilcoxon_direction_reach_raw": _FROM(0.0, 0.0),
            "de_wilcoxon_sig_jaccard": _FROM(0.0, 0.0),
        }),
    )
}


def _scored(results: DataFrame, entries: dict[str, tuple[Column, Policy, Column | None]], column: str) -> DataFrame:
    """metric, ``column`` of exactly the metrics in ``entries`` (base, policy, anchor), with their average; any that is missing raises."""
    have = {r["metric"] for r in results.select("metric").distinct().collect()}  # a catalog's worth of names
    if lacking := sorted(set(entries) - have):
        raise ValueError(f"{column} needs {lacking}, which the results lack: an average over fewer metrics would not be the same score")
    out = F.lit(None).cast("double")
    for name, (base, p, anchor) in entries.items():
        out = F.when(F.col("metric") == name, value_of(F.col("mean"), base, p, anchor)).otherwise(out)
    rows = results.filter(F.col("metric").isin(*entries)).select("metric", out.alias(column))
    return rows.unionByName(rows.agg(F.avg(column).alias(column)).select(F.lit("avg_score").alias("metric"), column))


def scale_column(results: DataFrame, scale: str | Scale) -> DataFrame:
    """metric and a column of the scale's name: its metrics between its fixed ends, and their average."""
    s = SCALES[scale] if isinstance(scale, str) else scale
    return _scored(results, {m: (F.lit(base), p, None) for m, (base, p) in s.entries.items()}, s.name)


def replicate_column(results: DataFrame, baseline: DataFrame, anchor: DataFrame, policies: dict[str, Policy], decisive: tuple[str, ...] = ()) -> DataFrame:
    """metric, from_replicate: 0 at the baseline, 1 at the measured replicate; the metric's own policy otherwise.

    A metric without a usable range is left out, unless it is decisive: then it raises.
    """
    names = [m for m, p in policies.items() if p.scored]
    ends = baseline.select("metric", F.col("mean").alias("base")).join(anchor.select("metric", "replicate"), "metric", "full").filter(F.col("metric").isin(*names))
    entries = {}
    for r in ends.collect():  # a catalog's worth of rows
        p, b, a = policies[r["metric"]], r["base"], r["replicate"]
        ok = all(x is not None and math.isfinite(x) for x in (a, b)) and ((a - b) if p.higher else (b - a)) > 0
        if ok and p.metric_min is not None:
            ok = p.metric_min < a if p.higher else p.metric_min > a
        if ok:
            entries[r["metric"]] = (F.lit(b), p, F.lit(a))
        elif r["metric"] in decisive:
            raise ValueError(f"{r['metric']}: baseline {b} and replicate {a} leave no usable range")
    return _scored(results, entries, "from_replicate")


def reference_column(results: DataFrame, raw: float | None, n_perturbations: int) -> DataFrame:
    """metric, from_reference of the fold-change errors: (1 - nmae) / (1 - reference); not rescaled from a reference of 1 on.

    No reference and no perturbations leave it null; anything else that isn't a mean of errors raises.
    """
    if (raw is None) != (n_perturbations == 0) or raw is not None and not (math.isfinite(raw) and raw >= 0 and n_perturbations > 0):
        raise ValueError(f"a reference of {raw} over {n_perturbations} perturbations")
    u = F.col("mean")
    gap = 1.0 if raw is None or raw >= 1 else 1 - raw
    value = F.when(F.col("metric").rlike("^de_[a-z0-9]+_lfc_nmae$") & _finite(u) & F.lit(raw is not None), (1 - u) / gap)
    return results.select("metric", value.cast("double").alias("from_reference"))


def with_overrides(policies: dict[str, Policy], overrides: dict[str, Policy], legacy: dict[str, str]) -> dict[str, Policy]:
    """``policies`` with some replaced; names may be those of version 1, and no metric may come twice."""
    out, seen = dict(policies), set()
    for name, p in overrides.items():
        name = legacy.get(name, name)
        if name not in policies or name in seen:
            raise ValueError(f"{name!r} is " + ("overridden twice" if name in seen else "not a metric"))
        seen.add(name)
        out[name] = p
    return out


def legacy_score(results: DataFrame, baseline: DataFrame, lower: tuple[str, ...]) -> DataFrame:
    """The version 1 score: 1 - u/b for errors, else (u - b)/(1 - b); not finite or negative is 0."""
    both = results.select("metric", F.col("mean").alias("u")).join(baseline.select("metric", F.col("mean").alias("b")), "metric")
    s = F.when(F.col("metric").isin(*lower), 1 - F.try_divide("u", "b")).otherwise(F.try_divide(F.col("u") - F.col("b"), 1 - F.col("b")))
    s = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), s))
    return both.select("metric", s.alias("score"))
