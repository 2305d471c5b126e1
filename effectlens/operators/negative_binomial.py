"""Differential expression from replicates: a negative-binomial model of pseudobulk counts.

Counts are summed by perturbation and replicate and scaled by size factors
(Spark aggregates).  Each target is set against the control's replicates, gene
by gene: dispersion by Cox-Reid likelihood, shrunk towards a trend over the
genes of its contrast, then coefficients by reweighted least squares and Wald
tests.  The rules are those published for this model (Love et al. 2014), without
replacing counts by Cook's distance; the trend falls back on the mean dispersion.

A row holds the counts of one gene of one contrast, so that kernels run over
vectors of genes in any partitioning; only a contrast's trend and filter see its
genes together, two numbers each.  With two groups the likelihood of a
coefficient is that of its group, so weighted means solve the least squares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.functions import numeric
from effectlens.operators import de
from effectlens.sources import staging

#: Least dispersion and mean, iterations of the fit, least variance of the prior, significance that the filter serves, and its steps (published defaults).
LEAST, LEAST_MEAN, STEPS, LEAST_PRIOR, ALPHA, THETAS = 1e-8, 0.5, 100, 0.25, 0.1, 50
_SAMPLE = ["side", "pert", "replicate"]
_CONTRAST = ["side", "target"]


def pseudobulk(counts: DataFrame, replicates: DataFrame, control: int, control_side: int | None = 0) -> DataFrame:
    """side, pert, replicate, gene, k: sums of counts by sample; every side has the control samples of ``control_side`` (None: its own)."""
    sums = counts.join(replicates, "cell").groupBy(*_SAMPLE, "gene").agg(F.sum("x").alias("k"))
    if control_side is None:
        return sums
    own = F.when(F.col("pert") == control, F.when(F.col("side") == control_side, F.array(F.lit(0), F.lit(1)))).otherwise(F.array("side"))
    return sums.withColumn("side", F.explode(own))


def size_factors(bulk: DataFrame) -> DataFrame:
    """side, pert, replicate, size_factor: medians of the ratios to the genes' geometric means over positive counts, of geometric mean 1 in a side."""
    positive = bulk.filter("k > 0")
    samples = positive.groupBy("side").agg(F.count_distinct("pert", "replicate").alias("n"))
    means = positive.groupBy("side", "gene").agg(F.sum(F.log("k")).alias("s")).join(samples, "side").select("side", "gene", (F.col("s") / F.col("n")).alias("mean"))
    ratios = positive.join(means, ["side", "gene"]).groupBy(*_SAMPLE).agg(F.median(F.log("k") - F.col("mean")).alias("r"))
    centre = ratios.groupBy("side").agg(F.avg("r").alias("centre"))
    return ratios.join(centre, "side").select(*_SAMPLE, F.exp(F.col("r") - F.col("centre")).alias("size_factor"))


def contrasts(bulk: DataFrame, factors: DataFrame, grid: DataFrame, control: int) -> DataFrame:
    """side, target, gene, a, sa, b, sb: counts and size factors of control and target samples, zeros included, for each gene of ``grid`` (side, pert, gene)."""
    staging.ship(bulk.sparkSession)
    listed = factors.groupBy("side", "pert").agg(F.sort_array(F.collect_list(F.struct("replicate", "size_factor"))).alias("samples"))
    rows = bulk.groupBy("side", "pert", "gene").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "k"))).alias("k"))
    dense = grid.select("side", "pert", "gene").join(listed, ["side", "pert"]).join(rows, ["side", "pert", "gene"], "left")
    k = F.transform("samples", lambda s: F.coalesce(F.element_at("k", s["replicate"]), F.lit(0.0)))
    dense = dense.select("side", "pert", "gene", k.alias("k"), F.col("samples.size_factor").alias("s"))
    a = dense.filter(F.col("pert") == control).select("side", "gene", F.col("k").alias("a"), F.col("s").alias("sa"))
    b = dense.filter(F.col("pert") != control).select("side", F.col("pert").alias("target"), "gene", F.col("k").alias("b"), F.col("s").alias("sb"))
    return b.join(a, ["side", "gene"]).select(*_CONTRAST, "gene", "a", "sa", "b", "sb")


# ---- kernels over genes x samples


def _correction(y: np.ndarray) -> np.ndarray:
    """What Stirling's formula for log gamma lacks, from 8 upwards."""
    return 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)


def _log_rising(k: np.ndarray, r: np.ndarray) -> np.ndarray:
    """log gamma(k + r) - log gamma(r) - k log r, without the cancellation of large r."""
    out = np.zeros(np.broadcast(k, r).shape)
    small = np.broadcast_to(r < 8, out.shape)
    if small.any():
        ks, rs = np.broadcast_to(k, out.shape)[small], np.broadcast_to(r, out.shape)[small]
        y = rs + 8
        shift = sum(np.log((rs + i) / (rs + ks + i)) for i in range(8))
        out[small] = shift + (y + ks - 0.5) * np.log1p(ks / y) + ks * np.log(y / rs) - ks + _correction(y + ks) - _correction(y)
    if not small.all():
        ks, rs = np.broadcast_to(k, out.shape)[~small], np.broadcast_to(r, out.shape)[~small]
        out[~small] = (rs + ks - 0.5) * np.log1p(ks / rs) - ks + _correction(rs + ks) - _correction(rs)
    return out


def likelihood(log_alpha: np.ndarray, k: np.ndarray, mu: np.ndarray, split: int) -> np.ndarray:
    """Cox-Reid adjusted log-likelihood of each row's dispersion, but for what doesn't depend on it; columns up to ``split`` are the control's."""
    alpha = np.exp(log_alpha)[:, None]
    r = 1 / alpha
    value = (_log_rising(k, r) - (k + r) * np.log1p(mu * alpha)).sum(axis=1)
    w = mu / (1 + alpha * mu)
    return value - 0.5 * np.log(w[:, :split].sum(axis=1) * w[:, split:].sum(axis=1))


def highest(f: Callable[[np.ndarray], np.ndarray], n: int, low: float, high: float, points: int = 25, steps: int = 45) -> np.ndarray:
    """For each of ``n`` rows where ``f`` is highest: the best point of a grid, refined by golden sections beside it."""
    grid = np.linspace(low, high, points)
    at = np.argmax(np.stack([f(np.full(n, x)) for x in grid]), axis=0)
    a, b = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, points - 1)]
    g = (np.sqrt(5) - 1) / 2
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        left = fx >= fy
        a, b = np.where(left, a, x), np.where(left, y, b)
        x, y = b - g * (b - a), a + g * (b - a)
        fx, fy = f(x), f(y)
    return (a + b) / 2


def _means(k: np.ndarray, s: np.ndarray, split: int) -> np.ndarray:
    """Fitted means of the samples: their group's mean of scaled counts."""
    q = k / s
    return np.maximum(s * np.concatenate([np.repeat(p.mean(axis=1, keepdims=True), p.shape[1], axis=1) for p in (q[:, :split], q[:, split:])], axis=1), LEAST_MEAN)


def moments(k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Dispersion by the method of moments over all samples, LEAST at least."""
    q = k / s
    mean, var = q.mean(axis=1), q.var(axis=1, ddof=1)
    return np.maximum(np.divide(var - mean * (1 / s).mean(axis=1), mean * mean, out=np.full(len(mean), LEAST), where=mean > 0), LEAST)


def coefficients(k: np.ndarray, s: np.ndarray, alpha: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log mean, weight, converged) of one group by iteratively reweighted least squares; means stay at LEAST_MEAN at least."""
    a = alpha[:, None]
    beta = np.log(np.maximum((k / s).mean(axis=1), 1e-3))
    settled = np.zeros(len(k), bool)
    for _ in range(steps):
        mu = np.maximum(s * np.exp(beta)[:, None], LEAST_MEAN)
        w = mu / (1 + a * mu)
        new = (w * (np.log(mu / s) + (k - mu) / mu)).sum(axis=1) / w.sum(axis=1)
        settled = np.abs(new - beta) < 1e-10 * (1 + np.abs(beta))
        beta = new
        if settled.all():
            break
    mu = np.maximum(s * np.exp(beta)[:, None], LEAST_MEAN)
    return beta, (mu / (1 + a * mu)).sum(axis=1), settled


def _by_layout(f: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, int], dict[str, np.ndarray]], names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over the rows of a batch that have as many samples of both kinds: it gets their counts, size factors and the number of control samples."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = {c: batch.column(c) for c in ("a", "sa", "b", "sb")}
            na, nb = (np.asarray(lists[c].value_lengths()) for c in ("a", "b"))
            for ca, cb in sorted(set(zip(na.tolist(), nb.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((na == ca) & (nb == cb))))
                flat = {c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in lists}
                made = f(part, np.concatenate([flat["a"], flat["b"]], axis=1), np.concatenate([flat["sa"], flat["sb"]], axis=1), ca)
                kept = [c for c in names if c in part.schema.names]
                yield pa.record_batch([part.column(c) if c in kept else pa.array(made[c]) for c in names], names)

    return run


def genewise(rows: DataFrame) -> DataFrame:
    """Rows of contrasts with mean (of scaled counts) and dispersion, NaN where all counts are 0."""

    def fit(part: pa.RecordBatch, k: np.ndarray, s: np.ndarray, split: int) -> dict[str, np.ndarray]:
        mean, out = (k / s).mean(axis=1), np.full(len(k), np.nan)
        some = mean > 0
        if some.any():
            mu = _means(k[some], s[some], split)
            out[some] = np.exp(highest(lambda x: likelihood(x, k[some], mu, split), int(some.sum()), np.log(LEAST), np.log(max(10, k.shape[1]))))
        return {"mean": mean, "genewise": out}

    names = [*rows.columns, "mean", "genewise"]
    return rows.mapInArrow(_by_layout(fit, names), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", mean double, genewise double")


def trend(mean: np.ndarray, dispersion: np.ndarray) -> tuple[float, float]:
    """(c0, c1) of dispersion = c0 + c1 / mean by gamma regression without outliers; (mean dispersion, 0) where that has no fit."""
    use = dispersion >= 100 * LEAST
    x, y = 1 / mean[use], dispersion[use]
    c = np.array([0.1, 1.0])
    for _ in range(10):
        fit = c[0] + c[1] * x
        good = (y / fit > 1e-4) & (y / fit < 15)
        new = c.copy()
        for _ in range(50):
            m = new[0] + new[1] * x[good]
            w = 1 / (m * m)
            s0, s1, s2 = w.sum(), (w * x[good]).sum(), (w * x[good] ** 2).sum()
            t0, t1 = (w * y[good]).sum(), (w * x[good] * y[good]).sum()
            det = s0 * s2 - s1 * s1
            if not np.isfinite(det) or det <= 1e-12 * s0 * s2:
                new = np.array([-1.0, -1.0])
                break
            step = np.array([s2 * t0 - s1 * t1, s0 * t1 - s1 * t0]) / det
            moved = np.abs(step - new).max() > 1e-10 * np.abs(step).max()
            new = step
            if (new <= 0).any() or not moved:
                break
        if (new <= 0).any():
            break
        done = (np.log(new / c) ** 2).sum() < 1e-6
        c = new
        if done:
            return float(c[0]), float(c[1])
    some = dispersion[dispersion > 10 * LEAST]
    return (float(some.mean()) if len(some) else LEAST), 0.0


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total, x = total + 1 / (x * x), x + 1
    return total + 1 / x + 1 / (2 * x * x) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def trends(fitted: DataFrame) -> DataFrame:
    """side, target, c0, c1, spread, prior: each contrast's trend, the variance of log dispersions about it, and that of their prior."""

    def one(table: pa.Table) -> pa.Table:
        mean, d, n = (table.column(c).to_numpy() for c in ("mean", "genewise", "samples"))
        fine = np.isfinite(d)
        c0, c1 = trend(mean[fine], d[fine])
        use = fine & (d >= 100 * LEAST)
        r = np.log(d[use]) - np.log(c0 + c1 / mean[use])
        spread = (1.4826 * float(np.median(np.abs(r - np.median(r))))) ** 2 if use.any() else 0.0
        prior = max(spread - _trigamma((int(n[0]) - 2) / 2), LEAST_PRIOR)
        return pa.table({"side": table.column("side")[:1], "target": table.column("target")[:1], "c0": [c0], "c1": [c1], "spread": [spread], "prior": [prior]})

    kinds = dict(fitted.dtypes)
    rows = fitted.select(*_CONTRAST, "mean", "genewise", (F.size("a") + F.size("b")).alias("samples"))
    return rows.groupBy(*_CONTRAST).applyInArrow(one, f"side {kinds['side']}, target {kinds['target']}, c0 double, c1 double, spread double, prior double")


def tested(fitted: DataFrame, trend_of: DataFrame) -> DataFrame:
    """side, target, gene, mean, dispersion, log2_fold_change, se, z, converged."""

    def fit(part: pa.RecordBatch, k: np.ndarray, s: np.ndarray, split: int) -> dict[str, np.ndarray]:
        mean, own, c0, c1, spread, prior = (part.column(c).to_numpy(zero_copy_only=False) for c in ("mean", "genewise", "c0", "c1", "spread", "prior"))
        out = {c: np.full(len(k), np.nan) for c in ("dispersion", "log2_fold_change", "se", "z")} | {"converged": np.zeros(len(k), bool)}
        some = np.isfinite(own)
        if some.any():
            k, s, own, spread, prior = k[some], s[some], own[some], spread[some], prior[some]
            centre, mu = np.log(c0[some] + c1[some] / mean[some]), _means(k, s, split)
            shrunk = highest(lambda x: likelihood(x, k, mu, split) - (x - centre) ** 2 / (2 * prior), len(k), np.log(LEAST), np.log(max(10, k.shape[1])))
            alpha = np.where(np.log(own) > centre + 2 * np.sqrt(spread), own, np.exp(shrunk))
            control, wa, fine_a = coefficients(k[:, :split], s[:, :split], alpha)
            target, wb, fine_b = coefficients(k[:, split:], s[:, split:], alpha)
            lfc, se = (target - control) / np.log(2), np.sqrt(1 / wa + 1 / wb) / np.log(2)
            for c, x in (("dispersion", alpha), ("log2_fold_change", lfc), ("se", se), ("z", lfc / se), ("converged", fine_a & fine_b)):
                out[c][some] = x
        return out

    names = [*_CONTRAST, "gene", "mean", "dispersion", "log2_fold_change", "se", "z", "converged"]
    kinds = dict(fitted.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:3]) + ", mean double, dispersion double, log2_fold_change double, se double, z double, converged boolean"
    return fitted.join(trend_of, _CONTRAST).mapInArrow(_by_layout(fit, names), schema)


def filter_cutoff(mean: np.ndarray, p: np.ndarray) -> float:
    """The least mean that a gene needs: of THETAS quantiles the one with most discoveries at ALPHA, if these are over ten."""
    fine = np.isfinite(p)
    zero = float((mean == 0).mean()) if len(mean) else 0.0
    cutoffs = np.quantile(mean, np.linspace(zero, 0.95 if zero < 0.95 else 1.0, THETAS)) if len(mean) else np.zeros(1)
    found = []
    for c in cutoffs:
        q = np.sort(p[fine & (mean >= c)])
        below = np.flatnonzero(q * len(q) <= ALPHA * np.arange(1, len(q) + 1))
        found.append(int(below[-1]) + 1 if len(below) else 0)
    return float(cutoffs[int(np.argmax(found))]) if max(found) > 10 else float(cutoffs[0])


def replicate_table(counts: DataFrame, replicates: DataFrame, grid: DataFrame, control: int, control_source: str = "real") -> DataFrame:
    """side, target, feature, log2_fold_change, p_value, p_adj, mean, dispersion of both sides; genes without counts have NaN.

    ``replicates`` names each cell's replicate; the control needs two at least.
    p_adj is NaN below the contrast's filter, as published.
    """
    require_replicates(counts, replicates, control)
    bulk = staging.written(pseudobulk(counts, replicates, control, 0 if control_source == "real" else None), "pseudobulk")
    rows = contrasts(bulk, staging.written(size_factors(bulk), "size-factors"), grid, control)
    fitted = staging.written(genewise(rows), "genewise")
    out = tested(fitted, staging.written(trends(fitted), "trends"))
    out = out.withColumn("_x", F.abs("z") / F.sqrt(F.lit(2.0)))
    out = staging.written(out.withColumn("p_value", F.when(F.isnan("z"), F.lit(float("nan"))).otherwise(F.expr(numeric.erfc_sql("_x")))).drop("_x"), "wald")

    def cutoff(table: pa.Table) -> pa.Table:
        least = filter_cutoff(table.column("mean").to_numpy(), table.column("p_value").to_numpy())
        return pa.table({"side": table.column("side")[:1], "target": table.column("target")[:1], "least": [least]})

    kinds = dict(out.dtypes)
    least = out.select(*_CONTRAST, "mean", "p_value").groupBy(*_CONTRAST).applyInArrow(cutoff, f"side {kinds['side']}, target {kinds['target']}, least double")
    out = out.join(least, _CONTRAST).withColumnRenamed("gene", "feature").withColumn("_p", F.when(F.col("mean") >= F.col("least"), F.col("p_value")).otherwise(F.lit(float("nan"))))
    out = de.benjamini_hochberg(out, "_p", _CONTRAST, ["feature"])
    return out.select(*_CONTRAST, "feature", "log2_fold_change", "p_value", "p_adj", "mean", "dispersion")


def require_replicates(counts: DataFrame, replicates: DataFrame, control: int) -> None:
    """The measured control has two replicates at least, and every cell one."""
    cells = counts.select("side", "pert", "cell").distinct().join(replicates, "cell", "left")
    n, lacking = cells.agg(F.count_distinct(F.when((F.col("pert") == control) & (F.col("side") == 0), F.col("replicate"))), F.sum(F.col("replicate").isNull().cast("int"))).first()
    if lacking:
        raise ValueError(f"{lacking} cells have no replicate")
    if n < 2:
        raise ValueError(f"the control needs two replicates at least, it has {n}")
