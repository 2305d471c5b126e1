"""Queries of the negative-binomial model, with SQL for its size factors and for coefficients at given dispersions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import negative_binomial as nb
from effectlens.plans import catalog, oracle
from effectlens.plans.evaluation import Config, Evaluation, of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIG = Config(de_method="deseq2")
METRICS = [f"de_deseq2_{x}" for x in ("overlap", "sig_jaccard", "lfc_spearman", "direction_match", "pr_auc")]


def _evaluation(spark: SparkSession, sf: str) -> Evaluation:
    return of(spark, sf, CONFIG)


def _bulk(e: Evaluation) -> DataFrame:
    return nb.pseudobulk(e.counts, e.replicates, e.config.control)


def _grid(e: Evaluation) -> DataFrame:
    grid = e.profile.select("side", "pert", "gene")
    control = grid.filter((F.col("pert") == e.config.control) & (F.col("side") == 0)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    return grid.filter(F.col("pert") != e.config.control).unionByName(control)


def _size_factors(spark: SparkSession, sf: str) -> DataFrame:
    return nb.size_factors(_bulk(_evaluation(spark, sf))).select("side", "pert", "replicate", F.round("size_factor", 8).alias("size_factor"))


def _coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Fold changes and standard errors at the dispersions that moments give."""
    e = _evaluation(spark, sf)
    bulk = _bulk(e)

    def fit(part: pa.RecordBatch, k: np.ndarray, s: np.ndarray, split: int) -> dict[str, np.ndarray]:
        alpha = nb.moments(k, s)
        (a, wa, fine_a), (b, wb, fine_b) = nb.coefficients(k[:, :split], s[:, :split], alpha), nb.coefficients(k[:, split:], s[:, split:], alpha)
        return {"dispersion": alpha, "log2_fold_change": (b - a) / np.log(2), "se": np.sqrt(1 / wa + 1 / wb) / np.log(2), "converged": fine_a & fine_b}

    rows = nb.contrasts(bulk, nb.size_factors(bulk), _grid(e), e.config.control)
    names = ["side", "target", "gene", "dispersion", "log2_fold_change", "se", "converged"]
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(nb._by_layout(fit, names), ", ".join(f"{c} {kinds[c]}" for c in names[:3]) + ", dispersion double, log2_fold_change double, se double, converged boolean")
    return out.select("side", "target", F.col("gene").alias("feature"), *[F.round(c, 6).alias(c) for c in ("dispersion", "log2_fold_change", "se")], "converged")


def _table(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("log2_fold_change", "p_value", "p_adj", "mean", "dispersion")
    return _evaluation(spark, sf).replicate_de.select("side", "target", "feature", *[F.round(c, 8).alias(c) for c in columns])


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.evaluate(_evaluation(spark, sf), METRICS).withColumn("value", F.round("value", 6))


SIZE_FACTORS = """
rep AS (SELECT c_custkey AS cell, c_mktsegment AS replicate FROM customer),
own AS (SELECT side, pert, replicate, gene, sum(x) AS k FROM counts JOIN rep USING (cell) GROUP BY ALL),
bulk AS (SELECT * FROM own WHERE pert > 0 UNION ALL SELECT CAST(s AS INTEGER), pert, replicate, gene, k FROM own, range(2) AS r(s) WHERE side = 0 AND pert = 0),
smp AS (SELECT DISTINCT side, pert, replicate FROM bulk),
geo AS (SELECT side, gene, sum(ln(k)) / (SELECT count(*) FROM smp WHERE smp.side = bulk.side) AS g FROM bulk WHERE k > 0 GROUP BY side, gene),
med AS (SELECT side, pert, replicate, median(ln(k) - g) AS m FROM bulk JOIN geo USING (side, gene) WHERE k > 0 GROUP BY ALL),
sf AS (SELECT side, pert, replicate, exp(m - avg(m) OVER (PARTITION BY side)) AS size_factor FROM med)
"""
#: The score of a group's mean falls with the mean: its root is found by halving, not by least squares.
COEFFICIENTS = """
gn AS (SELECT CAST(g AS INTEGER) AS gene FROM range(1, 26) AS r(g)),
den AS (SELECT side, pert, gene, replicate, coalesce(k, 0) AS k, size_factor AS s FROM sf CROSS JOIN gn LEFT JOIN bulk USING (side, pert, replicate, gene)),
con AS (SELECT t.side, t.pert AS target, d.gene, d.pert = 0 AS ctl, d.k, d.s FROM (SELECT DISTINCT side, pert FROM smp WHERE pert > 0) t JOIN den d ON d.side = t.side AND d.pert IN (0, t.pert)),
mom AS (SELECT side, target, gene, CASE WHEN avg(k / s) > 0 THEN greatest((var_samp(k / s) - avg(k / s) * avg(1 / s)) / (avg(k / s) * avg(k / s)), 1e-8) ELSE 1e-8 END AS alpha FROM con GROUP BY ALL),
grpd AS (SELECT side, target, gene, ctl, alpha, list(k) AS ks, list(s) AS ss FROM con JOIN mom USING (side, target, gene) GROUP BY ALL),
halved AS (
  SELECT side, target, gene, ctl, alpha, ks, ss, -5.0::DOUBLE AS lo, 25.0::DOUBLE AS hi, 0 AS i FROM grpd
  UNION ALL
  SELECT side, target, gene, ctl, alpha, ks, ss, CASE WHEN up > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (
    SELECT *, list_sum(list_transform(list_zip(ks, ss), lambda x: (x[1] - x[2] * exp((lo + hi) / 2)) / (1 + alpha * x[2] * exp((lo + hi) / 2)))) AS up FROM halved WHERE i < 70)),
root AS (SELECT side, target, gene, ctl, alpha, (lo + hi) / 2 AS b, list_sum(list_transform(ss, lambda s: s * exp((lo + hi) / 2) / (1 + alpha * s * exp((lo + hi) / 2)))) AS w FROM halved WHERE i = 70)
"""

QUERIES |= {"de13_size_factors": _size_factors, "de13_coefficients": _coefficients, "de13_table": _table, "de13_metrics": _metrics}
ORACLES["de13_size_factors"] = oracle.query([oracle.CORE, SIZE_FACTORS], "SELECT side, pert, replicate, round(size_factor, 8) AS size_factor FROM sf")
ORACLES["de13_coefficients"] = oracle.query([oracle.CORE, SIZE_FACTORS, COEFFICIENTS], """SELECT t.side, t.target, t.gene AS feature, round(t.alpha, 6) AS dispersion, round((t.b - c.b) / ln(2), 6) AS log2_fold_change, round(sqrt(1 / t.w + 1 / c.w) / ln(2), 6) AS se, true AS converged
  FROM root t JOIN root c USING (side, target, gene) WHERE NOT t.ctl AND c.ctl""").replace("WITH ", "WITH RECURSIVE ", 1)
