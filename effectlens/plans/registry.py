"""Every query of the library by name, with its SQL counterpart.

Names begin with the work item they answer: profiles (nrm, agg), differential
expression (de), expression metrics (m), agreement metrics (w), scores (sc).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import de, expression, profiles
from effectlens.plans import catalog, conventions, extended, more, oracle, replicated, stored
from effectlens.plans.evaluation import Config, of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "m11_pds_cosine"

_ITEMS = {
    "expr_mae": "m1", "expr_mse": "m2", "expr_mse_unbiased": "m3", "expr_mse_unbiased_capped": "m4", "expr_distance_unbiased": "m5", "expr_real_mass_ratio": "m6",
    "delta_mae": "m8", "delta_mse": "m9", "delta_pearson": "m10", "pds_l1": "m11", "pds_l2": "m11", "pds_cosine": "m11", "overlap": "w1", "precision": "w2", "nsig_counts_real": "w3", "nsig_counts_pred": "w3",
    "nsig_spearman": "w4", "sig_recall": "w5", "direction_match": "w6", "model_direction_match": "w7", "lfc_spearman": "w8", "lfc_nmae": "w9", "pr_auc": "w10", "roc_auc": "w11", "overlap_adjusted": "w12", "precision_adjusted": "w13",
    "sig_recall_adjusted": "w14", "sig_mcc": "w15", "sig_jaccard": "w16", "direction_precision": "w17", "direction_sensitivity": "w18", "direction_fidelity_raw": "w19", "direction_fidelity": "w20", "direction_coverage": "w21",
    "direction_yield_raw": "w22", "direction_yield": "w23", "direction_fidelity_yield": "w24", "direction_fidelity_yield_raw": "w25", "direction_reach": "w26",
}


def _item(name: str) -> str:
    short = name.removeprefix("de_wilcoxon_")
    return next(_ITEMS[short[:i]] for i in range(len(short), 0, -1) if short[:i] in _ITEMS) + "_" + short


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _metric(name: str) -> Query:
    return lambda spark, sf: catalog.metric_frame(of(spark, sf), name).select("perturbation", F.round("value", 6).alias("value"))


for _m in catalog.CATALOG.values():
    _column = "expr_real_mass" if _m.name == "expr_real_mass_ratio" else _m.column
    _register(_item(_m.name), _metric(_m.name), oracle.metric(_m.family, _column))


# ---- profiles


def _profile(column: str) -> Query:
    return lambda spark, sf: of(spark, sf).profile.select("side", "pert", "gene", F.round(column, 6).alias("value"))


for _name, _column in (("agg4_group_sums", "total"), ("agg2_group_means", "counts"), ("nrm1_normalized_means", "normalized"), ("agg3_geometric_means", "geometric"), ("agg6_lognorm_pseudobulk", "lognorm"), ("nrm5_bulk_lognorm", "bulk"), ("agg5_sumsq", "sumsq")):
    _register(_name, _profile(_column), oracle.query([oracle.CORE], f"SELECT side, pert, gene, round({_column}, 6) AS value FROM prof"))

_register("nrm3_libraries", lambda s, d: of(s, d).libs.select("side", "pert", "cell", "lib"), oracle.query([oracle.CORE], "SELECT side, pert, cell, lib FROM lib"))
_register("nrm2_target_sum", lambda s, d: profiles.target_sum(of(s, d).libs, 0), oracle.query([oracle.CORE], "SELECT median(lib) AS target_sum FROM lib WHERE side = 0 AND pert = 0 AND lib > 0"))
_register(
    "nrm9_effects", lambda s, d: profiles.effects(of(s, d).profile, "bulk", 0).select("side", "pert", "gene", F.round("e", 6).alias("effect")),
    oracle.query([oracle.CORE, oracle.EFFECT], "SELECT side, pert, gene, round(e, 6) AS effect FROM eff"),
)
_register(
    "agg7_trace", lambda s, d: profiles.traces(of(s, d).profile).select("side", "pert", F.round("trace", 4).alias("trace")),
    oracle.query([oracle.CORE], "SELECT side, pert, round((sum(sumsq) - max(n) * sum(lognorm * lognorm)) / (max(n) - 1), 4) AS trace FROM prof GROUP BY ALL"),
)
_register("agg9_jackknife", lambda s, d: of(s, d).jk.select("side", "pert", F.round("jk", 6).alias("jk")), oracle.query([oracle.CORE, oracle.JACKKNIFE], "SELECT side, pert, round(jk, 6) AS jk FROM jk"))


def _bulk_pds(metric: str, scope: str, ties: str, denominator: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        e = of(spark, sf)
        d = expression.standing(e.profile, "bulk", e.own, 0, scope)
        return expression.discrimination(d, metric, ties, denominator).select(F.col("pert").cast("string").alias("perturbation"), F.round("value", 6).alias("value"))

    return query


for _metric_name in ("l1", "l2", "cosine"):
    _register(
        f"rk5_pds_{_metric_name}_row", _bulk_pds(_metric_name, "row", "position", "n"),
        oracle.query([oracle.CORE, oracle.EFFECT, oracle.pds("row", _metric_name, "position", "n")], "SELECT CAST(target AS VARCHAR) AS perturbation, round(value, 6) AS value FROM val"),
    )


def _rk1(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    return expression.distances(e.profile, "bulk", e.own, 0, "row").select("pert", "other", *[F.round(c, 6).alias(c) for c in ("l1", "l2", "cosine")])


_register("rk1_distances", _rk1, oracle.query([oracle.CORE, oracle.EFFECT], """SELECT p.pert, r.pert AS other, round(sum(abs(p.e - r.e)), 6) AS l1, round(sqrt(sum((p.e - r.e) * (p.e - r.e))), 6) AS l2,
  round(CASE WHEN sum(p.e * p.e) * sum(r.e * r.e) > 0 THEN greatest(0, least(2, 1 - sum(p.e * r.e) / sqrt(sum(p.e * p.e) * sum(r.e * r.e)))) ELSE 1 END, 6) AS cosine
  FROM eff p JOIN eff r ON p.side = 1 AND r.side = 0 AND p.gene = r.gene WHERE p.gene <> p.pert GROUP BY ALL"""))

# ---- differential expression

_register(
    "de1_table", lambda s, d: of(s, d).de.select("side", "target", "feature", F.round("log2_fold_change", 6).alias("log2_fold_change"), F.round("p_value", 8).alias("p_value"), F.round("p_adj", 8).alias("p_adj")),
    oracle.query([oracle.CORE, oracle.DE], "SELECT side, target, feature, round(lfc, 6) AS log2_fold_change, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj FROM de"),
)


def _de5(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    return de.rank_sum(e.values, e.sizes, e.profile, 0).select("side", "pert", "gene", F.round("z", 6).alias("z"))


_register("de5_rank_sum", _de5, oracle.query([oracle.CORE, oracle.DE], "SELECT side, pert, gene, round(z, 6) AS z FROM rs"))


def _de9(spark: SparkSession, sf: str) -> DataFrame:
    rows = of(spark, sf).de.select("side", "target", "feature", "p_value")
    return de.benjamini_hochberg_wide(rows, "p_value", ["side"], ["target", "feature"]).select("side", "target", "feature", F.round("p_adj", 8).alias("p_adj"))


_register("de9_global_bh", _de9, oracle.query([oracle.CORE, oracle.DE], """SELECT side, target, feature, round(least(1.0, min(step) OVER (PARTITION BY side ORDER BY i DESC)), 8) AS p_adj FROM (
  SELECT *, p_value * count(*) OVER (PARTITION BY side) / row_number() OVER w AS step, row_number() OVER w AS i FROM de0 WINDOW w AS (PARTITION BY side ORDER BY p_value, target, feature))"""))


def _de17(spark: SparkSession, sf: str) -> DataFrame:
    return de.significance_ranks(of(spark, sf).evidence.real, 0.05)


_register("de17_ranks", _de17, oracle.query([oracle.CORE, oracle.DE], "SELECT target, feature, CAST(row_number() OVER (PARTITION BY target ORDER BY abs(lr) DESC, feature) AS INTEGER) AS rnk FROM j WHERE sr"))


def _val6(spark: SparkSession, sf: str) -> DataFrame:
    return de.gated_genes(of(spark, sf).profile, 0, 40000.0).withColumn("cpm", F.round("cpm", 4))


_register("val6_cpm_gate", _val6, oracle.query([oracle.CORE], "SELECT gene, round(normalized, 4) AS cpm, normalized > 40000 AS kept FROM prof WHERE side = 0 AND pert = 0"))

for _part in (more, conventions, replicated, stored, extended):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
