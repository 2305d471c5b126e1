"""Queries over manifests, supplied tables, published folders, thinned counts, and branches that others don't reach."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import de, profiles, validation
from effectlens.plans import artefacts, catalog, manifest, more, oracle, reference, scoring, supplied
from effectlens.plans.evaluation import Config, of
from effectlens.sources import staging, starschema, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "MACHINERY")
MEDIANS = ("expr_mae", "delta_pearson")
FLOOR, KEEP_LEVEL, SEED = 0.2, 0.25, 11


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- manifests: each market segment is a context of its own


def _artifacts(spark: SparkSession, sf: str) -> str:
    """A manifest of three contexts, written with its tables to the shared folder; its path."""
    e, root = of(spark, sf), _folder(spark, "manifest")
    cells = starschema.replicates(spark, sf)
    e.genes.write.parquet(f"{root}/genes")
    rows = []
    for segment in SEGMENTS:
        counts = e.counts.join(cells.filter(F.col("replicate") == segment).select("cell"), "cell", "left_semi")
        for side, name in ((0, "real"), (1, "pred")):
            tables.write_expression(counts.filter(F.col("side") == side).select("pert", "cell", "gene", "x"), f"{root}/{segment}/{name}")
        rows.append(("star", 1, segment, str(e.config.control), f"{segment}/real", f"{segment}/pred", "genes", None, None))
    spark.createDataFrame(rows, tables.MANIFEST).coalesce(1).write.option("header", True).csv(f"{root}/manifest.csv")
    return f"{root}/manifest.csv"


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    path = _artifacts(spark, sf)
    rows = [r.asDict() for r in tables.read_manifest(spark, path).collect()]  # a row an artifact
    values = manifest.per_perturbation(spark, [(r, lambda r=r: manifest.loaded(spark, r, Config())) for r in rows], list(more.ERRORS), _folder(spark, "artifacts"))
    return manifest.per_context(values, MEDIANS)


_SEGMENT_SQL = "ctx AS (" + " UNION ALL ".join(
    "SELECT * FROM (" + oracle.query([oracle.CORE.replace("o_custkey = c_custkey GROUP BY ALL", f"o_custkey = c_custkey WHERE c_mktsegment = '{s}' GROUP BY ALL"), oracle.EFFECT, oracle.ERRORS, more._tidy_sql("val", "tidy")], f"SELECT '{s}' AS context, * FROM tidy)") for s in SEGMENTS
) + "), per AS (SELECT context, metric, CASE WHEN metric IN ('expr_mae', 'delta_pearson') THEN median(value) ELSE avg(value) END AS value, CASE WHEN metric IN ('expr_mae', 'delta_pearson') THEN 'median' ELSE 'mean' END AS agg FROM ctx GROUP BY context, metric)"

_add("agg19_manifest_contexts", lambda s, d: _contexts(s, d).select("context", "metric", F.round("value", 6).alias("value"), "agg"), oracle.query([_SEGMENT_SQL], "SELECT context, metric, round(value, 6) AS value, agg FROM per"))
_add("snk3_manifest_overall", lambda s, d: manifest.overall(_contexts(s, d)).select("metric", F.round("value", 6).alias("value")), oracle.query([_SEGMENT_SQL], "SELECT metric, round(avg(value), 6) AS value FROM per GROUP BY metric"))

# ---- supplied tables


def _given(spark: SparkSession, sf: str, config: Config | None = None) -> supplied.Supplied:
    """Both tables of the star schema, written as someone else's files and read back from there."""
    e, root = of(spark, sf), _folder(spark, "given")
    for side, name in ((0, "real"), (1, "pred")):
        table = e.de.filter(F.col("side") == side).select("target", "feature", "log2_fold_change", "p_value", F.col("p_adj").alias("fdr"))
        table.write.parquet(f"{root}/{name}.parquet")
    return supplied.from_tables(spark, f"{root}/real.parquet", f"{root}/pred.parquet", config)


def _supplied(name: str) -> Query:
    return lambda spark, sf: supplied.evaluate(_given(spark, sf), [name]).select("perturbation", F.round("value", 6).alias("value"))


for _short in ("sig_jaccard", "lfc_nmae", "pr_auc", "direction_reach"):
    _m = catalog.CATALOG[f"de_wilcoxon_{_short}"]
    _add(f"snk2_supplied_{_short}", _supplied(_m.name), oracle.metric(_m.family, _m.column))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    s = _given(spark, sf)
    return spark.createDataFrame([(k, r["rows"], r["no_fold_change"], r["no_p_adj"]) for k, r in sorted(s.reports.items())], "name string, n long, no_fold_change long, no_p_adj long")


_add("de15_observed", _reports, oracle.query([oracle.CORE, oracle.DE], "SELECT CASE WHEN side = 0 THEN 'real' ELSE 'pred' END AS name, count(*) AS n, count(*) FILTER (lfc IS NULL OR isnan(lfc)) AS no_fold_change, count(*) FILTER (p_adj IS NULL OR isnan(p_adj)) AS no_p_adj FROM de GROUP BY side"))


def _floor(spark: SparkSession, sf: str) -> DataFrame:
    """Tables in which every seventh fold change is NaN, under the policies for those and for small effects."""
    rows = of(spark, sf).de.withColumn("log2_fold_change", F.when((F.col("target") + F.col("feature")) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("log2_fold_change")))
    return de.apply_policies(rows, "mask", FLOOR).select("side", "target", "feature", F.round("p_adj", 8).alias("p_adj"))


_add("val10_val11_policies", _floor, oracle.query([oracle.CORE, oracle.DE], f"SELECT side, target, feature, round(CASE WHEN (target + feature) % 7 = 0 OR abs(lfc) < {FLOOR} THEN 1 ELSE p_adj END, 8) AS p_adj FROM de"))


def _own(spark: SparkSession, sf: str) -> DataFrame:
    """Own genes of targets: even ones by a map, the others where they are measured."""
    rows = of(spark, sf).de.filter("side = 0")
    given = rows.select("target").distinct().filter("target % 2 = 0").select("target", (F.col("target") - 1).alias("feature"))
    return de.resolve_own(rows, given)


_add("de19_own_genes", _own, oracle.query([oracle.CORE, oracle.DE], "SELECT DISTINCT target, CAST(CASE WHEN target % 2 = 0 THEN target - 1 ELSE target END AS INTEGER) AS feature FROM de WHERE side = 0 AND (target % 2 = 0 OR target IN (SELECT feature FROM de WHERE side = 0))"))


def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = of(spark, sf).de.select("side", "target", "feature")
    return validation.duplicate_keys(rows.unionByName(rows.filter("feature % 5 = 0")))


_add("val9_duplicates", _duplicates, oracle.query([oracle.CORE, oracle.DE], "SELECT side, target, feature, 2::BIGINT AS times FROM de WHERE feature % 5 = 0"))


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """Measured genes that no measured perturbation targets; every third perturbation is held back."""
    e = of(spark, sf)
    measured = e.sizes.select("pert").distinct().filter("pert % 3 > 0")
    return validation.panel_genes(e.counts.select("gene").distinct(), e.own.join(measured, "pert", "left_semi"))


_add("val16_panel_genes", _panel, oracle.query([oracle.CORE], "SELECT DISTINCT gene FROM counts WHERE gene NOT IN (SELECT pert FROM grp WHERE pert > 0 AND pert % 3 > 0)"))

CAP = 150_000.0


def _logged_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose log-normalised values of three genes exceed a cap."""
    e = of(spark, sf, form="lognorm")
    return validation.beyond_scale_logged(e.counts.filter("gene <= 3"), CAP).select("side", "pert", "cell", F.round("highest", 8).alias("highest"), F.round("total", 4).alias("total"))


_add(
    "val3_logged_scale", _logged_scale,
    oracle.query([oracle.CORE], f"SELECT * FROM (SELECT side, pert, cell, round(max(ln(1 + v)), 8) AS highest, round(sum(v), 4) AS total FROM dense WHERE gene <= 3 AND x > 0 GROUP BY ALL) WHERE total > {CAP}"),
)


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of both sides, guessed where a half is taken from every fifth gene of the prediction."""
    counts = of(spark, sf).counts
    odd = counts.withColumn("x", F.when((F.col("side") == 1) & (F.col("gene") % 5 == 0), F.col("x") / 4).otherwise(F.col("x")))
    kinds = validation.resolved_types(profiles.libraries(odd), ("counts", "counts"), guess=True)
    return spark.createDataFrame([(s, k) for s, k in enumerate(kinds)], "side int, kind string")


_add("val4_guessed_types", _types, oracle.query([oracle.CORE], "SELECT side, CASE WHEN max(abs(t - round(t))) > 1e-6 THEN 'lognorm' ELSE 'counts' END AS kind FROM (SELECT side, cell, sum(CASE WHEN side = 1 AND gene % 5 = 0 THEN x / 4 ELSE x END) AS t FROM counts GROUP BY ALL) GROUP BY side"))

# ---- folders published whole


def _bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of the prediction against a bundle that was published, replaced and read back."""
    e, path = of(spark, sf), _folder(spark, "bundle")
    for _ in range(2):
        artefacts.write_bundle(e, list(more.ERRORS), path)
    measured, record = artefacts.read_bundle(spark, path)
    artefacts.check_submission(artefacts.record(e, list(more.ERRORS)), record)
    prediction = e.counts.filter("side = 1").select("pert", "cell", "gene", "x")
    return catalog.evaluate(reference.against(measured, prediction), list(more.ERRORS)).withColumn("value", F.round("value", 6))


_add("snk7_bundle_errors", _bundle, oracle.query(more.TIDY, "SELECT perturbation, metric, round(value, 6) AS value FROM tidy"))


def _anchor(spark: SparkSession, sf: str) -> DataFrame:
    """The anchor of the split halves as it is read back from its folder."""
    splits = staging.written(more.split_values(spark, sf), "splits")
    path = _folder(spark, "anchor")
    artefacts.write_anchor(more.references.anchor(splits), splits, path, {"seeds": list(range(more.SPLITS))})
    found = artefacts.resolve_anchor(spark, None, path, list(more.ERRORS), {"seeds": list(range(more.SPLITS))})
    return more._rounded(found, "replicate", "replicate_sd", "replicate_min", "replicate_max")


_add("snk6_anchor", _anchor, more.ORACLES["rf4_anchor"])

# ---- thinned counts


def _thinned(spark: SparkSession, sf: str) -> DataFrame:
    counts = of(spark, sf).counts.filter("gene % 5 = 1")
    return profiles.noise(counts, KEEP_LEVEL, SEED, "downsample").select("side", "pert", "cell", "gene", "x")


_add(
    "nrm11_downsample", _thinned,
    oracle.query([oracle.CORE, f"unit AS (SELECT side, pert, cell, gene, CAST('0x' || left(md5('{SEED}:' || side || ':' || cell || ':' || gene || ':' || i), 8) AS BIGINT) AS h FROM counts, unnest(range(1, CAST(x AS BIGINT) + 1)) AS r(i) WHERE gene % 5 = 1)"],
                 f"SELECT side, pert, cell, gene, CAST(count(*) AS DOUBLE) AS x FROM unit WHERE h < {int((1 - KEEP_LEVEL) * 2**32)} GROUP BY ALL"),
)

# ---- aggregates of other kinds

_add(
    "agg15_median", lambda s, d: more._rounded(scoring.aggregate(more._tidy(s, d), MEDIANS), "mean"),
    oracle.query(more.TIDY, "SELECT metric, round(CASE WHEN metric IN ('expr_mae', 'delta_pearson') THEN median(value) ELSE avg(value) END, 6) AS mean, CASE WHEN metric IN ('expr_mae', 'delta_pearson') THEN 'median' ELSE 'mean' END AS agg FROM tidy GROUP BY metric"),
)


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    name = "expr_mse_unbiased_capped_norm"
    tidy = catalog.evaluate(of(spark, sf), list(catalog.DERIVED[name]))
    return scoring.cohorts(tidy, {name: catalog.DERIVED[name]}).filter("derived")


_add(
    "agg17_derived_cohort", _derived,
    oracle.query([oracle.CORE, oracle.EFFECT, oracle.JACKKNIFE, oracle.UNBIASED], "SELECT 'expr_mse_unbiased_capped_norm' AS metric, count(*) AS n_rows, count(*) FILTER (isfinite(expr_mse_unbiased_capped) AND isfinite(expr_distance_unbiased)) AS n_used, count(*) FILTER (NOT (isfinite(expr_mse_unbiased_capped) AND isfinite(expr_distance_unbiased))) AS n_nan, 0::BIGINT AS n_null, true AS derived FROM val"),
)
