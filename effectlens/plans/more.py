"""Queries beyond single metrics: aggregates, scores, baselines, references, pieces, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import baseline, expression, profiles, references, validation
from effectlens.plans import anchoring, catalog, oracle, scoring
from effectlens.plans.evaluation import of
from effectlens.sources import staging
from effectlens.streaming import pieces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ERRORS = ("expr_mae", "expr_mse", "delta_mae", "delta_mse", "delta_pearson")
SEED, SPLITS = 7, 5


def _add(name: str, query: Query, parts: list[str], select: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = oracle.query(parts, select)


def _unpivot(frame: DataFrame) -> DataFrame:
    """perturbation, metric, value of a frame of errors."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ERRORS]))
    return frame.select(F.col("pert").cast("string").alias("perturbation"), cells.alias("x")).select("perturbation", "x.metric", "x.value")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _tidy(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.evaluate(of(spark, sf), list(ERRORS))


def _tidy_sql(source: str, name: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT CAST(target AS VARCHAR) AS perturbation, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {source}" for c in ERRORS) + ")"


TIDY = [oracle.CORE, oracle.EFFECT, oracle.ERRORS, _tidy_sql("val", "tidy")]

# ---- aggregates

_add("agg1_groups", lambda s, d: of(s, d).sizes.select("side", "pert", "n"), [oracle.CORE], "SELECT side, pert, n FROM grp")
_add("ux1_tidy", lambda s, d: _rounded(_tidy(s, d), "value"), TIDY, "SELECT perturbation, metric, round(value, 6) AS value FROM tidy")
_add("agg15_aggregate", lambda s, d: _rounded(scoring.aggregate(_tidy(s, d)), "mean"), TIDY, "SELECT metric, round(avg(value), 6) AS mean, 'mean' AS agg FROM tidy GROUP BY metric")
_add(
    "agg16_statistics", lambda s, d: _rounded(scoring.statistics(_tidy(s, d)), "mean", "std", "min", "max", "median"), TIDY,
    "SELECT metric, count(*) AS count, count(*) FILTER (value IS NULL) AS null_count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median FROM tidy GROUP BY metric",
)
_add(
    "agg17_cohorts", lambda s, d: scoring.cohorts(_tidy(s, d)), TIDY,
    "SELECT metric, count(*) AS n_rows, count(*) FILTER (NOT isnan(value)) AS n_used, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (value IS NULL) AS n_null, false AS derived FROM tidy GROUP BY metric",
)


def _m7(spark: SparkSession, sf: str) -> DataFrame:
    name = "expr_mse_unbiased_capped_norm"
    tidy = catalog.evaluate(of(spark, sf), list(catalog.DERIVED[name]))
    return _rounded(scoring.ratio_of_sums(tidy, *catalog.DERIVED[name], name), "value")


_add(
    "m7_expr_mse_unbiased_capped_norm", _m7, [oracle.CORE, oracle.EFFECT, oracle.JACKKNIFE, oracle.UNBIASED],
    "SELECT 'expr_mse_unbiased_capped_norm' AS metric, round(CASE WHEN sum(expr_distance_unbiased) > 0 THEN sum(expr_mse_unbiased_capped) / sum(expr_distance_unbiased) ELSE 'nan' END, 6) AS value FROM val",
)


def _agg19(spark: SparkSession, sf: str) -> DataFrame:
    tidy = _tidy(spark, sf).withColumn("context", (F.col("perturbation").cast("int") % 3).cast("string"))
    return _rounded(scoring.hierarchy(tidy), "value")


_add(
    "agg19_contexts", _agg19, [*TIDY, "per AS (SELECT CAST(CAST(perturbation AS INTEGER) % 3 AS VARCHAR) AS context, metric, avg(value) AS value FROM tidy GROUP BY ALL)"],
    "SELECT context, metric, round(value, 6) AS value FROM per UNION ALL SELECT 'overall', metric, round(avg(value), 6) FROM per GROUP BY metric",
)


def _so6(spark: SparkSession, sf: str) -> DataFrame:
    wide = _tidy(spark, sf).groupBy("perturbation").pivot("metric", list(ERRORS)).agg(F.first("value"))
    return _rounded(wide, *ERRORS)


_add("so6_wide", _so6, [oracle.CORE, oracle.EFFECT, oracle.ERRORS], "SELECT CAST(target AS VARCHAR) AS perturbation, " + ", ".join(f"round({c}, 6) AS {c}" for c in ERRORS) + " FROM val")

# ---- baseline and scores

GENERIC = "gen AS (SELECT gene, avg(bulk) AS g, avg(normalized) AS gn FROM prof WHERE side = 0 AND pert > 0 AND pert <> gene GROUP BY gene)"
TILED = [
    GENERIC, "btwo AS (SELECT r.pert, r.gene, g AS p, r.m AS r, r.c AS c FROM eff r JOIN gen USING (gene) WHERE r.side = 0)",
    oracle.ERRORS.replace("val AS", "bval AS").replace("FROM two", "FROM btwo"), _tidy_sql("bval", "btidy"),
    "u AS (SELECT metric, avg(value) AS u FROM tidy GROUP BY metric)", "b AS (SELECT metric, avg(value) AS b FROM btidy GROUP BY metric)",
]


def _generic(spark: SparkSession, sf: str, value: str) -> DataFrame:
    e = of(spark, sf)
    return baseline.generic_response(e.profile, e.own, e.config.control, value)


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the generic response scored as a prediction."""
    e = of(spark, sf)
    flat = baseline.tiled(e.profile, _generic(spark, sf, "bulk"), e.config.control, "bulk")
    return scoring.aggregate(_unpivot(expression.errors(flat, "bulk", e.config.control)))


def _scale(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    return baseline.emission_scale(e.profile, _generic(spark, sf, "normalized"), e.config.control, "normalized")


SCALE = "scale AS (SELECT gene, CASE WHEN c.normalized > 0 THEN coalesce(gn, 0) / c.normalized ELSE 0 END AS ratio FROM prof c LEFT JOIN gen USING (gene) WHERE c.side = 0 AND c.pert = 0)"
HEX = "CAST('0x' || left(md5({}), 8) AS BIGINT)"

_add("bl1_generic_response", lambda s, d: _rounded(_generic(s, d, "bulk"), "g"), [oracle.CORE, GENERIC], "SELECT gene, round(g, 6) AS g FROM gen")
_add("nrm10_emission_scale", lambda s, d: _rounded(_scale(s, d), "ratio"), [oracle.CORE, GENERIC, SCALE], "SELECT gene, round(ratio, 6) AS ratio FROM scale")


def _bl3(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    flat = baseline.tiled(e.profile, _generic(spark, sf, "bulk"), e.config.control, "bulk")
    return flat.filter("side = 1").select("pert", "gene", F.round("bulk", 6).alias("value"))


_add(
    "bl3_tile", _bl3, [oracle.CORE, GENERIC],
    "SELECT pert, gene, round(g, 6) AS value FROM prof JOIN gen USING (gene) WHERE side = 0 AND pert > 0 UNION ALL SELECT pert, gene, round(bulk, 6) FROM prof WHERE side = 0 AND pert = 0",
)


def _bl2(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    return _rounded(baseline.dispersed(e.counts, e.libs, _scale(spark, sf), e.config.control, SEED), "x")


DISPERSED = [
    f"pool AS (SELECT cell AS source, row_number() OVER (ORDER BY {HEX.format('CAST(cell AS VARCHAR)')} % 64, cell) - 1 AS i FROM lib WHERE side = 0 AND pert = 0)",
    f"slot AS (SELECT pert, cell, {HEX.format(repr(str(SEED) + ':') + ' || pert || ' + repr(':') + ' || cell')} % (SELECT count(*) FROM pool) AS i FROM lib WHERE side = 0 AND pert > 0)",
]
DISPERSED_ROWS = """SELECT CAST(1 AS INTEGER) AS side, slot.pert, slot.cell, k.gene, k.x * ratio AS x FROM slot JOIN pool USING (i) JOIN counts k ON k.side = 0 AND k.pert = 0 AND k.cell = source JOIN scale ON scale.gene = k.gene WHERE k.x * ratio <> 0
  UNION ALL SELECT 1, pert, cell, gene, x FROM counts WHERE side = 0 AND pert = 0"""
_add("bl2_dispersed", _bl2, [oracle.CORE, GENERIC, SCALE, *DISPERSED], f"SELECT side, pert, cell, gene, round(x, 6) AS x FROM ({DISPERSED_ROWS})")


def _sc6(spark: SparkSession, sf: str) -> DataFrame:
    policies = {n: catalog.CATALOG[n].policy for n in ERRORS}
    return _rounded(scoring.score(scoring.aggregate(_tidy(spark, sf)), _baseline(spark, sf), policies), "from_baseline")


_add(
    "sc6_score", _sc6,
    [
        *TIDY, *TILED,
        """sx AS (SELECT metric, CASE WHEN metric = 'delta_pearson' THEN CASE WHEN 1 - b > 0 THEN greatest(0, least(1, (u - b) / (1 - b))) END
    WHEN b > 0 THEN least(1, CASE WHEN u > b THEN greatest(-6, -((u / b) * (u / b) - 1) / 2) ELSE 1 - u / b END) END AS s FROM u JOIN b USING (metric))""",
    ],
    "SELECT metric, round(s, 6) AS from_baseline FROM sx WHERE s IS NOT NULL UNION ALL SELECT 'avg_score', round(avg(s), 6) FROM sx",
)


def _sc13(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scoring.legacy_score(scoring.aggregate(_tidy(spark, sf)), _baseline(spark, sf), ERRORS[:4]), "score")


_add(
    "sc13_legacy_score", _sc13, [*TIDY, *TILED],
    "SELECT metric, round(greatest(0, coalesce(CASE WHEN metric = 'delta_pearson' THEN (u - b) / nullif(1 - b, 0) ELSE 1 - u / nullif(b, 0) END, 0)), 6) AS score FROM u JOIN b USING (metric)",
)

# ---- references


def _half_sql(seed: int) -> str:
    return f"""
h0 AS (SELECT pert, cell, CASE WHEN r <= h THEN 0 ELSE 1 END AS half FROM (
    SELECT pert, cell, row_number() OVER (PARTITION BY pert ORDER BY md5('{seed}:' || cell), cell) AS r, count(*) OVER (PARTITION BY pert) // 2 AS h FROM lib WHERE side = 0) WHERE h >= 1 AND r <= 2 * h),
hp AS (SELECT half, pert, gene, ln(1 + 5e4 * sum(x) / sum(sum(x)) OVER (PARTITION BY half, pert)) AS bulk, avg(v) AS m
  FROM dense JOIN h0 USING (pert, cell) WHERE side = 0 GROUP BY half, pert, gene),
hc AS (SELECT t.half, t.pert, t.gene, t.bulk, t.m, c.bulk AS c, c.m AS cm FROM hp t JOIN hp c ON c.half = t.half AND c.pert = 0 AND c.gene = t.gene WHERE t.pert > 0)
"""


#: errors of half 1 against half 0, each with its own control
_HALF_ERRORS = """
hv AS (SELECT p.pert AS target, avg(abs(p.bulk - r.bulk)) AS expr_mae, avg((p.bulk - r.bulk) ** 2) AS expr_mse, avg(abs((p.bulk - p.c) - (r.bulk - r.c))) AS delta_mae, avg(((p.bulk - p.c) - (r.bulk - r.c)) ** 2) AS delta_mse,
  CASE WHEN count(*) ** 2 * var_pop(p.bulk - p.c) > 1e-12 AND count(*) ** 2 * var_pop(r.bulk - r.c) > 1e-12 THEN corr(p.bulk - p.c, r.bulk - r.c) ELSE -1 END AS delta_pearson
  FROM hc p JOIN hc r ON p.half = 1 AND r.half = 0 AND p.pert = r.pert AND p.gene = r.gene GROUP BY p.pert)
"""


def _half_profile(spark: SparkSession, sf: str, seed: int) -> DataFrame:
    e = of(spark, sf)
    counts = references.split(e.counts, e.libs, seed, e.config.control)
    libs = profiles.libraries(counts)
    values = profiles.normalized(counts, libs, e.config.target_sum)
    return profiles.profiles(values, profiles.group_sizes(libs), e.genes, e.config.bulk_target_sum)


def _half_errors(spark: SparkSession, sf: str, seed: int) -> DataFrame:
    return _unpivot(expression.errors(_half_profile(spark, sf, seed), "bulk", of(spark, sf).config.control, "pred"))


_add(
    "rf1_halves", lambda s, d: profiles.halves(of(s, d).libs.filter("side = 0"), SEED).select("pert", "cell", "half"),
    [oracle.CORE, _half_sql(SEED)], "SELECT pert, cell, CAST(half AS INTEGER) AS half FROM h0",
)
_add(
    "rf2_ceiling", lambda s, d: _rounded(references.ceiling(_half_errors(s, d, SEED).filter("metric = 'delta_pearson'")), "value"),
    [oracle.CORE, _half_sql(SEED), _HALF_ERRORS],
    "SELECT CAST(target AS VARCHAR) AS perturbation, 'delta_pearson' AS metric, round(CASE WHEN delta_pearson > 0 THEN 2 * delta_pearson / (1 + delta_pearson) ELSE 'nan' END, 6) AS value FROM hv",
)


def _rf3(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    halves = staging.written(references.fold_changes(_half_profile(spark, sf, SEED), e.config.control, e.config.epsilon), "half-folds")
    return _rounded(references.nmae_reference(e.de.filter("side = 0"), halves, e.own, e.config.p_adj_threshold), "raw", "scaled")


_add(
    "rf3_lfc_nmae_reference", _rf3, [oracle.CORE, oracle.DE, _half_sql(SEED), "hf AS (SELECT half, pert AS target, gene AS feature, log2((m + 1e-9) / (cm + 1e-9)) AS lfc FROM hc)"],
    """SELECT target, round(raw, 6) AS raw, round(raw / sqrt(2), 6) AS scaled FROM (
  SELECT d.target, avg(abs(a.lfc - b.lfc)) / avg(abs(d.lfc)) AS raw FROM de d JOIN hf a ON a.half = 0 AND a.target = d.target AND a.feature = d.feature JOIN hf b ON b.half = 1 AND b.target = d.target AND b.feature = d.feature
  WHERE d.side = 0 AND d.p_adj < 0.05 AND d.target <> d.feature GROUP BY d.target HAVING count(*) >= 10 AND avg(abs(d.lfc)) > 0)""",
)


def split_values(spark: SparkSession, sf: str) -> DataFrame:
    """split_index, metric, value of half against half, for each split."""
    return anchoring.split_values(of(spark, sf), list(ERRORS), 0, SPLITS, whole=False).select("split_index", "metric", "value")


def _rf4(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(references.anchor(split_values(spark, sf)), "replicate", "replicate_sd", "replicate_min", "replicate_max")


_add(
    "rf4_anchor", _rf4,
    [oracle.CORE, "sp AS (" + " UNION ALL ".join(f"SELECT * FROM (WITH {_half_sql(i)}, {_HALF_ERRORS}, {_tidy_sql('hv', 'ht')} SELECT metric, avg(value) AS value FROM ht GROUP BY metric)" for i in range(SPLITS)) + ")"],
    "SELECT metric, round(avg(value), 6) AS replicate, round(stddev_pop(value), 6) AS replicate_sd, round(min(value), 6) AS replicate_min, round(max(value), 6) AS replicate_max FROM sp GROUP BY metric",
)


def _rf4_members(spark: SparkSession, sf: str) -> DataFrame:
    """The anchor with the error of fold changes, whose gate is that of the full table."""
    values = anchoring.split_values(of(spark, sf), [*ERRORS, "de_wilcoxon_lfc_nmae"], 0, SPLITS, whole=False)
    return _rounded(anchoring.anchor(values), "replicate", "replicate_sd", "replicate_min", "replicate_max")


def _split_sql(seed: int) -> str:
    """Values of one split, those of fold changes among them."""
    return f"""SELECT * FROM (WITH {_half_sql(seed)}, {_HALF_ERRORS}, {_tidy_sql('hv', 'ht')},
  hf AS (SELECT half, pert AS target, gene AS feature, log2((m + 1e-9) / (cm + 1e-9)) AS lfc FROM hc),
  raw AS (SELECT d.target, avg(abs(a.lfc - b.lfc)) / avg(abs(d.lfc)) AS raw FROM de d JOIN hf a ON a.half = 0 AND a.target = d.target AND a.feature = d.feature JOIN hf b ON b.half = 1 AND b.target = d.target AND b.feature = d.feature
    WHERE d.side = 0 AND d.p_adj < 0.05 AND d.target <> d.feature GROUP BY d.target HAVING count(*) >= 10 AND avg(abs(d.lfc)) > 0)
  SELECT metric, avg(value) AS value, count(*) AS n, 'split_half' AS estimator FROM ht GROUP BY metric UNION ALL SELECT 'de_wilcoxon_lfc_nmae', avg(raw), count(*), 'full_gate' FROM raw HAVING count(*) > 0)"""


_add(
    "rf4_anchor_members", _rf4_members, [oracle.CORE, oracle.DE, "sp AS (" + " UNION ALL ".join(_split_sql(i) for i in range(SPLITS)) + ")"],
    """SELECT metric, round(avg(value), 6) AS replicate, round(stddev_pop(value), 6) AS replicate_sd, round(min(value), 6) AS replicate_min, round(max(value), 6) AS replicate_max,
  min(n) AS n_perturbations_min, max(n) AS n_perturbations_max, estimator FROM sp GROUP BY metric, estimator""",
)

# ---- pieces


def _st5(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    perts = e.sizes.filter((F.col("side") == 1) & (F.col("pert") != e.config.control)).select("pert")
    real, pred = (e.counts.filter(F.col("side") == s).select("pert", "cell", "gene", "x") for s in (0, 1))
    partials = None
    for i in range(2):
        piece = pred.join(pieces.subset(perts, 2, i), "pert", "left_semi")
        part = pieces.score_piece(real, piece, e.genes, e.own, list(ERRORS), e.config)
        partials = part if partials is None else partials.unionByName(part)
    return _rounded(pieces.merge(partials, perts), "value")


_add("st5_merged_pieces", _st5, TIDY, "SELECT perturbation, metric, round(value, 6) AS value FROM tidy")
_add(
    "st6_merged_nsig_spearman",
    lambda s, d: _rounded(pieces.nsig_from_counts(catalog.evaluate(of(s, d), ["de_wilcoxon_nsig_counts_real", "de_wilcoxon_nsig_counts_pred"])), "value"),
    [oracle.CORE, oracle.DE, oracle.NSIG], "SELECT 'de_wilcoxon_nsig_spearman' AS metric, round(nsig_spearman, 6) AS value FROM rho",
)
_add(
    "so8_subset", lambda s, d: pieces.subset(of(s, d).sizes.filter("pert <> 0"), 3, 1), [oracle.CORE],
    "SELECT pert FROM (SELECT pert, row_number() OVER (ORDER BY pert) - 1 AS i FROM (SELECT DISTINCT pert FROM grp WHERE pert <> 0)) WHERE i % 3 = 1",
)

# ---- checks

_add(
    "val2_values", lambda s, d: validation.profile_of_values(of(s, d).counts), [oracle.CORE],
    "SELECT side, count(*) AS n, min(x) AS lowest, max(x) AS highest, max(abs(x - round(x))) AS fraction, count(*) FILTER (isnan(x)) AS n_nan FROM counts GROUP BY side",
)
_add("val3_beyond_scale", lambda s, d: validation.beyond_scale(of(s, d).libs, 900.0), [oracle.CORE], "SELECT side, pert, cell, lib FROM lib WHERE lib > 900 OR isnan(lib)")
_add("val5_input_type", lambda s, d: validation.guess_type(of(s, d).libs), [oracle.CORE], "SELECT side, CASE WHEN max(abs(lib - round(lib))) > 1e-6 THEN 'lognorm' ELSE 'counts' END AS kind FROM lib GROUP BY side")


def _val14(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf).evidence
    return validation.uncovered(e.real, e.pred.filter(F.col("feature") % 4 != 0))


_add("val14_uncovered", _val14, [oracle.CORE, oracle.DE], "SELECT target, count(*) FILTER (feature % 4 = 0 OR NOT tp) AS n_missing, count(*) AS n_real FROM j WHERE sr GROUP BY target")
_add(
    "val12_without_own", lambda s, d: validation.without_own(of(s, d).de, of(s, d).own).select("side", "target", "feature"), [oracle.CORE, oracle.DE],
    "SELECT side, target, feature FROM de WHERE target <> feature",
)
