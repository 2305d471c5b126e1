"""Queries for other conventions: version 1, log-normalised input, worst values, a wide gene axis, and scales of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import agreement, expression, references
from effectlens.plans import baselines, catalog, more, oracle, scoring
from effectlens.plans.evaluation import Config, of

QUERIES: dict[str, more.Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: more.Query, parts: list[str], select: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = oracle.query(parts, select)


def _other(text: str, *pairs: tuple[str, str]) -> str:
    """SQL with parts exchanged; each must be there."""
    for old, new in pairs:
        if old not in text:
            raise ValueError(f"no {old!r} in the SQL")
        text = text.replace(old, new)
    return text


PERT = "CAST(target AS VARCHAR) AS perturbation"

# ---- version 1

V1_DE = _other(
    oracle.DE,
    ("ctrl AS (SELECT gene, cell, v FROM dense WHERE side = 0 AND pert = 0)", "ctrl AS (SELECT side, gene, cell, v FROM dense WHERE pert = 0)"),
    ("JOIN ctrl c ON t.gene = c.gene WHERE", "JOIN ctrl c ON t.gene = c.gene AND t.side = c.side WHERE"),
    ("FROM grp g, ctrl c WHERE g.pert > 0", "FROM grp g, ctrl c WHERE g.pert > 0 AND g.side = c.side"),
    ("JOIN grp k ON k.side = 0 AND k.pert = 0", "JOIN grp k ON k.side = p.side AND k.pert = 0"),
    ("log2((p.normalized + 1e-9) / (c.normalized + 1e-9)) AS lfc", "log2(CASE WHEN p.geometric = 0 AND c.geometric = 0 THEN 1 WHEN c.geometric = 0 THEN 20 WHEN p.geometric = 0 THEN 1 / 20.0 ELSE p.geometric / c.geometric END) AS lfc"),
    ("JOIN prof c ON c.side = 0 AND c.pert = 0 AND c.gene = p.gene AND c.normalized > 5", "JOIN prof c ON c.side = p.side AND c.pert = 0 AND c.gene = p.gene"),
    ("OVER (PARTITION BY side, target ORDER BY i DESC)", "OVER (PARTITION BY side ORDER BY i DESC)"),
    ("count(*) OVER (PARTITION BY side, target)", "count(*) OVER (PARTITION BY side)"),
    ("w AS (PARTITION BY side, target ORDER BY p_value, feature)", "w AS (PARTITION BY side ORDER BY p_value, target, feature)"),
)
#: version 1 keeps single precision of p-values under the curves
V1_AREAS = _other(oracle.AREAS, ("greatest(coalesce(pp, 1), low) AS p", "CAST(CAST(CASE WHEN coalesce(pp, 1) = 0 THEN 1e-10 ELSE coalesce(pp, 1) END AS FLOAT) AS DOUBLE) AS p"))
CLIP_AREAS = _other(oracle.AREAS, ("greatest(coalesce(pp, 1), low) AS p", "greatest(coalesce(pp, 1), 1e-10) AS p"))


def _v1_de(spark: SparkSession, sf: str) -> DataFrame:
    rows = of(spark, sf, Config.v1()).de
    return rows.select("side", "target", "feature", F.round("log2_fold_change", 6).alias("log2_fold_change"), F.round("p_value", 8).alias("p_value"), F.round("p_adj", 8).alias("p_adj"))


_add("de3_version1_table", _v1_de, [oracle.CORE, V1_DE], "SELECT side, target, feature, round(lfc, 6) AS log2_fold_change, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj FROM de")
for _column in ("pr_auc", "roc_auc"):
    _add(
        f"w10_version1_{_column}", lambda s, d, c=_column: more._rounded(catalog.metric_frame(of(s, d, Config.v1()), f"de_wilcoxon_{c}").select("perturbation", "value"), "value"),
        [oracle.CORE, V1_DE, V1_AREAS], f"SELECT {PERT}, round({_column}, 6) AS value FROM val",
    )
    _add(
        f"w10_clipped_{_column}", lambda s, d, c=_column: agreement.area_metrics(of(s, d).evidence, "clip").select(F.col("target").cast("string").alias("perturbation"), F.round(c, 6).alias("value")),
        [oracle.CORE, oracle.DE, CLIP_AREAS], f"SELECT {PERT}, round({_column}, 6) AS value FROM val",
    )
for _column, _parts in (("sig_recall", [oracle.SETS]), ("direction_match", [oracle.SIGNS])):
    _add(
        f"w5_version1_{_column}", lambda s, d, c=_column: more._rounded(catalog.metric_frame(of(s, d, Config.v1()), f"de_wilcoxon_{c}").select("perturbation", "value"), "value"),
        [oracle.CORE, V1_DE, *_parts], f"SELECT {PERT}, round(CAST({_column} AS DOUBLE), 6) AS value FROM val",
    )

OWN_CONTROL = """
own_eff AS (SELECT p.side, p.pert, p.gene, p.lognorm AS m, c.lognorm AS c FROM prof p JOIN prof c ON c.side = p.side AND c.pert = 0 AND c.gene = p.gene WHERE p.pert > 0),
val AS (SELECT p.pert AS target, avg(abs((p.m - p.c) - (r.m - r.c))) AS delta_mae, avg(((p.m - p.c) - (r.m - r.c)) ** 2) AS delta_mse
  FROM own_eff p JOIN own_eff r ON p.side = 1 AND r.side = 0 AND p.pert = r.pert AND p.gene = r.gene GROUP BY p.pert)
"""
for _column, _item in (("delta_mae", "m8"), ("delta_mse", "m9")):
    _add(
        f"{_item}_version1_{_column}", lambda s, d, c=_column: more._rounded(catalog.metric_frame(of(s, d, Config.v1()), c).select("perturbation", "value"), "value"),
        [oracle.CORE, OWN_CONTROL], f"SELECT {PERT}, round({_column}, 6) AS value FROM val",
    )

# ---- log-normalised input, and the comparator that follows from it

LOGNORM = Config(input_types=("lognorm", "lognorm"))
LOG_EFFECT = _other(oracle.EFFECT, ("p.bulk", "p.lognorm"), ("c.bulk", "c.lognorm"))


def _lognorm(spark: SparkSession, sf: str):
    return of(spark, sf, LOGNORM, form="lognorm")


for _column in ("expr_mae", "expr_mse", "delta_pearson"):
    _add(
        f"nrm6_lognorm_{_column}", lambda s, d, c=_column: more._rounded(catalog.metric_frame(_lognorm(s, d), c).select("perturbation", "value"), "value"),
        [oracle.CORE, LOG_EFFECT, oracle.ERRORS], f"SELECT {PERT}, round({_column}, 6) AS value FROM val",
    )
_add(
    "m6_lognorm_mass_ratio", lambda s, d: more._rounded(catalog.metric_frame(_lognorm(s, d), "expr_real_mass_ratio").select("perturbation", "value"), "value"),
    [oracle.CORE, LOG_EFFECT, _other(oracle.ERRORS, ("/ 5e4", "/ 1e6"))], f"SELECT {PERT}, round(expr_real_mass, 6) AS value FROM val",
)
_add(
    "agg8_trace_over_n", lambda s, d: more._rounded(_lognorm(s, d).correction, "jk", digits=4), [oracle.CORE],
    "SELECT side, pert, round((sum(sumsq) - max(n) * sum(lognorm * lognorm)) / (max(n) - 1) / max(n), 4) AS jk FROM prof GROUP BY ALL",
)


def _nrm4(spark: SparkSession, sf: str) -> DataFrame:
    return more._rounded(_lognorm(spark, sf).profile.select("side", "pert", "gene", F.col("normalized").alias("value")), "value", digits=4)


_add("nrm4_linear_from_lognorm", _nrm4, [oracle.CORE], "SELECT side, pert, gene, round(normalized, 4) AS value FROM prof")

# ---- no metric drops a perturbation

STRICT = Config(p_adj_threshold=1e-13)
STRICT_DE = _other(oracle.DE, ("r.p_adj < 0.05", "r.p_adj < 1e-13"), ("p.p_adj < 0.05", "p.p_adj < 1e-13"))
for _column, _parts in (("lfc_spearman", oracle.SPEARMAN["lfc_spearman"]), ("lfc_spearman_neg", oracle.SPEARMAN["lfc_spearman_neg"]), ("direction_precision", oracle.DIRECTION), ("direction_match", oracle.SIGNS)):
    _worst = catalog.CATALOG[f"de_wilcoxon_{_column}"].worst
    _add(
        f"w8_no_drop_{_column}", lambda s, d, c=_column: more._rounded(catalog.metric_frame(of(s, d, STRICT), f"de_wilcoxon_{c}").select("perturbation", "value"), "value"),
        [oracle.CORE, STRICT_DE, _parts],
        f"SELECT CAST(t.target AS VARCHAR) AS perturbation, round(CASE WHEN v.x IS NULL OR isnan(v.x) THEN {_worst} ELSE v.x END, 6) AS value FROM targets t LEFT JOIN (SELECT target, CAST({_column} AS DOUBLE) AS x FROM val) v USING (target)",
    )

# ---- a thousand genes, so that every top-k cuts

WIDE_CORE = _other(oracle.CORE, ("CAST(replace(p_brand, 'Brand#', '') AS INTEGER)", "CAST(l_partkey % 1000 + 1 AS INTEGER)"), ("range(1, 26)", "range(1, 1001)"))
for _kind, _k in (("overlap", 50), ("overlap", 100), ("overlap", 200), ("overlap", 500), ("precision", 100), ("precision", 500)):
    _add(
        f"{'w1' if _kind == 'overlap' else 'w2'}_wide_{_kind}_top{_k}",
        lambda s, d, c=f"{_kind}_top{_k}": more._rounded(catalog.metric_frame(of(s, d, axis="part"), f"de_wilcoxon_{c}").select("perturbation", "value"), "value"),
        [WIDE_CORE, oracle.DE, oracle.top(_kind, _k)], f"SELECT {PERT}, round(CAST(value AS DOUBLE), 6) AS value FROM val",
    )

# ---- budgets of the whole panel


def _m4b(spark: SparkSession, sf: str) -> DataFrame:
    """Perturbations of odd number, by the budget of all."""
    e = of(spark, sf)
    odd = (F.col("pert") % 2 == 1) | (F.col("pert") == e.config.control)
    budget = expression.correction_budget(e.profile, e.jk, e.own, e.config.control)
    part = expression.unbiased(e.profile.filter(odd), e.jk.filter(odd), e.own, e.config.control, budget=budget)
    return part.select(F.col("pert").cast("string").alias("perturbation"), F.round("expr_mse_unbiased_capped", 6).alias("value"))


_add("m4b_panel_budget", _m4b, [oracle.CORE, oracle.EFFECT, oracle.JACKKNIFE, oracle.UNBIASED], f"SELECT {PERT}, round(expr_mse_unbiased_capped, 6) AS value FROM val WHERE target % 2 = 1")

# ---- scales of scores

ON_SCALE = list(scoring.SCALES["low-random_high-1_v10"].entries)


def _means_sql() -> str:
    """metric, u of every metric on the scale."""
    out = []
    for n in ON_SCALE:
        if n in catalog.DERIVED:
            inner = oracle.query([oracle.CORE, oracle.EFFECT, oracle.JACKKNIFE, oracle.UNBIASED], "SELECT sum(expr_mse_unbiased_capped) / sum(expr_distance_unbiased) AS u FROM val")
            out.append(f"SELECT '{n}' AS metric, u FROM ({inner})")
        else:
            m = catalog.CATALOG[n]
            inner = oracle.metric(m.family, m.column)
            out.append(f"SELECT '{n}' AS metric, avg(value) AS u FROM ({inner}) WHERE NOT isnan(value)")
    return "u AS (" + " UNION ALL ".join(out) + ")"


def _sc8(spark: SparkSession, sf: str) -> DataFrame:
    e = of(spark, sf)
    means = catalog.summarize(catalog.evaluate(e, ON_SCALE), ON_SCALE)
    return more._rounded(scoring.scale_column(means, "low-random_high-1_v10"), "low-random_high-1_v10", digits=4)


def _case(entries: dict) -> str:
    cells = []
    for n, (base, p) in entries.items():
        s = f"(u - {base}) / ({p.anchor} - {base})" if p.higher else f"({base} - u) / ({base} - {p.anchor})"
        cells.append(f"WHEN metric = '{n}' THEN least(1, greatest({p.low}, {s}))")
    return "CASE " + " ".join(cells) + " END"


_add(
    "sc12_scale_column", _sc8, [_means_sql(), f"s AS (SELECT metric, {_case(scoring.SCALES['low-random_high-1_v10'].entries)} AS s FROM u)"],
    'SELECT metric, round(s, 4) AS "low-random_high-1_v10" FROM s UNION ALL SELECT \'avg_score\', round(avg(s), 4) FROM s',
)


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for i in range(more.SPLITS):
        part = scoring.aggregate(more._half_errors(spark, sf, i)).select(F.lit(i).alias("split_index"), "metric", F.col("mean").alias("value"))
        out = part if out is None else out.unionByName(part)
    return references.anchor(out)


def _sc9(spark: SparkSession, sf: str) -> DataFrame:
    policies = {n: catalog.CATALOG[n].policy for n in more.ERRORS}
    out = scoring.replicate_column(scoring.aggregate(more._tidy(spark, sf)), more._baseline(spark, sf), _splits(spark, sf), policies)
    return more._rounded(out, "from_replicate", digits=4)


_REPLICATES = "rep AS (SELECT metric, avg(value) AS r FROM (" + " UNION ALL ".join(
    f"SELECT * FROM (WITH {more._half_sql(i)}, {more._HALF_ERRORS}, {more._tidy_sql('hv', 'ht')} SELECT metric, avg(value) AS value FROM ht GROUP BY metric)" for i in range(more.SPLITS)
) + ") GROUP BY metric)"
_add(
    "sc9_from_replicate", _sc9,
    [
        *more.TIDY, *more.TILED, _REPLICATES,
        """sx AS (SELECT metric, CASE WHEN metric = 'delta_pearson' THEN greatest(0, least(1, (u - b) / (r - b)))
    ELSE least(1, CASE WHEN u > b THEN greatest(-6, -((1 - (b - u) / (b - r)) ** 2 - 1) / 2) ELSE (b - u) / (b - r) END) END AS s
  FROM u JOIN b USING (metric) JOIN rep USING (metric) WHERE CASE WHEN metric = 'delta_pearson' THEN r - b ELSE b - r END > 0)""",
    ],
    "SELECT metric, round(s, 4) AS from_replicate FROM sx UNION ALL SELECT 'avg_score', round(avg(s), 4) FROM sx",
)


def _sc7(spark: SparkSession, sf: str) -> DataFrame:
    raw = more._rf3(spark, sf).agg(F.avg("raw").alias("raw"), F.count("*").alias("n")).first()
    means = scoring.aggregate(catalog.evaluate(of(spark, sf), ["de_wilcoxon_lfc_nmae", "expr_mae"]))
    return more._rounded(scoring.reference_column(means, raw["raw"], raw["n"]), "from_reference", digits=4)


_add(
    "sc7_from_reference", _sc7,
    [f"raw AS (SELECT avg(raw) AS raw FROM ({more.ORACLES['rf3_lfc_nmae_reference']}))", f"nm AS (SELECT avg(value) AS u FROM ({oracle.metric('nmae', 'lfc_nmae')}))"],
    "SELECT 'de_wilcoxon_lfc_nmae' AS metric, round(CASE WHEN raw < 1 THEN (1 - u) / (1 - raw) ELSE 1 - u END, 4) AS from_reference FROM nm, raw UNION ALL SELECT 'expr_mae', NULL",
)


def _sc10(spark: SparkSession, sf: str) -> DataFrame:
    policies = scoring.with_overrides({n: catalog.CATALOG[n].policy for n in more.ERRORS}, {"mae": scoring.ERROR_LINEAR, "delta_mse": scoring.DIAGNOSTIC}, catalog.LEGACY)
    return more._rounded(scoring.score(scoring.aggregate(more._tidy(spark, sf)), more._baseline(spark, sf), policies), "from_baseline")


_add(
    "sc10_overrides", _sc10,
    [
        *more.TIDY, *more.TILED,
        """sx AS (SELECT metric, CASE WHEN metric = 'delta_pearson' THEN CASE WHEN 1 - b > 0 THEN greatest(0, least(1, (u - b) / (1 - b))) END WHEN metric = 'expr_mae' AND b > 0 THEN greatest(-6, least(1, 1 - u / b))
    WHEN b > 0 THEN least(1, CASE WHEN u > b THEN greatest(-6, -((u / b) * (u / b) - 1) / 2) ELSE 1 - u / b END) END AS s FROM u JOIN b USING (metric) WHERE metric <> 'delta_mse')""",
    ],
    "SELECT metric, round(s, 6) AS from_baseline FROM sx WHERE s IS NOT NULL UNION ALL SELECT 'avg_score', round(avg(s), 6) FROM sx",
)

# ---- a built baseline, and the wide table of statistics


def _bl5(spark: SparkSession, sf: str) -> DataFrame:
    tidy = catalog.evaluate(baselines.emitted(of(spark, sf), more.SEED), ["expr_mae", "expr_mse"])
    return more._rounded(tidy, "value")


_add(
    "bl5_baseline_errors", _bl5,
    [
        f"pc AS (SELECT * FROM ({oracle.query([oracle.CORE, more.GENERIC, more.SCALE, *more.DISPERSED], more.DISPERSED_ROWS)}))", oracle.CORE,
        "pb AS (SELECT pert, gene, ln(1 + 5e4 * sum(x) / sum(sum(x)) OVER (PARTITION BY pert)) AS bulk FROM pc GROUP BY pert, gene)",
        """bv AS (SELECT r.pert AS target, avg(abs(coalesce(p.bulk, 0) - r.bulk)) AS expr_mae, avg((coalesce(p.bulk, 0) - r.bulk) ** 2) AS expr_mse
  FROM prof r LEFT JOIN pb p USING (pert, gene) WHERE r.side = 0 AND r.pert > 0 GROUP BY r.pert)""",
    ],
    f"SELECT {PERT}, 'expr_mae' AS metric, round(expr_mae, 6) AS value FROM bv UNION ALL SELECT {PERT}, 'expr_mse', round(expr_mse, 6) FROM bv",
)

STATISTICS = {"count": "count(*)", "null_count": "count(*) FILTER (value IS NULL)", "mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)"}
_add(
    "agg21_wide_statistics", lambda s, d: more._rounded(scoring.wide_statistics(more._tidy(s, d), list(more.ERRORS)), *more.ERRORS), more.TIDY,
    " UNION ALL ".join(
        f"SELECT '{k}' AS statistic, " + ", ".join(f"round(CAST((SELECT {x} FROM tidy WHERE metric = '{m}') AS DOUBLE), 6) AS {m}" for m in more.ERRORS) for k, x in STATISTICS.items()
    ),
)
