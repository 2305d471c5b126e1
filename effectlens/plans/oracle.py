"""SQL counterparts of the queries, for another engine on the same tables.

They are written from the definitions, not from the DataFrame plans: cells are
spelled out densely, rank sums compare all pairs, ranks are counted.
"""

from __future__ import annotations

import math


def erfc(x: str) -> str:
    """erfc of a non-negative expression: its Taylor series below 1/2, beyond it the mean of exp(-x^2 / sin^2) over a quarter turn.

    Written apart from the expression that the queries run, so that a fault there shows.
    """
    terms = " + ".join(f"{(-1) ** n / (math.factorial(n) * (2 * n + 1))!r}*pow({x}, {2 * n + 1})" for n in range(18))
    turn = f"list_sum(list_transform(range(128), lambda i: exp(-{x}*{x}/pow(sin((i + 0.5)*pi()/256), 2))))/128"
    return f"CASE WHEN {x} < 0.5 THEN 1 - 2/sqrt(pi())*({terms}) ELSE {turn} END"

#: base .. grp: counts of cells, their totals, groups; dense: zeros included; prof: profiles.
CORE = """
base AS (SELECT CAST(o_orderkey % 2 AS INTEGER) AS side, CAST(c_nationkey AS INTEGER) AS pert, o_custkey AS cell,
    CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS gene, CAST(sum(l_quantity) AS DOUBLE) AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
cell0 AS (SELECT DISTINCT side, pert, cell FROM base),
counts AS (SELECT side, pert, cell, gene, sum(x) AS x FROM (
    SELECT * FROM base UNION ALL
    SELECT side, pert, cell, CAST(g AS INTEGER), 40.0 FROM cell0, range(1, 26) AS r(g) WHERE pert > 0 AND (7 * pert + g) % 5 < CASE WHEN side = 0 THEN 2 ELSE 3 END) GROUP BY ALL),
lib AS (SELECT side, pert, cell, sum(x) AS lib FROM counts GROUP BY ALL),
grp AS (SELECT side, pert, count(*) AS n, sum(lib) AS total_lib FROM lib GROUP BY ALL),
dense AS (SELECT l.side, l.pert, l.cell, CAST(g AS INTEGER) AS gene, coalesce(x, 0) AS x, coalesce(x, 0) * 1e6 / lib AS v, lib
  FROM lib l CROSS JOIN range(1, 26) AS r(g) LEFT JOIN counts c ON c.side = l.side AND c.cell = l.cell AND c.gene = g),
prof AS (SELECT *, ln(1 + 5e4 * total / total_lib) AS bulk FROM (
    SELECT side, pert, gene, count(*) AS n, sum(x) AS total, avg(x) AS counts, avg(v) AS normalized, exp(avg(ln(1 + v))) - 1 AS geometric, avg(ln(1 + v)) AS lognorm, sum(ln(1 + v) * ln(1 + v)) AS sumsq
    FROM dense GROUP BY ALL) JOIN grp USING (side, pert, n))
"""

#: de0: fold changes and p-values; de: with p_adj by target; j: both sides.
DE = (
    """
ctrl AS (SELECT gene, cell, v FROM dense WHERE side = 0 AND pert = 0),
pairs AS (SELECT t.side, t.pert, t.gene, sum(CASE WHEN t.v > c.v THEN 1.0 WHEN t.v = c.v THEN 0.5 ELSE 0 END) AS u
  FROM dense t JOIN ctrl c ON t.gene = c.gene WHERE t.pert > 0 GROUP BY ALL),
tied AS (SELECT side, pert, gene, sum(m * m * m - m) AS ties FROM (
    SELECT side, pert, gene, v, CAST(count(*) AS DOUBLE) AS m FROM (
      SELECT side, pert, gene, v FROM dense WHERE pert > 0
      UNION ALL SELECT g.side, g.pert, c.gene, c.v FROM grp g, ctrl c WHERE g.pert > 0) GROUP BY ALL) GROUP BY ALL),
rs AS (SELECT p.side, p.pert, p.gene, CASE WHEN var > 1e-12 THEN (u - n1 * n2 / 2) / sqrt(var) ELSE 0 END AS z FROM (
    SELECT p.*, CAST(g.n AS DOUBLE) AS n1, CAST(k.n AS DOUBLE) AS n2,
      CAST(g.n AS DOUBLE) * k.n / 12 * ((g.n + k.n + 1) - ties / (CAST(g.n + k.n AS DOUBLE) * (g.n + k.n - 1))) AS var
    FROM pairs p JOIN tied t USING (side, pert, gene) JOIN grp g USING (side, pert) JOIN grp k ON k.side = 0 AND k.pert = 0) p),
pv AS (SELECT side, pert, gene, z, """
    + erfc("(abs(z)/sqrt(2.0))")
    + """ AS p_value FROM rs),
de0 AS (SELECT p.side, p.pert AS target, p.gene AS feature, log2((p.normalized + 1e-9) / (c.normalized + 1e-9)) AS lfc, p_value
  FROM prof p JOIN prof c ON c.side = 0 AND c.pert = 0 AND c.gene = p.gene AND c.normalized > 5 JOIN pv ON pv.side = p.side AND pv.pert = p.pert AND pv.gene = p.gene WHERE p.pert > 0),
de AS (SELECT side, target, feature, lfc, p_value, least(1.0, min(step) OVER (PARTITION BY side, target ORDER BY i DESC)) AS p_adj FROM (
    SELECT *, p_value * count(*) OVER (PARTITION BY side, target) / row_number() OVER w AS step, row_number() OVER w AS i
    FROM de0 WINDOW w AS (PARTITION BY side, target ORDER BY p_value, feature))),
j AS (SELECT coalesce(r.target, p.target) AS target, coalesce(r.feature, p.feature) AS feature, r.lfc AS lr, p.lfc AS lp, p.p_adj AS pp, p.p_value AS vp,
    r.target IS NOT NULL AS tr, p.target IS NOT NULL AS tp, coalesce(r.p_adj < 0.05, false) AS sr, coalesce(p.p_adj < 0.05, false) AS sp,
    coalesce(r.target, p.target) = coalesce(r.feature, p.feature) AS own
  FROM (SELECT * FROM de WHERE side = 0) r FULL JOIN (SELECT * FROM de WHERE side = 1) p ON r.target = p.target AND r.feature = p.feature),
targets AS (SELECT pert AS target FROM grp WHERE side = 0 AND pert > 0)
"""
)

EFFECT = """
eff AS (SELECT p.side, p.pert, p.gene, p.bulk AS m, c.bulk AS c, p.bulk - c.bulk AS e FROM prof p JOIN prof c ON c.side = 0 AND c.pert = 0 AND c.gene = p.gene WHERE p.pert > 0),
two AS (SELECT p.pert, p.gene, p.m AS p, r.m AS r, r.c AS c FROM eff p JOIN eff r ON p.side = 1 AND r.side = 0 AND p.pert = r.pert AND p.gene = r.gene)
"""

ERRORS = """
val AS (SELECT pert AS target, avg(abs(p - r)) AS expr_mae, avg((p - r) * (p - r)) AS expr_mse, avg(abs(p - r)) AS delta_mae, avg((p - r) * (p - r)) AS delta_mse,
  CASE WHEN count(*) * sum((p - c) * (p - c)) - sum(p - c) * sum(p - c) > 1e-12 AND count(*) * sum((r - c) * (r - c)) - sum(r - c) * sum(r - c) > 1e-12 THEN corr(p - c, r - c) ELSE -1 END AS delta_pearson,
  sum(exp(r) - 1) / 5e4 AS expr_real_mass FROM two GROUP BY pert)
"""

JACKKNIFE = """
loo AS (SELECT d.side, d.pert, d.gene, CASE WHEN g.total_lib > d.lib THEN ln(1 + 5e4 * (p.total - d.x) / (g.total_lib - d.lib)) ELSE 0 END AS v, g.n
  FROM dense d JOIN prof p USING (side, pert, gene) JOIN grp g USING (side, pert)),
jk AS (SELECT side, pert, CASE WHEN max(n) >= 2 THEN greatest(0, (max(n) - 1.0) / max(n) * sum(ss)) ELSE 0 END AS jk FROM (
    SELECT side, pert, gene, max(n) AS n, sum((v - mean) * (v - mean)) AS ss FROM (SELECT *, avg(v) OVER (PARTITION BY side, pert, gene) AS mean FROM loo) GROUP BY ALL) GROUP BY ALL)
"""

UNBIASED = """
dist AS (SELECT pert, sum(CASE WHEN pert <> gene THEN (p - r) * (p - r) ELSE 0 END) AS err, sum(CASE WHEN pert <> gene THEN (r - c) * (r - c) ELSE 0 END) AS gap,
  CAST(sum(CASE WHEN pert <> gene THEN 1 ELSE 0 END) AS DOUBLE) AS g FROM two GROUP BY pert),
cor AS (SELECT d.*, jp.jk AS jp, jr.jk AS jr, jc.jk AS jc FROM dist d JOIN jk jp ON jp.side = 1 AND jp.pert = d.pert JOIN jk jr ON jr.side = 0 AND jr.pert = d.pert JOIN jk jc ON jc.side = 0 AND jc.pert = 0),
bud AS (SELECT sum(greatest(0, s2 - s1 * s1 / sw)) AS budget FROM (
    SELECT gene, count(*) AS n, sum(1 / g) AS sw, sum(v / g) AS s1, sum(v * v / g) AS s2 FROM (
      SELECT t.pert, t.gene, t.p - avg(t.p) OVER (PARTITION BY t.gene) AS v, d.g FROM two t JOIN dist d USING (pert)) WHERE pert <> gene GROUP BY gene) WHERE n >= 2),
cl AS (SELECT sum(least(jp, jr) / g) AS claim FROM cor),
val AS (SELECT pert AS target, (err - jp - jr) / g AS expr_mse_unbiased,
  (err - least(jp, jr) * CASE WHEN claim > 0 THEN least(1, budget / claim) ELSE 1 END - jr) / g AS expr_mse_unbiased_capped, (gap - jr - jc) / g AS expr_distance_unbiased FROM cor, bud, cl)
"""


def pds(scope: str, metric: str, ties: str, denominator: str) -> str:
    """val for one discrimination score."""
    drop = {"panel": "WHERE p.gene NOT BETWEEN 1 AND 24", "row": "WHERE p.gene <> p.pert"}[scope]
    d = {
        "l1": "sum(abs(p.e - r.e))", "l2": "sqrt(sum((p.e - r.e) * (p.e - r.e)))",
        "cosine": "CASE WHEN sum(p.e * p.e) * sum(r.e * r.e) > 0 THEN greatest(0, least(2, 1 - sum(p.e * r.e) / sqrt(sum(p.e * p.e) * sum(r.e * r.e)))) ELSE 1 END",
    }[metric]
    rank = "count(*) FILTER (a.d < s.d) + (count(*) FILTER (a.d = s.d) - 1) / 2.0" if ties == "midrank" else "count(*) FILTER (a.d < s.d OR (a.d = s.d AND a.other < a.pert))"
    n = "count(*) - 1" if denominator == "n-1" else "count(*)"
    return f"""
dd AS (SELECT p.pert, r.pert AS other, round({d}, 9) AS d FROM eff p JOIN eff r ON p.side = 1 AND r.side = 0 AND p.gene = r.gene {drop} GROUP BY ALL),
val AS (SELECT a.pert AS target, 1 - coalesce(({rank}) / CAST(nullif({n}, 0) AS DOUBLE), 0) AS value FROM dd a JOIN dd s ON s.pert = a.pert AND s.other = s.pert GROUP BY a.pert)
"""


SETS = """
ct AS (SELECT target, CAST(count(*) FILTER (sr) AS DOUBLE) AS a, CAST(count(*) FILTER (sp) AS DOUBLE) AS b, CAST(count(*) FILTER (sr AND sp) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS g,
  count(*) FILTER (sr AND sp AND NOT own) AS bo, count(*) FILTER ((sr OR sp) AND NOT own) AS eo FROM j GROUP BY target),
val AS (SELECT target, a AS n_real, b AS n_pred, coalesce(tp / nullif(a, 0), 0) AS sig_recall, coalesce(bo / CAST(nullif(eo, 0) AS DOUBLE), 1) AS sig_jaccard,
  CASE WHEN a <= 0 OR a >= g THEN -1 ELSE tp / a - (b - tp) / (g - a) END AS sig_recall_adjusted, CASE WHEN b <= 0 OR b >= g THEN -1 ELSE tp / b - (a - tp) / (g - b) END AS precision_adjusted,
  CASE WHEN a * b * (g - a) * (g - b) <= 0 THEN -1 ELSE (tp * g - a * b) / sqrt(a * b * (g - a) * (g - b)) END AS sig_mcc FROM ct)
"""


def top(kind: str, k: int | None) -> str:
    size = {"overlap": "a", "precision": "b"}[kind]
    n = size if k is None else f"least({k}, {size})"
    return f"""
ct AS (SELECT target, count(*) FILTER (sr) AS a, count(*) FILTER (sp) AS b FROM j GROUP BY target),
rr AS (SELECT target, feature, row_number() OVER (PARTITION BY target ORDER BY abs(lr) DESC, feature) AS r FROM j WHERE sr),
pp AS (SELECT target, feature, row_number() OVER (PARTITION BY target ORDER BY abs(lp) DESC, feature) AS q FROM j WHERE sp),
val AS (SELECT target, coalesce((SELECT count(*) FROM rr JOIN pp USING (target, feature) WHERE rr.target = ct.target AND r <= {n} AND q <= {n}) / CAST(nullif({n}, 0) AS DOUBLE), 0) AS value FROM ct)
"""


TOP_ADJUSTED = """
ct AS (SELECT target, CAST(count(*) FILTER (sr) AS DOUBLE) AS a, CAST(least(count(*) FILTER (sp), count(*) FILTER (sr)) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS g FROM j GROUP BY target),
pp AS (SELECT target, feature, sr, row_number() OVER (PARTITION BY target ORDER BY abs(lp) DESC, feature) AS q FROM j WHERE sp),
cx AS (SELECT ct.*, CAST((SELECT count(*) FROM pp WHERE pp.target = ct.target AND sr AND q <= b) AS DOUBLE) AS tp FROM ct),
val AS (SELECT target, CASE WHEN a * b * (g - a) * (g - b) <= 0 THEN -1 ELSE (tp * g - a * b) / sqrt(a * b * (g - a) * (g - b)) END AS overlap_adjusted FROM cx)
"""

SIGNS = """
val AS (SELECT target, coalesce(avg(CASE WHEN sr THEN CAST(sign(lr) = sign(lp) AS DOUBLE) END), 0) AS direction_match, coalesce(avg(CASE WHEN sp THEN CAST(sign(lr) = sign(lp) AS DOUBLE) END), 0) AS model_direction_match
  FROM j WHERE tr AND tp GROUP BY target)
"""


def _spearman(name: str, rows: str) -> str:
    return f"""
rk AS (SELECT target, rank() OVER (PARTITION BY target ORDER BY x) + (count(*) OVER (PARTITION BY target, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2.0 AS ry FROM ({rows})),
val AS (SELECT targets.target, coalesce(CASE WHEN count(rx) >= 2 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END, -1) AS {name} FROM targets LEFT JOIN rk USING (target) GROUP BY ALL)
"""


SPEARMAN = {f"lfc_spearman{tail}": _spearman(f"lfc_spearman{tail}", f"SELECT target, lr AS x, coalesce(lp, 0) AS y FROM j WHERE sr {cond}") for tail, cond in (("", ""), ("_pos", "AND lr > 0"), ("_neg", "AND lr < 0"))}

NSIG = """
cn AS (SELECT target, count(*) FILTER (sr) AS x, count(*) FILTER (sp) AS y FROM j GROUP BY target HAVING count(*) FILTER (sr) > 0),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM cn),
rho AS (SELECT CASE WHEN count(*) = 0 THEN 1 WHEN count(*) >= 2 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) ELSE -1 END AS nsig_spearman FROM rk),
val AS (SELECT target, nsig_spearman FROM targets, rho)
"""

NMAE = """
val AS (SELECT target, avg(abs(coalesce(lp, 0) - lr)) / avg(abs(lr)) AS lfc_nmae FROM j WHERE sr AND NOT own AND isfinite(lr) GROUP BY target HAVING count(*) >= 10 AND avg(abs(lr)) > 0)
"""

AREAS = """
low AS (SELECT min(p_adj) AS low FROM de WHERE side = 1 AND p_adj > 0),
sc AS (SELECT target, sr AS y, greatest(coalesce(pp, 1), low) AS p FROM j, low WHERE tr),
roc AS (SELECT target, avg(CASE WHEN a.p < b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS roc_auc FROM sc a JOIN sc b USING (target) WHERE a.y AND NOT b.y GROUP BY target),
pr AS (SELECT a.target, sum(prec) / count(*) AS pr_auc FROM (
    SELECT a.target, count(*) FILTER (b.y) / CAST(count(*) AS DOUBLE) AS prec FROM (SELECT target, y, p, row_number() OVER () AS i FROM sc) a JOIN sc b ON a.target = b.target AND b.p <= a.p WHERE a.y GROUP BY a.target, a.i) a GROUP BY a.target),
val AS (SELECT t.target, CASE WHEN roc_auc IS NULL THEN 0 ELSE pr_auc END AS pr_auc, coalesce(roc_auc, 0) AS roc_auc FROM targets t LEFT JOIN roc USING (target) LEFT JOIN pr USING (target))
"""

DIRECTION = """
dr AS (SELECT target, feature, own, sr, sp, lr <> 0 AS den, coalesce(lr <> 0 AND lp <> 0 AND sign(lp) = sign(lr), false) AS hit, pp, vp, abs(lp) AS size FROM j WHERE tr AND tp),
st AS (SELECT t.target, coalesce(n_conf, 0) AS n_conf, q, greatest(1 - q, 0.05) AS d FROM targets t LEFT JOIN (
    SELECT target, count(*) AS n_conf, greatest(count(*) FILTER (lr > 0), count(*) FILTER (lr <> 0) - count(*) FILTER (lr > 0)) / CAST(nullif(count(*) FILTER (lr <> 0), 0) AS DOUBLE) AS q FROM j WHERE sr AND NOT own GROUP BY target) USING (target)),
cv AS (SELECT 's' AS kind, * FROM dr WHERE sr UNION ALL SELECT 'su', * FROM dr UNION ALL SELECT 'r', * FROM dr WHERE sr AND NOT own UNION ALL SELECT 'ru', * FROM dr WHERE NOT own),
cu AS (SELECT kind, target, CAST(sum(CAST(den AS INTEGER)) OVER w AS DOUBLE) AS k, sum(CAST(hit AS INTEGER)) OVER w AS m FROM cv
  WINDOW w AS (PARTITION BY kind, target ORDER BY CAST(sp AS INTEGER) DESC, pp, vp, size DESC, feature ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT t.target, max(k) FILTER (kind = 's' AND m / nullif(k, 0) >= 0.975) AS s, max(k) FILTER (kind = 'su' AND m / nullif(k, 0) >= 0.975) AS su,
    max(k) FILTER (kind = 'r' AND m / nullif(k, 0) >= 0.9) AS r, max(k) FILTER (kind = 'ru' AND m / nullif(k, 0) >= 0.9) AS ru,
    max(k) FILTER (kind = 'r' AND m / nullif(k, 0) >= q + (1 - 0.05) * (1 - q)) AS c, max(k) FILTER (kind = 'ru' AND m / nullif(k, 0) >= q + (1 - 0.05) * (1 - q)) AS cu
  FROM st t LEFT JOIN cu USING (target) GROUP BY t.target),
pc AS (SELECT target, count(*) FILTER (hit) / CAST(nullif(count(*) FILTER (den), 0) AS DOUBLE) AS precision FROM dr WHERE sp GROUP BY target),
cp AS (SELECT target, count(*) AS n_pred, count(*) FILTER (hit) AS k FROM dr WHERE sp AND den AND NOT own GROUP BY target),
ns AS (SELECT target, count(*) AS n_sig FROM j WHERE sr GROUP BY target),
al AS (SELECT st.*, coalesce(n_pred, 0) AS n_pred, coalesce(k, 0) AS k, precision, n_sig, s, su, r, ru, c, cu FROM st LEFT JOIN ks USING (target) LEFT JOIN pc USING (target) LEFT JOIN cp USING (target) LEFT JOIN ns USING (target)),
val AS (SELECT target, coalesce(precision, 0) AS direction_precision, coalesce(coalesce(s, 0) / n_sig, 0) AS direction_sensitivity, coalesce(coalesce(su, 0) / n_sig, 0) AS direction_sensitivity_universe,
  coalesce(k / CAST(nullif(n_pred, 0) AS DOUBLE), 'nan') AS direction_fidelity_raw, coalesce(n_pred / CAST(nullif(n_conf, 0) AS DOUBLE), 'nan') AS direction_coverage,
  CASE WHEN n_conf = 0 THEN CASE WHEN n_pred = 0 THEN 1 ELSE 0 END WHEN q IS NULL OR n_pred = 0 THEN 'nan' ELSE (k / CAST(n_pred AS DOUBLE) - q) / d END AS direction_fidelity,
  coalesce(k / CAST(nullif(n_conf, 0) AS DOUBLE), 'nan') AS direction_yield_raw, CASE WHEN n_conf = 0 OR q IS NULL THEN 'nan' ELSE (k - q * n_pred) / (n_conf * d) END AS direction_yield,
  CASE WHEN n_conf = 0 THEN CASE WHEN n_pred = 0 THEN 1 ELSE 0 END WHEN q IS NULL THEN 'nan' WHEN n_pred = 0 THEN 0 ELSE least(1, n_pred / CAST(n_conf AS DOUBLE)) * (k / CAST(n_pred AS DOUBLE) - q) / d END AS direction_fidelity_yield,
  coalesce(k / CAST(nullif(greatest(n_pred, n_conf), 0) AS DOUBLE), 'nan') AS direction_fidelity_yield_raw,
  CASE WHEN n_conf = 0 OR q IS NULL THEN 'nan' ELSE coalesce(c, 0) / n_conf END AS direction_reach, CASE WHEN n_conf = 0 THEN 'nan' ELSE coalesce(r, 0) / n_conf END AS direction_reach_raw,
  CASE WHEN n_conf = 0 OR q IS NULL THEN 'nan' ELSE coalesce(cu, 0) / n_conf END AS direction_reach_unbounded, CASE WHEN n_conf = 0 THEN 'nan' ELSE coalesce(ru, 0) / n_conf END AS direction_reach_unbounded_raw FROM al)
"""


def query(parts: list[str], select: str) -> str:
    return "WITH " + ",".join(parts) + " " + select


def metric(family: str, column: str) -> str:
    """perturbation, metric value of one catalog entry."""
    if family.startswith("pds_"):
        parts, column = [CORE, EFFECT, pds("panel", family[4:], "midrank", "n-1")], "value"
    elif family == "errors":
        parts = [CORE, EFFECT, ERRORS]
    elif family == "unbiased":
        parts = [CORE, EFFECT, JACKKNIFE, UNBIASED]
    elif family == "top" and column != "overlap_adjusted":
        kind, _, k = column.partition("_top")
        parts, column = [CORE, DE, top(kind, int(k) if k else None)], "value"
    else:
        own = {"sets": SETS, "top": TOP_ADJUSTED, "signs": SIGNS, "spearman": SPEARMAN.get(column), "nsig": NSIG, "nmae": NMAE, "areas": AREAS, "direction": DIRECTION}[family]
        parts = [CORE, DE, own]
    return query(parts, f"SELECT CAST(target AS VARCHAR) AS perturbation, round(CAST({column} AS DOUBLE), 6) AS value FROM val")
