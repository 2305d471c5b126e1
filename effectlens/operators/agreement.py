"""Agreement of predicted with measured differential expression, one value a target.

Every function takes an ``Evidence`` and returns (target, value ...).  ``real``
and ``pred`` hold target, feature, log2_fold_change, p_value, p_adj; ``targets``
lists every perturbation, ``own`` its own gene.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.functions import numeric
from effectlens.operators import de
from effectlens.sources import staging

NAN = float("nan")
KEY = ["target", "feature"]
#: Purity down to which directed genes are counted by the reach (a fixed value).
REACH_PURITY = 0.9


@dataclass
class Evidence:
    real: DataFrame
    pred: DataFrame
    targets: DataFrame
    own: DataFrame
    threshold: float = 0.05

    def significant(self, p: str) -> Column:
        """Strictly below the threshold; null and NaN never are."""
        return F.coalesce((F.col(p) < self.threshold) & ~F.isnan(p), F.lit(False))

    @cached_property
    def joint(self) -> DataFrame:
        """Both tables side by side, outer: lr, pr, vr and lp, pp, vp, flags sr, sp, tr, tp (tested), own."""
        r = self.real.select(*KEY, F.col("log2_fold_change").alias("lr"), F.col("p_adj").alias("pr"), F.lit(True).alias("tr"))
        p = self.pred.select(*KEY, F.col("log2_fold_change").alias("lp"), F.col("p_adj").alias("pp"), F.col("p_value").alias("vp"), F.lit(True).alias("tp"))
        own = self.own.select(*KEY, F.lit(True).alias("own"))
        no = F.lit(False)
        both = r.join(p, KEY, "full").join(own, KEY, "left")
        both = both.select(*KEY, "lr", "pr", "lp", "pp", "vp", *[F.coalesce(c, no).alias(c) for c in ("tr", "tp", "own")], self.significant("pr").alias("sr"), self.significant("pp").alias("sp"))
        return staging.written(both, "joint")

    def spread(self, df: DataFrame, fill: float | None = None) -> DataFrame:
        """A row for every target; ``fill`` where there is none."""
        out = self.targets.join(df, "target", "left")
        return out.fillna(fill) if fill is not None else out


def counts(e: Evidence) -> DataFrame:
    """n_real, n_pred, both, tested (union), and the same without the own gene."""
    one: Column = lambda c: F.sum(F.when(c, 1).otherwise(0))
    j = e.joint
    sr, sp, other = F.col("sr"), F.col("sp"), ~F.col("own")
    agg = j.groupBy("target").agg(
        one(sr).alias("n_real"), one(sp).alias("n_pred"), one(sr & sp).alias("both"), F.count("*").alias("tested"),
        one(sr & sp & other).alias("both_other"), one((sr | sp) & other).alias("either_other"),
    )
    return e.spread(agg, 0)


def _contingency(a: Column, b: Column, tp: Column, g: Column) -> dict[str, Column]:
    d = lambda c: c.cast("double")
    a, b, tp, g = d(a), d(b), d(tp), d(g)
    minus = F.lit(-1.0)
    informed = F.when((a <= 0) | (a >= g), minus).otherwise(numeric.ratio(tp, a) - numeric.ratio(b - tp, g - a))
    marked = F.when((b <= 0) | (b >= g), minus).otherwise(numeric.ratio(tp, b) - numeric.ratio(a - tp, g - b))
    product = a * b * (g - a) * (g - b)
    mcc = F.when(product <= 0, minus).otherwise(numeric.ratio(tp * g - a * b, F.sqrt(F.when(product > 0, product).otherwise(1.0))))
    return {"informed": informed, "marked": marked, "mcc": mcc}


def set_metrics(e: Evidence) -> DataFrame:
    """sig_recall, sig_jaccard, sig_mcc and the chance-corrected precision and recall."""
    c = counts(e)
    t = _contingency(F.col("n_real"), F.col("n_pred"), F.col("both"), F.col("tested"))
    return c.select(
        "target", "n_real", "n_pred", numeric.ratio(F.col("both"), F.col("n_real"), 0.0).alias("sig_recall"),
        numeric.ratio(F.col("both_other"), F.col("either_other"), 1.0).alias("sig_jaccard"),
        t["informed"].alias("sig_recall_adjusted"), t["marked"].alias("precision_adjusted"), t["mcc"].alias("sig_mcc"),
    )


def top_metrics(e: Evidence, ks: tuple[int | None, ...] = (None, 50, 100, 200, 500)) -> DataFrame:
    """overlap[_topK] (list length of the measured side), precision[_topK] (of the predicted one), overlap_adjusted."""
    r = de.significance_ranks(e.real, e.threshold).withColumnRenamed("rnk", "r")
    p = de.significance_ranks(e.pred, e.threshold).withColumnRenamed("rnk", "q")
    c = counts(e).select("target", "n_real", "n_pred", "tested")
    rows = c.join(r.join(p, KEY), "target", "left")
    inside = lambda k: F.sum(F.when((F.col("r") <= k) & (F.col("q") <= k), 1).otherwise(0))
    aggs, out = [], []
    for k in ks:
        tag = "" if k is None else f"_top{k}"
        for name, size in (("overlap", "n_real"), ("precision", "n_pred")):
            n = F.col(size) if k is None else F.least(F.lit(k), F.col(size))
            aggs.append(inside(n).alias(f"{name}{tag}"))
            out.append(numeric.ratio(F.col(f"{name}{tag}"), n, 0.0).alias(f"{name}{tag}"))
    top = F.least("n_pred", "n_real")  # the predicted list cut to the measured one's length
    aggs.append(F.sum(F.when(F.col("r").isNotNull() & (F.col("q") <= top), 1).otherwise(0)).alias("cut"))
    g = rows.groupBy("target", "n_real", "n_pred", "tested").agg(*aggs)
    return g.select("target", *out, _contingency(F.col("n_real"), top, F.col("cut"), F.col("tested"))["mcc"].alias("overlap_adjusted"))


def sign_metrics(e: Evidence) -> DataFrame:
    """direction_match, model_direction_match: the share of equal signs; 0 without a comparison."""
    j = e.joint.filter("tr and tp")
    alike = F.when(F.isnan("lr") | F.isnan("lp"), F.isnan("lr") & F.isnan("lp")).otherwise(F.signum("lr") == F.signum("lp"))
    mean = lambda flag: F.coalesce(F.avg(F.when(F.col(flag), alike.cast("double"))), F.lit(0.0))
    return e.spread(j.groupBy("target").agg(mean("sr").alias("direction_match"), mean("sp").alias("model_direction_match")), 0.0)


def midrank(value: str, by: list[str]) -> Column:
    """Ranks from 1, ties at their mean."""
    n = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (n - 1) / 2.0


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, rho: rank correlation; NaN below two rows or without variance."""
    r = rows.withColumn("_x", midrank(x, by)).withColumn("_y", midrank(y, by))
    s = F.sum
    n = F.count("*").cast("double")
    return r.groupBy(*by).agg(numeric.pearson(n, s("_x"), s("_y"), s(F.col("_x") * F.col("_x")), s(F.col("_y") * F.col("_y")), s(F.col("_x") * F.col("_y"))).alias("rho"))


def fold_change_spearman(e: Evidence) -> DataFrame:
    """lfc_spearman, _pos, _neg over the measured significant genes; a missing prediction is 0, no value -1."""
    j = e.joint.filter("sr").select("target", "lr", F.coalesce("lp", F.lit(0.0)).alias("lp"))
    out = e.targets
    for name, part in (("lfc_spearman", j), ("lfc_spearman_pos", j.filter("lr > 0 and not isnan(lr)")), ("lfc_spearman_neg", j.filter("lr < 0"))):
        rho = spearman(part, "lr", "lp", ["target"])
        out = out.join(rho.select("target", F.when(F.isnan("rho"), -1.0).otherwise(F.col("rho")).alias(name)), "target", "left")
    return out.fillna(-1.0)


def nsig_spearman(e: Evidence) -> DataFrame:
    """One value for all: rank correlation of significant counts over targets with any measured one; 1 without any."""
    c = counts(e).filter("n_real > 0").withColumn("all", F.lit(1))
    rho = spearman(c, "n_real", "n_pred", ["all"]).select(F.when(F.isnan("rho"), -1.0).otherwise(F.col("rho")).alias("nsig_spearman"))
    return e.targets.join(F.broadcast(rho), F.lit(True), "left").fillna(1.0)  # one row


def fold_change_nmae(e: Evidence, least: int = 10) -> DataFrame:
    """lfc_nmae: mean |l' - l| / mean |l| over measured significant finite genes but the own one; omitted below ``least`` genes."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    j = e.joint.filter(F.col("sr") & fine("lr") & ~F.col("own")).withColumn("lp", F.when(fine("lp"), F.col("lp")).otherwise(0.0))
    g = j.groupBy("target").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("lp") - F.col("lr"))).alias("a"), F.avg(F.abs("lr")).alias("b"))
    return g.filter(F.col("n") >= least).filter("b > 0").select("target", numeric.ratio(F.col("a"), F.col("b")).alias("lfc_nmae"))


def area_metrics(e: Evidence, floor: str = "min_nonzero") -> DataFrame:
    """pr_auc (average precision) and roc_auc of -log10 predicted p_adj for measured significance; one class only is 0."""
    j = e.joint.filter("tr").select("target", F.col("sr").cast("int").alias("y"), F.when(F.col("pp").isNull() | F.isnan("pp"), 1.0).otherwise(F.col("pp")).alias("p"))
    if floor == "clip":
        j = j.withColumn("p", F.greatest("p", F.lit(1e-10)))
    elif floor == "replace_zero":
        j = j.withColumn("p", F.when(F.col("p") == 0, 1e-10).otherwise(F.col("p")).cast("float").cast("double"))
    else:
        low = e.pred.filter("p_adj > 0 and not isnan(p_adj)").agg(F.coalesce(F.min("p_adj"), F.lit(1e-10)).alias("low"))
        j = j.join(F.broadcast(low), F.lit(True)).withColumn("p", F.greatest("p", "low"))  # one row
    steps = j.groupBy("target", "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy("target").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("target")
    steps = steps.select("*", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("k"), F.sum("pos").over(whole).alias("np"), F.sum("n").over(whole).alias("nn"))
    neg = F.col("n") - F.col("pos")
    below = F.col("tp") - F.col("pos")  # positives that are ranked before the step
    g = steps.groupBy("target", "np", "nn").agg(
        F.sum(F.col("pos") * F.col("tp") / F.col("k")).alias("ap"), F.sum(neg * (below + F.col("pos") / 2.0)).alias("wins")
    )
    mixed = (F.col("np") > 0) & (F.col("np") < F.col("nn"))
    return e.spread(g.select(
        "target", F.when(mixed, numeric.ratio(F.col("ap"), F.col("np"))).otherwise(0.0).alias("pr_auc"),
        F.when(mixed, numeric.ratio(F.col("wins"), F.col("np") * (F.col("nn") - F.col("np")))).otherwise(0.0).alias("roc_auc"),
    ), 0.0)


# ---- direction


def _directed(e: Evidence) -> DataFrame:
    """Genes tested on both sides: in_denom (a measured direction), match, ranking keys."""
    j = e.joint.filter("tr and tp")
    last = lambda c: F.when(F.col(c).isNull() | F.isnan(c), float("inf")).otherwise(F.col(c))
    den = numeric.defined(F.col("lr"))
    match = den & numeric.defined(F.col("lp")) & (F.signum("lr") == F.signum("lp"))
    size = F.when(F.col("lp").isNull() | F.isnan("lp"), float("-inf")).otherwise(F.abs("lp"))
    return j.select(*KEY, "own", "sr", "sp", den.alias("in_denom"), F.coalesce(match, F.lit(False)).alias("match"), last("pp").alias("rp"), last("vp").alias("rv"), size.alias("size"))


def _longest(rows: DataFrame, stats: DataFrame, threshold: float) -> DataFrame:
    """target and, of each curve, the largest number of directed genes at whose purity is the floor or above.

    All curves have one ranking order; a curve over some of the genes adds up
    these alone, so one ordered pass yields them all.
    """
    w = Window.partitionBy("target").orderBy(F.col("sp").desc(), "rp", "rv", F.col("size").desc(), "feature").rowsBetween(Window.unboundedPreceding, 0)
    subsets = {"s": F.col("sr"), "su": F.lit(True), "r": F.col("sr") & ~F.col("own"), "ru": ~F.col("own")}
    curve = rows
    for name, inside in subsets.items():
        for kind, flag in (("k", "in_denom"), ("m", "match")):
            curve = curve.withColumn(f"{kind}_{name}", F.sum((F.col(flag) & inside).cast("int")).over(w))
    curve = curve.join(stats.select("target", "q"), "target")
    corrected = F.col("q") + (1 - threshold) * (1 - F.col("q"))
    floors = (("ks", "s", F.lit(1 - threshold / 2)), ("ksu", "su", F.lit(1 - threshold / 2)), ("kr", "r", F.lit(REACH_PURITY)), ("kru", "ru", F.lit(REACH_PURITY)), ("kc", "r", corrected), ("kcu", "ru", corrected))
    purity = lambda x: F.try_divide(F.col(f"m_{x}").cast("double"), F.col(f"k_{x}").cast("double"))
    return curve.groupBy("target").agg(*[F.max(F.when(purity(x) >= floor, F.col(f"k_{x}"))).alias(name) for name, x, floor in floors])


def reference_stats(e: Evidence) -> DataFrame:
    """target, n_conf, q, d from the measured side, own gene out."""
    sig = e.real.filter(e.significant("p_adj")).join(e.own.select(*KEY), KEY, "left_anti")
    lfc = F.col("log2_fold_change")
    den = numeric.defined(lfc)
    g = sig.groupBy("target").agg(F.count("*").alias("n_conf"), F.sum(den.cast("int")).alias("votes"), F.sum((den & (lfc > 0)).cast("int")).alias("pos"))
    q = F.try_divide(F.greatest(F.col("pos"), F.col("votes") - F.col("pos")).cast("double"), F.col("votes").cast("double"))
    g = g.select("target", "n_conf", q.alias("q"))
    out = e.targets.join(g, "target", "left").fillna(0, ["n_conf"])
    return out.withColumn("d", F.when(F.col("q").isNotNull(), F.greatest(1 - F.col("q"), F.lit(0.05))))


def direction_metrics(e: Evidence) -> DataFrame:
    """direction_precision, _sensitivity[_universe], the fidelity family and the reach family."""
    rows = _directed(e)
    other = rows.filter("not own")
    stats = reference_stats(e)
    prec = rows.filter("sp").groupBy("target").agg(numeric.ratio(F.sum(F.col("match").cast("int")), F.sum(F.col("in_denom").cast("int")), 0.0).alias("direction_precision"))
    comp = other.filter("sp and in_denom").groupBy("target").agg(F.count("*").alias("n_pred"), F.sum(F.col("match").cast("int")).alias("k"))
    out = stats.join(comp, "target", "left").fillna(0, ["n_pred", "k"]).join(prec, "target", "left").fillna(0.0, ["direction_precision"])
    conf = e.real.filter(e.significant("p_adj")).groupBy("target").agg(F.count("*").alias("n_sig"))
    out = out.join(conf, "target", "left")
    out = out.join(_longest(rows, stats, e.threshold), "target", "left")
    n_conf, n_pred, k, q, d = (F.col(c) for c in ("n_conf", "n_pred", "k", "q", "d"))
    z = lambda c: F.coalesce(c, F.lit(0))
    raw, cover = numeric.ratio(k, n_pred), numeric.ratio(n_pred, n_conf)
    fixed = (raw - q) / d
    empty = F.when(n_pred == 0, 1.0).otherwise(0.0)
    reach = lambda c, need_q: F.when((n_conf == 0) | (q.isNull() if need_q else F.lit(False)), F.lit(NAN)).otherwise(numeric.ratio(z(F.col(c)), n_conf))
    return out.select(
        "target", "direction_precision",
        F.when(F.coalesce("n_sig", F.lit(0)) > 0, numeric.ratio(z(F.col("ks")), F.col("n_sig"))).otherwise(0.0).alias("direction_sensitivity"),
        F.when(F.coalesce("n_sig", F.lit(0)) > 0, numeric.ratio(z(F.col("ksu")), F.col("n_sig"))).otherwise(0.0).alias("direction_sensitivity_universe"),
        raw.alias("direction_fidelity_raw"), cover.alias("direction_coverage"),
        F.when(n_conf == 0, empty).when(q.isNull() | (n_pred == 0), F.lit(NAN)).otherwise(fixed).alias("direction_fidelity"),
        numeric.ratio(k, n_conf).alias("direction_yield_raw"),
        F.when((n_conf == 0) | q.isNull(), F.lit(NAN)).otherwise(numeric.ratio(k - q * n_pred, n_conf * d)).alias("direction_yield"),
        F.when(n_conf == 0, empty).when(q.isNull(), F.lit(NAN)).when(n_pred == 0, 0.0).otherwise(F.least(F.lit(1.0), cover) * fixed).alias("direction_fidelity_yield"),
        numeric.ratio(k, F.greatest(n_pred, n_conf)).alias("direction_fidelity_yield_raw"),
        reach("kc", True).alias("direction_reach"), reach("kr", False).alias("direction_reach_raw"),
        reach("kcu", True).alias("direction_reach_unbounded"), reach("kru", False).alias("direction_reach_unbounded_raw"),
    )
