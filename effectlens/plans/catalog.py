"""The metric catalog: names, policies, profiles, and how a frame of each family is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.operators import agreement, expression
from effectlens.plans import scoring as sc
from effectlens.plans.evaluation import Evaluation
from effectlens.sources import staging


@dataclass(frozen=True)
class Metric:
    name: str
    family: str
    column: str
    policy: sc.Policy
    profiles: tuple[str, ...]
    legacy: str | None = None
    worst: float | None = None  # what a missing or NaN value counts as in version 2


#: Values of metrics that have none for a perturbation (fixed by the published rule).
_WORST = {
    "delta_pearson": -1.0, "nsig_spearman": -1.0, "sig_recall": 0.0, "direction_match": 0.0, "model_direction_match": 0.0, "direction_precision": 0.0, "direction_sensitivity": 0.0,
    "direction_sensitivity_universe": 0.0, "lfc_spearman": -1.0, "lfc_spearman_pos": -1.0, "lfc_spearman_neg": -1.0, "pr_auc": 0.0, "roc_auc": 0.0,
    "overlap_adjusted": -1.0, "precision_adjusted": -1.0, "sig_recall_adjusted": -1.0, "sig_mcc": -1.0,
}

#: Families: (key column, frame of an evaluation).
FAMILIES: dict[str, tuple[str, Callable[[Evaluation], DataFrame]]] = {
    "errors": ("pert", lambda e: expression.errors(e.profile, e.comparator, e.config.control, e.config.control_source)),
    "unbiased": ("pert", lambda e: expression.unbiased(e.profile, e.correction, e.own, e.config.control, e.comparator)),
    "pds_l1": ("pert", lambda e: e.pds("l1")),
    "pds_l2": ("pert", lambda e: e.pds("l2")),
    "pds_cosine": ("pert", lambda e: e.pds("cosine")),
    "sets": ("target", lambda e: agreement.set_metrics(e.evidence)),
    "top": ("target", lambda e: agreement.top_metrics(e.evidence)),
    "signs": ("target", lambda e: agreement.sign_metrics(e.evidence)),
    "spearman": ("target", lambda e: agreement.fold_change_spearman(e.evidence)),
    "nsig": ("target", lambda e: agreement.nsig_spearman(e.evidence)),
    "nmae": ("target", lambda e: agreement.fold_change_nmae(e.evidence)),
    "areas": ("target", lambda e: agreement.area_metrics(e.evidence, e.config.auc_floor)),
    "direction": ("target", lambda e: agreement.direction_metrics(e.evidence)),
}


def _entries() -> list[Metric]:
    exp = ("full", "anndata")
    out = [
        Metric("expr_mae", "errors", "expr_mae", sc.ERROR, (*exp, "minimal", "vcc"), "mae"),
        Metric("expr_mse", "errors", "expr_mse", sc.ERROR, (*exp, "minimal"), "mse"),
        Metric("expr_mse_unbiased", "unbiased", "expr_mse_unbiased", sc.DIAGNOSTIC, (*exp, "vcc2026")),
        Metric("expr_mse_unbiased_capped", "unbiased", "expr_mse_unbiased_capped", sc.DIAGNOSTIC, (*exp, "vcc2026")),
        Metric("expr_distance_unbiased", "unbiased", "expr_distance_unbiased", sc.DIAGNOSTIC, (*exp, "vcc2026")),
        Metric("expr_real_mass_ratio", "errors", "expr_real_mass", sc.DIAGNOSTIC, (*exp, "vcc2026")),
        Metric("delta_mae", "errors", "delta_mae", sc.ERROR, exp, "mae_delta"),
        Metric("delta_mse", "errors", "delta_mse", sc.ERROR, exp, "mse_delta"),
        Metric("delta_pearson", "errors", "delta_pearson", sc.BOUNDED, (*exp, "minimal"), "pearson_delta"),
        Metric("pds_l1", "pds_l1", "value", sc.BOUNDED, (*exp, "minimal", "vcc", "pds"), "discrimination_score_l1"),
        Metric("pds_l2", "pds_l2", "value", sc.BOUNDED, exp, "discrimination_score_l2"),
        Metric("pds_cosine", "pds_cosine", "value", sc.UNFLOORED, (*exp, "vcc2026"), "discrimination_score_cosine"),
    ]
    de = ("full", "de")

    def add(column: str, family: str, policy: sc.Policy, extra: tuple[str, ...] = (), legacy: str | None = None, name: str | None = None) -> None:
        out.append(Metric(f"de_wilcoxon_{name or column}", family, column, policy, (*de, *extra), legacy))

    for kind in ("overlap", "precision"):
        add(kind, "top", sc.BOUNDED, ("minimal", "vcc") if kind == "overlap" else ("minimal",), f"{kind}_at_N")
        for k in (50, 100, 200, 500):
            add(f"{kind}_top{k}", "top", sc.BOUNDED, (), f"{kind}_at_{k}")
    add("n_real", "sets", sc.DIAGNOSTIC, ("minimal",), "de_nsig_counts_real", "nsig_counts_real")
    add("n_pred", "sets", sc.DIAGNOSTIC, ("minimal",), "de_nsig_counts_pred", "nsig_counts_pred")
    add("nsig_spearman", "nsig", sc.BOUNDED, (), "de_spearman_sig")
    add("sig_recall", "sets", sc.BOUNDED, (), "de_sig_genes_recall")
    add("direction_match", "signs", sc.BOUNDED, (), "de_direction_match")
    add("model_direction_match", "signs", sc.BOUNDED, (), "de_model_direction_match")
    add("direction_precision", "direction", sc.BOUNDED)
    add("direction_sensitivity", "direction", sc.BOUNDED)
    add("direction_sensitivity_universe", "direction", sc.OPEN)
    for tail in ("", "_pos", "_neg"):
        add(f"lfc_spearman{tail}", "spearman", sc.BOUNDED, (), f"de_spearman{tail}_lfc_sig")
    add("lfc_nmae", "nmae", sc.ERROR_LINEAR, ("vcc2026",))
    add("pr_auc", "areas", sc.BOUNDED, (), "pr_auc")
    add("roc_auc", "areas", sc.BOUNDED, (), "roc_auc")
    add("sig_jaccard", "sets", sc.UNFLOORED, ("vcc2026",))
    add("overlap_adjusted", "top", sc.BOUNDED)
    for c in ("precision_adjusted", "sig_recall_adjusted", "sig_mcc"):
        add(c, "sets", sc.BOUNDED)
    add("direction_fidelity", "direction", sc.BOUNDED)
    add("direction_fidelity_raw", "direction", sc.BOUNDED)
    add("direction_coverage", "direction", sc.OPEN)
    add("direction_yield", "direction", sc.OPEN)
    add("direction_yield_raw", "direction", sc.OPEN)
    add("direction_fidelity_yield", "direction", sc.BOUNDED)
    add("direction_fidelity_yield_raw", "direction", sc.UNFLOORED, ("vcc2026",))
    add("direction_reach", "direction", sc.BOUNDED)
    add("direction_reach_raw", "direction", sc.UNFLOORED, ("vcc2026",))
    add("direction_reach_unbounded", "direction", sc.OPEN)
    add("direction_reach_unbounded_raw", "direction", sc.OPEN)
    return out


CATALOG: dict[str, Metric] = {m.name: replace(m, worst=_WORST.get(m.name.removeprefix("de_wilcoxon_"))) for m in _entries()}
#: The members that a competition's score is made of: without a usable range for one there is no score.
DECISIVE = tuple(m.name for m in CATALOG.values() if "vcc2026" in m.profiles and m.policy.scored)
LEGACY = {m.legacy: m.name for m in CATALOG.values() if m.legacy}
#: A ratio of sums: (numerator, denominator).
DERIVED = {"expr_mse_unbiased_capped_norm": ("expr_mse_unbiased_capped", "expr_distance_unbiased")}
DERIVED_POLICIES = {"expr_mse_unbiased_capped_norm": sc.CAPPED}


#: What the names of metrics of a differential-expression table begin with, by how the table is made.
DE_PREFIX = {"wilcoxon": "de_wilcoxon_", "deseq2": "de_deseq2_"}


def named(name: str, method: str) -> str:
    """The name of a metric where tables are made by ``method``."""
    return name.replace(DE_PREFIX["wilcoxon"], DE_PREFIX[method], 1) if name.startswith(DE_PREFIX["wilcoxon"]) else name


def resolve(names: str | list[str], method: str = "wilcoxon") -> list[str]:
    """Metric names of a profile or a list of names, canonical or version 1; parts of derived ones come along.

    Names of the other methods are entries of the catalog under the name of the
    first one; they are refused where tables are made otherwise.
    """
    if isinstance(names, str):
        found = [m.name for m in CATALOG.values() if names in m.profiles]
        if names in ("full", "anndata", "vcc2026"):
            found += list(DERIVED)
        if not found:
            raise ValueError(f"unknown profile {names!r}")
        return found
    out: list[str] = []
    for n in names:
        n = LEGACY.get(n, n)
        if other := [m for m, prefix in DE_PREFIX.items() if n.startswith(prefix) and m not in ("wilcoxon", method)]:
            raise ValueError(f"{n!r} needs tables made by {other[0]}, these are made by {method}")
        n = n.replace(DE_PREFIX[method], DE_PREFIX["wilcoxon"], 1) if n.startswith(DE_PREFIX[method]) else n
        if n not in CATALOG and n not in DERIVED:
            raise ValueError(f"unknown metric {n!r}")
        out += [x for x in (*DERIVED.get(n, ()), n) if x not in out]
    return out


def _family(e: Evaluation, family: str) -> DataFrame:
    """The frame of a family, written once: one row a perturbation."""
    if family not in e.frames:
        e.frames[family] = staging.written(FAMILIES[family][1](e), family)
    return e.frames[family]


def _values(e: Evaluation, family: str, mine: list[Metric]) -> DataFrame:
    """perturbation, metric, value; in version 2 a metric with a worst value has a number for every perturbation."""
    key = FAMILIES[family][0]
    frame = _family(e, family).withColumn("perturbation", F.col(key).cast("string")).withColumn("there", F.lit(True))
    filled = [m for m in mine if m.worst is not None and e.config.no_drop]
    if filled:
        frame = e.targets.select(F.col("pert").cast("string").alias("perturbation")).join(frame, "perturbation", "left")
    cells = []
    for m in mine:
        value = F.col(m.column).cast("double")
        if m.name == "expr_real_mass_ratio":
            value = value / e.mass_target
        if m in filled:
            value = F.when(value.isNull() | F.isnan(value), F.lit(m.worst)).otherwise(value)
        cells.append(F.struct(F.lit(named(m.name, e.config.de_method)).alias("metric"), value.alias("value"), (F.coalesce("there", F.lit(False)) | F.lit(m in filled)).alias("counts")))
    return frame.select("perturbation", F.explode(F.array(*cells)).alias("x")).filter("x.counts").select("perturbation", "x.metric", "x.value")


def metric_frame(e: Evaluation, name: str) -> DataFrame:
    """perturbation, metric, value of one metric."""
    m = CATALOG[name]
    return _values(e, m.family, [m])


def evaluate(e: Evaluation, names: str | list[str]) -> DataFrame:
    """The tidy frame (perturbation, metric, value); metrics of one family share one plan."""
    wanted = [CATALOG[n] for n in resolve(names, e.config.de_method) if n in CATALOG]
    out: DataFrame | None = None
    for family in dict.fromkeys(m.family for m in wanted):
        part = _values(e, family, [m for m in wanted if m.family == family])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no metric to evaluate")
    return out


def summarize(tidy: DataFrame, names: str | list[str], method: str = "wilcoxon") -> DataFrame:
    """metric, mean, agg: aggregates, and derived metrics as ratios of sums."""
    out = sc.aggregate(tidy).select("metric", "mean", "agg")
    for n in resolve(names, method):
        if n in DERIVED:
            out = out.unionByName(sc.ratio_of_sums(tidy, *DERIVED[n], n).select("metric", F.col("value").alias("mean"), F.lit("ratio_of_sums").alias("agg")))
    return out
