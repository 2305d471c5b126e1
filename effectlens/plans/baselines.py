"""Building a baseline: the generic response emitted as a prediction, scored like one, and refused where it leaves no scale."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame

from effectlens.operators import baseline
from effectlens.plans import catalog, scoring
from effectlens.plans.evaluation import Evaluation
from effectlens.sources import staging


def emitted(e: Evaluation, seed: int = 0) -> Evaluation:
    """The evaluation of measured cells against resampled control cells times the generic response; both sides are counts."""
    if e.config.input_types != ("counts", "counts"):
        raise ValueError("a baseline is emitted in the space of counts; give both sides as counts")
    generic = baseline.generic_response(e.profile, e.own, e.config.control, "normalized")
    scale = baseline.emission_scale(e.profile, generic, e.config.control, "normalized")
    pred = baseline.dispersed(e.counts, e.libs, scale, e.config.control, seed)
    both = e.counts.filter("side = 0").select("side", "pert", "cell", "gene", "x").unionByName(pred)
    return Evaluation(staging.written(both, "baseline-counts"), e.genes, e.own, replace(e.config))


def degenerate(means: DataFrame, policies: dict[str, scoring.Policy]) -> list[str]:
    """Metrics whose baseline lies at or beyond the anchor, or isn't finite."""
    out = []
    for r in means.collect():  # a catalog's worth of rows
        p = policies.get(r["metric"])
        if p is None or not p.scored or p.anchor is None:
            continue
        b = r["mean"]
        if b is None or not math.isfinite(b) or not ((p.anchor - b) if p.higher else (b - p.anchor)) > 0:
            out.append(r["metric"])
    return sorted(out)


def build(e: Evaluation, names: str | list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(tidy values, means) of the baseline; a decisive metric without a usable range is an error."""
    tidy = catalog.evaluate(emitted(e, seed), names)
    means = catalog.summarize(tidy, names)
    policies = {n: m.policy for n, m in catalog.CATALOG.items()} | catalog.DERIVED_POLICIES
    if bad := [n for n in degenerate(means, policies) if n in catalog.DECISIVE or n in catalog.DERIVED]:
        raise ValueError(f"this baseline leaves no scale for {bad}")
    return tidy, means
