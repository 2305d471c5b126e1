"""Records of how results were made: settings and contents as digests, and checks that two of them belong together."""

from __future__ import annotations

import hashlib
import json
import math
import platform
from dataclasses import asdict

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.plans import catalog, scoring
from effectlens.plans.evaluation import Config, Evaluation
from effectlens.plans.supplied import Supplied

#: The version of what records mean; a change of meaning moves the number.
SEMANTICS = 1
ANCHOR = ("metric", "replicate", "replicate_sd", "replicate_min", "replicate_max")


def digest(record: dict) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of a table's rows that doesn't depend on their order or partitioning."""
    columns = sorted(columns or df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    second = F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in columns])
    n, a, b = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(second.cast("decimal(38,0)"))).first()
    kinds = dict(df.dtypes)
    return digest({"columns": [(c, kinds[c]) for c in columns], "rows": n, "sums": [str(a), str(b)]})


def comparator(config: Config) -> str:
    return "bulk" if config.group_sums and set(config.input_types) == {"counts"} else "lognorm"


def semantics(config: Config, names: list[str] | str) -> dict:
    """All that can move a value: settings, comparator, and each metric with its rule."""
    metrics = {}
    for n in catalog.resolve(names, config.de_method):
        if n in catalog.DERIVED:
            metrics[n] = {"derived": list(catalog.DERIVED[n])}
        else:
            m = catalog.CATALOG[n]
            metrics[n] = {"family": m.family, "column": m.column, "worst": m.worst if config.no_drop else None, "policy": asdict(m.policy)}
    return {"semantics": SEMANTICS, "config": asdict(config), "comparator": comparator(config), "metrics": metrics}


def environment(spark: SparkSession) -> dict:
    """Versions of what computed a result."""
    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "java": spark.sparkContext._jvm.System.getProperty("java.version")}


def run_meta(e: Evaluation, names: list[str] | str) -> dict:
    """The record that goes with a run's results."""
    spark = e.counts.sparkSession
    side = lambda s: fingerprint(e.counts.filter(F.col("side") == s), ["pert", "cell", "gene", "x"])
    return {"digest": digest(semantics(e.config, names)), "comparator": e.comparator, "real": side(0), "pred": side(1), "metrics": catalog.resolve(names, e.config.de_method), "environment": environment(spark)}


def table_meta(s: Supplied, names: list[str] | str) -> dict:
    """The record of a run over supplied tables."""
    how = semantics(s.config, names if not isinstance(names, str) else [n for n in catalog.resolve(names) if n in catalog.CATALOG])
    return {"digest": digest(how), "comparator": "tables", "real": fingerprint(s.real), "pred": fingerprint(s.pred), "metrics": sorted(how["metrics"]), "tables": s.reports, "environment": environment(s.real.sparkSession)}


def require_paired(run: dict, baseline: dict, waive: bool = False) -> list[str]:
    """A run and its baseline: another comparator is refused, other differences too unless waived (then they are returned)."""
    if run["comparator"] != baseline["comparator"]:
        raise ValueError(f"comparators differ: {run['comparator']} and {baseline['comparator']}")
    other = [k for k in ("digest", "real", "metrics") if run.get(k) != baseline.get(k)]
    if other and not waive:
        raise ValueError(f"run and baseline differ in {other}")
    return other


def require_anchor(anchor: DataFrame, names: list[str]) -> None:
    """An anchor has its columns, and each metric once with a finite replicate."""
    if tuple(anchor.columns[: len(ANCHOR)]) != ANCHOR:
        raise ValueError(f"an anchor begins with the columns {ANCHOR}, not {anchor.columns}")
    rows = anchor.select("metric", "replicate").collect()  # a catalog's worth
    have = [r["metric"] for r in rows]
    if sorted(have) != sorted(names):
        raise ValueError(f"the anchor names {sorted(have)}, wanted are {sorted(names)}")
    bad = [r["metric"] for r in rows if r["replicate"] is None or not math.isfinite(r["replicate"])]
    if bad:
        raise ValueError(f"no finite replicate for {bad}")


def scales_digest() -> str:
    return digest({n: {m: [base, asdict(p)] for m, (base, p) in s.entries.items()} for n, s in scoring.SCALES.items()})
