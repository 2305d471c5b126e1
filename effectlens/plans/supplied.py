"""Evaluation from differential-expression tables that someone else made."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import agreement, de, validation
from effectlens.plans import catalog
from effectlens.plans.evaluation import Config
from effectlens.sources import staging, tables

#: Families of metrics that tables alone answer.
FAMILIES = ("sets", "top", "signs", "spearman", "nsig", "nmae", "areas", "direction")


def prepared(spark: SparkSession, source: DataFrame | str, config: Config, name: str) -> tuple[DataFrame, dict]:
    """A table under the policies of ``config``, written once, and what was seen while it was written.

    Shares of NaN and null come from the same pass; duplicate keys and p-values
    outside 0..1 are refused.  Keys are text, as such tables name genes.
    """
    rows = de.apply_policies(tables.read_de(spark, source), config.nan_lfc_policy, config.min_abs_log2fc)
    seen = Observation(name)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    lost = lambda c: F.col(c).isNull() | F.isnan(c)
    rows = rows.observe(
        seen, F.count("*").alias("rows"), one(lost("log2_fold_change")).alias("no_fold_change"), one(lost("p_adj")).alias("no_p_adj"), one(F.col("target").isNull() | F.col("feature").isNull()).alias("no_key"),
        one((F.col("p_adj") < 0) | ((F.col("p_adj") > 1) & ~F.isnan("p_adj")) | (F.col("p_value") < 0) | ((F.col("p_value") > 1) & ~F.isnan("p_value"))).alias("beyond"),
    )
    table = staging.written(rows, f"de-{name}")
    report = seen.get
    if report["no_key"]:
        raise ValueError(f"{name}: {report['no_key']} rows lack a target or a feature")
    if report["beyond"]:
        raise ValueError(f"{name}: {report['beyond']} p-values lie outside 0..1")
    de.refuse_duplicates(table)
    return table, report


@dataclass
class Supplied:
    """Two tables as an evaluation: what the catalog's families of tables ask for."""

    real: DataFrame
    pred: DataFrame
    given: DataFrame | None = None  # target, feature: own genes that targets are mapped to
    config: Config = field(default_factory=Config)
    reports: dict[str, dict] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def own(self) -> DataFrame:
        """target, feature: the own gene of each target, by the map or where the target is measured."""
        out = staging.written(de.resolve_own(self.real, self.given), "own")
        validation.require_resolution(out)
        return out

    @cached_property
    def targets(self) -> DataFrame:
        return staging.written(self.pred.select(F.col("target").alias("pert")).distinct(), "targets")

    @cached_property
    def evidence(self) -> agreement.Evidence:
        targets = self.targets.select(F.col("pert").alias("target"))
        side = lambda df: df.select("target", "feature", "log2_fold_change", "p_value", "p_adj")
        return agreement.Evidence(side(self.real), side(self.pred), targets, self.own, self.config.p_adj_threshold)

    @property
    def table(self) -> DataFrame:
        """side and the columns of a table, both sides."""
        side = lambda df, s: df.select(F.lit(s).alias("side"), "target", "feature", "log2_fold_change", "p_value", "p_adj")
        return side(self.real, 0).unionByName(side(self.pred, 1))


def from_tables(spark: SparkSession, real: DataFrame | str, pred: DataFrame | str, config: Config | None = None, own: DataFrame | None = None, control: str | None = None) -> Supplied:
    """The evaluation of two tables (files or DataFrames): equal targets, the control none of them, keys once each."""
    config = config or Config()
    (a, seen_a), (b, seen_b) = (prepared(spark, x, config, n) for x, n in ((real, "real"), (pred, "pred")))
    validation.require_targets(a, b, str(config.control) if control is None else control)
    given = None if own is None else own.select(F.col("target").cast("string").alias("target"), F.col("feature").cast("string").alias("feature"))
    return Supplied(a, b, given, config, {"real": seen_a, "pred": seen_b})


def evaluate(s: Supplied, names: list[str] | str) -> DataFrame:
    """The tidy frame of metrics that tables answer; others are refused."""
    if isinstance(names, str):
        names = [n for n in catalog.resolve(names) if n in catalog.CATALOG and catalog.CATALOG[n].family in FAMILIES]
    elif other := [n for n in catalog.resolve(names) if n not in catalog.CATALOG or catalog.CATALOG[n].family not in FAMILIES]:
        raise ValueError(f"these need counts, not tables: {other}")
    return catalog.evaluate(s, names)
