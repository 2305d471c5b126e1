"""Runs over many artifacts: the rows of a manifest, scored one after the other and summed up by context.

Every artifact is an evaluation of its own, as it has its own control.  Its
values are written under its key and not made again when a run is repeated.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.plans import catalog
from effectlens.plans.evaluation import Config, Evaluation
from effectlens.sources import tables
from effectlens.sources.store import Files, digest

UNIT = ["dataset", "panel_id", "context"]


def loaded(spark: SparkSession, row: dict, config: Config) -> Evaluation:
    """The evaluation of a manifest's row: counts (pert, cell, gene, x) of both sides, and the genes of its axis."""
    side = lambda path, s: tables.read_expression(spark, path).select(F.lit(s).alias("side"), "pert", "cell", "gene", "x")
    both = side(row["path_real"], 0).unionByName(side(row["path_pred"], 1))
    genes = spark.read.parquet(row["var_names_path"]).select("gene") if row.get("var_names_path") else both.select("gene").distinct()
    kind = dict(both.dtypes)["pert"]
    control = spark.range(1).select(F.lit(row["control_value"]).cast(kind).alias("c")).first()["c"] if row.get("control_value") is not None else config.control
    own = both.select("pert").distinct().join(genes, F.col("pert") == F.col("gene")).select("pert", "gene")
    return Evaluation(both, genes, own, replace(config, control=control))


def keyed(tidy: DataFrame, unit: dict) -> DataFrame:
    """dataset, panel_id, context, perturbation, metric, value."""
    kinds = {"dataset": "string", "panel_id": "int", "context": "string"}
    return tidy.select(*[F.lit(unit[c]).cast(k).alias(c) for c, k in kinds.items()], "perturbation", "metric", F.col("value").cast("double").alias("value"))


def per_perturbation(spark: SparkSession, artifacts: Iterable[tuple[dict, Callable[[], Evaluation]]], names: list[str] | str, out: str) -> DataFrame:
    """Values of all artifacts; those that ``out`` has already are read from there.  A unit that comes twice is refused."""
    files, done = Files(spark, out), []
    for unit, make in artifacts:
        key = {c: unit[c] for c in UNIT}
        if key in [x for x, _ in done]:
            raise ValueError(f"the manifest names {key} twice")
        place = posixpath.join(out, digest(key | {"names": names, "artifact": {k: v for k, v in unit.items() if k not in UNIT}})[:24])
        if not files.exists(f"{place}/_SUCCESS"):
            keyed(catalog.evaluate(make(), names), key).write.mode("overwrite").parquet(place)
        done.append((key, place))
    if not done:
        raise ValueError("a manifest needs one artifact at least")
    return spark.read.parquet(*[place for _, place in done])


def per_context(values: DataFrame, medians: tuple[str, ...] = ()) -> DataFrame:
    """dataset, panel_id, context, metric, value, agg: mean or median over perturbations, NaN and null skipped; none left is NaN."""
    if derived := values.filter(F.col("metric").isin(*catalog.DERIVED)).select("metric").limit(1).collect():
        raise ValueError(f"{derived[0][0]} is a ratio of sums: it has no values to average")
    v = F.when(~F.isnan("value"), F.col("value"))
    median = F.col("metric").isin(*medians) if medians else F.lit(False)
    g = values.groupBy(*UNIT, "metric").agg(F.avg(v).alias("_mean"), F.median(v).alias("_median"))
    return g.select(*UNIT, "metric", F.coalesce(F.when(median, F.col("_median")).otherwise(F.col("_mean")), F.lit(float("nan"))).alias("value"), F.when(median, "median").otherwise("mean").alias("agg"))


def overall(contexts: DataFrame) -> DataFrame:
    """metric, value: the mean of contexts, whatever was taken over perturbations."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return contexts.groupBy("metric").agg(F.coalesce(F.avg(v), F.lit(float("nan"))).alias("value"))


def run(spark: SparkSession, path: str, names: list[str] | str, out: str, config: Config | None = None, medians: tuple[str, ...] = ()) -> None:
    """Score a manifest; per_pert, per_context and overall are written as CSV."""
    rows = [r.asDict() for r in tables.read_manifest(spark, path).collect()]  # a row an artifact
    values = per_perturbation(spark, [(r, lambda r=r: loaded(spark, r, config or Config())) for r in rows], names, posixpath.join(out, "artifacts"))
    contexts = per_context(values, medians)
    for name, df, order in (("per_pert", values, [*UNIT, "perturbation", "metric"]), ("per_context", contexts, [*UNIT, "metric"]), ("overall", overall(contexts), ["metric"])):
        df.orderBy(*order).write.mode("overwrite").option("header", True).csv(posixpath.join(out, f"{name}.csv"))
