"""Sources and sinks: DE tables, manifests, expression archives, results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "dataset string, panel_id int, context string, control_value string, path_real string, path_pred string, var_names_path string, n_cells bigint, n_genes bigint"
#: Columns of a differential-expression table: type, names it may come under, whether a table must have it.
DE_COLUMNS: dict[str, tuple[str, tuple[str, ...], bool]] = {
    "target": ("string", ("target",), True),
    "feature": ("string", ("feature",), True),
    "log2_fold_change": ("double", ("log2_fold_change",), True),
    "p_value": ("double", ("p_value",), False),
    "p_adj": ("double", ("p_adj", "fdr"), True),
}
#: Endings of files and how they are read: text columns first, so that a label such as 001 stays what it is.
_READERS: dict[tuple[str, ...], Callable[[SparkSession, str], DataFrame]] = {
    (".csv", ".csv.gz"): lambda spark, path: spark.read.option("header", True).option("inferSchema", False).csv(path),
    (".parquet", ".pq"): lambda spark, path: spark.read.parquet(path),
}


def read_de(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A differential-expression table from a DataFrame or file, in the columns of DE_COLUMNS and the size of the effect."""
    if isinstance(source, str):
        found = [read for ends, read in _READERS.items() if source.lower().endswith(ends)]
        if not found:
            raise ValueError(f"{source}: the name of a table ends in one of {sorted(x for ends in _READERS for x in ends)}")
        source = found[0](spark, source)
    given = {name: next((x for x in names if x in source.columns), None) for name, (_, names, _) in DE_COLUMNS.items()}
    if lacking := [name for name, (_, _, needed) in DE_COLUMNS.items() if needed and given[name] is None]:
        raise ValueError(f"no column for {lacking} among {source.columns}")
    typed = [(F.col(f"`{given[name]}`") if given[name] else F.lit(None)).cast(kind).alias(name) for name, (kind, _, _) in DE_COLUMNS.items()]
    return source.select(*typed).withColumn("abs_log2_fold_change", F.abs("log2_fold_change"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an artifact to score, from a file or a folder of them; relative paths are those beside the manifest."""
    out = spark.read.schema(MANIFEST).csv(path, header=True)
    if not out.limit(1).count():
        raise ValueError(f"{path}: a manifest needs one artifact at least")
    beside = path.rstrip("/").rpartition("/")[0] if path.lower().endswith(".csv") else path.rstrip("/")
    whole = lambda c: F.when(F.col(c).rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.col(c)).otherwise(F.concat(F.lit(beside + "/"), F.col(c)))
    return out.select(*[whole(c).alias(c) if c.startswith("path_") or c == "var_names_path" else F.col(c) for c in out.columns])


def read_expression(spark: SparkSession, path: str, labels: list | None = None) -> DataFrame:
    """pert, cell, gene, x from parquet partitioned by pert; only ``labels`` are read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("pert").isin(labels)) if labels is not None else df


def write_expression(df: DataFrame, path: str) -> None:
    """An archive whose perturbations can be read alone."""
    df.repartition("pert").write.mode("overwrite").partitionBy("pert").parquet(path)


def write_results(results: DataFrame, aggregate: DataFrame, outdir: str, meta: dict) -> None:
    """Tidy and aggregate tables, and the run's record."""
    results.write.mode("overwrite").parquet(os.path.join(outdir, "results.parquet"))
    ordered = aggregate.orderBy("metric") if "metric" in aggregate.columns else aggregate  # sorted at the sink only
    ordered.write.mode("overwrite").option("header", True).csv(os.path.join(outdir, "agg_results.csv"))
    if {"metric", "agg"} <= set(aggregate.columns):
        aggregate.select("metric", "agg").orderBy("metric").write.mode("overwrite").option("header", True).csv(os.path.join(outdir, "metric_aggregation.csv"))
    spark = results.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(outdir, "run_meta.json"))


def write_de(table: DataFrame, outdir: str, meta: dict) -> None:
    """The differential-expression tables of both sides beside a run's results, with the digest of the run's record."""
    for side, name in enumerate(("real", "pred")):
        mine = table.filter(F.col("side") == side).drop("side").withColumn("digest", F.lit(meta["digest"]))
        mine.write.mode("overwrite").parquet(os.path.join(outdir, f"de_{name}.parquet"))
