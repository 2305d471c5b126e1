"""Tables written once to the folder that all executors share, so that plans stay short."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/effectlens-{os.getpid()}"
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package wherever the driver was started; on a cluster it comes with ``--py-files`` or is installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet and read back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
