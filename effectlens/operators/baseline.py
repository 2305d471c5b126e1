"""The generic-response baseline: a prediction that gives every perturbation one mean response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def generic_response(profile: DataFrame, own: DataFrame, control: int, value: str) -> DataFrame:
    """gene, g: mean over measured perturbations, each gene without the one that targets it."""
    rows = profile.filter((F.col("side") == 0) & (F.col("pert") != control))
    return rows.join(own, ["pert", "gene"], "left_anti").groupBy("gene").agg(F.avg(value).alias("g"))


def tiled(profile: DataFrame, generic: DataFrame, control: int, value: str) -> DataFrame:
    """``profile`` whose predicted side is the generic response for every perturbation, the control as measured."""
    real = profile.filter("side = 0")
    pred = real.filter(F.col("pert") != control).join(generic, "gene").withColumn(value, F.col("g")).select(*profile.columns)
    both = pred.unionByName(real.filter(F.col("pert") == control)).withColumn("side", F.lit(1).cast("int"))
    return real.unionByName(both.select(*profile.columns))


def emission_scale(profile: DataFrame, generic: DataFrame, control: int, value: str) -> DataFrame:
    """gene, ratio: generic response over control, 0 where the control has none."""
    ref = profile.filter((F.col("side") == 0) & (F.col("pert") == control)).select("gene", F.col(value).alias("c"))
    return ref.join(generic, "gene", "left").select("gene", F.when(F.col("c") > 0, F.coalesce(F.try_divide("g", "c"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("ratio"))


def dispersed(counts: DataFrame, libs: DataFrame, scale: DataFrame, control: int, seed: int = 0) -> DataFrame:
    """side 1 counts: each measured cell slot takes a control cell, drawn with replacement by hash, times ``ratio``.

    Control rows are copied.  Slots meet control cells in an equi-join on the
    cell's number; the control pool is numbered without a global sort.
    """
    real = libs.filter("side = 0")
    pool = numbered(real.filter(F.col("pert") == control).select(F.col("cell").alias("source")), "source", "i")
    n = pool.agg(F.count("*").alias("pool"))
    slots = real.filter(F.col("pert") != control).select("pert", "cell").join(F.broadcast(n), F.lit(True))  # one row
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pert").cast("string"), F.col("cell").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = slots.withColumn("i", draw % F.col("pool")).join(pool, "i").select("pert", "cell", "source")
    source = counts.filter((F.col("side") == 0) & (F.col("pert") == control)).select(F.col("cell").alias("source"), "gene", "x")
    moved = drawn.join(source, "source").join(scale, "gene").select("pert", "cell", "gene", (F.col("x") * F.col("ratio")).alias("x")).filter("x <> 0")
    same = counts.filter((F.col("side") == 0) & (F.col("pert") == control)).select("pert", "cell", "gene", "x")
    return moved.unionByName(same).select(F.lit(1).cast("int").alias("side"), "pert", "cell", "gene", "x")


def numbered(df: DataFrame, key: str, name: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``name``, 0 .. n-1 by hash bucket and then key: windows hold one bucket, not the table."""
    b = df.withColumn("_b", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = b.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))  # ``buckets`` rows
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return b.withColumn("_r", inside).join(F.broadcast(base), "_b").withColumn(name, F.col("_r") + F.col("_base")).drop("_b", "_r", "_base")
