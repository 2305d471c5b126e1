"""Scoring by pieces: predictions arrive perturbation by perturbation, partial results are merged.

Pieces are files of predicted counts; Structured Streaming finds new ones, each
micro-batch is scored against the measured side and written under its batch
number, so that a repeated batch overwrites itself.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from effectlens.plans import catalog, identity, reference
from effectlens.plans.evaluation import Config
from effectlens.sources.store import Store

PIECE = "pert int, cell bigint, gene int, x double"
#: Metrics that need all perturbations at once; they are made from merged counts.
WHOLE_PANEL = ("nsig_spearman", "pds_l1", "pds_l2", "pds_cosine", "expr_mse_unbiased_capped")


def subset(perts: DataFrame, parts: int, index: int) -> DataFrame:
    """The perturbations at ``index``, ``index`` + ``parts`` ... of the sorted labels."""
    labels = perts.select("pert").distinct()  # a row a perturbation: some 1e4, so one window will do
    return labels.withColumn("_i", F.row_number().over(Window.orderBy("pert")) - 1).filter(F.col("_i") % parts == index).drop("_i")


def piece_config(config: Config, names: list[str]) -> Config:
    """What a piece is scored by: it can't know ranks over all perturbations, a common pool or a common least p-value."""
    if config.fdr_scope == "global":
        raise ValueError("pieces can't share one false-discovery pool")
    whole = [n for n in names if n.removeprefix("de_wilcoxon_") in WHOLE_PANEL]
    if whole:
        raise ValueError(f"these need all perturbations at once: {whole}")
    return replace(config, auc_floor="replace_zero") if config.auc_floor == "min_nonzero" else config


def scored(measured: reference.Reference, piece: DataFrame, names: list[str]) -> DataFrame:
    """perturbation, metric, value of the perturbations in ``piece`` (predicted counts), the digest of how they were scored, and of what against."""
    how = identity.digest(identity.semantics(measured.config, names))
    return catalog.evaluate(reference.against(measured, piece), names).withColumns({"scored_by": F.lit(how), "reference": F.lit(measured.digest)})


def score_piece(real: DataFrame, piece: DataFrame, genes: DataFrame, own: DataFrame, names: list[str], config: Config) -> DataFrame:
    """``scored`` against measured counts, whose tables are built for this piece."""
    return scored(reference.build(real, genes, own, piece_config(config, names)), piece, names)


def score_stream(spark: SparkSession, source: str, real: DataFrame, genes: DataFrame, own: DataFrame, names: list[str], out: str, checkpoint: str, config: Config, store: Store | None = None) -> StreamingQuery:
    """Score every piece found under ``source`` against one reference; partials go to ``out``/piece=N."""
    measured = reference.build(real, genes, own, piece_config(config, names), store)

    def score(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if batch.limit(1).count():
                scored(measured, batch, names).write.mode("overwrite").parquet(f"{out}/piece={number}")
        finally:
            batch.unpersist()

    return spark.readStream.schema(PIECE).parquet(source).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge(partials: DataFrame, expected: DataFrame) -> DataFrame:
    """One tidy frame from partials; doubled or missing perturbations are refused, and partials that were scored in different ways."""
    ways = partials.agg(F.count_distinct("scored_by").alias("n"), F.count_distinct("reference").alias("m")).first()
    if ways["n"] > 1:
        raise ValueError("the partials were scored with different settings")
    if ways["m"] > 1:
        raise ValueError("the partials were scored against different measured data")
    twice = partials.groupBy("perturbation", "metric").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"scored more than once: {[tuple(r)[:2] for r in twice]}")
    want = expected.select(F.col("pert").cast("string").alias("perturbation"))
    gap = want.join(partials.select("perturbation").distinct(), "perturbation", "left_anti").limit(20).collect()
    if gap:
        raise ValueError(f"not scored: {[r[0] for r in gap]}")
    return partials.select("perturbation", "metric", "value")


def nsig_from_counts(tidy: DataFrame, real: str = "de_wilcoxon_nsig_counts_real", pred: str = "de_wilcoxon_nsig_counts_pred") -> DataFrame:
    """metric, value: the correlation of ranks of significant counts, from merged per-perturbation counts.

    One row a perturbation enters; those without measured significant genes don't count.
    """
    part = lambda m, c: tidy.filter(F.col("metric") == m).select("perturbation", F.col("value").alias(c))
    both = part(real, "x").join(part(pred, "y"), "perturbation").filter("x > 0")
    mid = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    r = both.select(mid("x").alias("rx"), mid("y").alias("ry"))
    g = r.agg(F.count("*").alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"), F.covar_pop("rx", "ry").alias("c"))
    fine = (F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0)
    value = F.when(F.col("n") == 0, 1.0).when(fine, F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))).otherwise(-1.0)
    return g.select(F.lit("de_wilcoxon_nsig_spearman").alias("metric"), value.alias("value"))
