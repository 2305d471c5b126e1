"""Queries over what is built once: tables kept in a store, and pieces scored against a reference."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.plans import catalog, evaluation, more, oracle, reference
from effectlens.plans.evaluation import of
from effectlens.sources import staging
from effectlens.sources.store import Store
from effectlens.streaming import pieces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PIECES = 2
NAMES = [*more.ERRORS, "de_wilcoxon_sig_jaccard", "de_wilcoxon_direction_match", "de_wilcoxon_lfc_spearman"]
_AGREEMENT = ("sig_jaccard", "direction_match", "lfc_spearman")


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{staging.shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _cached_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a second session finds it in the store that the first one filled."""
    store = _store(spark)
    evaluation.warm(evaluation.stored(spark, sf, store), ("de",))
    table = evaluation.stored(spark, sf, store).de
    return table.select("side", "target", "feature", *[F.round(c, n).alias(c) for c, n in (("log2_fold_change", 6), ("p_value", 8), ("p_adj", 8))])


def _warm_side(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of the measured side alone, built ahead of any prediction and read back from the store."""
    e, store = of(spark, sf), _store(spark)
    real, source = e.counts.filter("side = 0"), {"tables": list(evaluation.identity(spark, sf))}
    for _ in range(2):
        found = reference.build(real, e.genes, e.own, e.config, store, source)
    return found.profile.select("side", "pert", "gene", F.round("bulk", 6).alias("value"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of NAMES from pieces that were scored against one reference."""
    e = of(spark, sf)
    perts = e.targets
    real, pred = (e.counts.filter(F.col("side") == s).select("pert", "cell", "gene", "x") for s in (0, 1))
    measured = reference.build(real, e.genes, e.own, pieces.piece_config(e.config, NAMES))
    partials = None
    for i in range(PIECES):
        part = staging.written(pieces.scored(measured, pred.join(pieces.subset(perts, PIECES, i), "pert", "left_semi"), NAMES), "partial")
        partials = part if partials is None else partials.unionByName(part)
    return pieces.merge(partials, perts)


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).filter(F.col("metric").isin(*more.ERRORS)).withColumn("value", F.round("value", 6))


def _agreement(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _pieces(spark, sf).filter(F.col("metric") == name).select("perturbation", F.round("value", 6).alias("value"))

    return query


QUERIES |= {"cch1_cached_table": _cached_table, "cch5_warm_side": _warm_side, "st2_reference_errors": _errors}
ORACLES |= {
    "cch1_cached_table": oracle.query([oracle.CORE, oracle.DE], "SELECT side, target, feature, round(lfc, 6) AS log2_fold_change, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj FROM de"),
    "cch5_warm_side": oracle.query([oracle.CORE], "SELECT side, pert, gene, round(bulk, 6) AS value FROM prof WHERE side = 0"),
    "st2_reference_errors": oracle.query(more.TIDY, "SELECT perturbation, metric, round(value, 6) AS value FROM tidy"),
}
for _short in _AGREEMENT:
    _metric = catalog.CATALOG[f"de_wilcoxon_{_short}"]
    QUERIES[f"st4_reference_{_short}"] = _agreement(_metric.name)
    ORACLES[f"st4_reference_{_short}"] = oracle.metric(_metric.family, _metric.column)
