"""Anchors and bundles of a measured side as published folders, and the checks of a submission against them."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.plans import anchoring, competition, identity, reference
from effectlens.plans.evaluation import Config, Evaluation
from effectlens.sources import store

#: Fields in which a submission must agree with the bundle that it is scored against.
PEERS = ("comparator", "real", "genes", "perturbations", "control", "mass_target", "effective_types", "semantics", "digest", "rule")


def record(e: Evaluation, names: list[str] | str) -> dict:
    """What a measured side is and how it is to be scored: the fields of PEERS."""
    real = e.counts.filter("side = 0")
    return {
        "comparator": e.comparator, "real": identity.fingerprint(real, ["pert", "cell", "gene", "x"]), "genes": identity.fingerprint(e.genes), "control": e.config.control,
        "perturbations": identity.fingerprint(real.select(F.col("pert").cast("string").alias("pert")).distinct()), "mass_target": e.mass_target, "effective_types": list(e.config.input_types),
        "semantics": [identity.SEMANTICS, reference.SEMANTICS], "digest": identity.digest(identity.semantics(e.config, names)), "rule": competition.conforming_digest(e.config, names),
    }


def check_submission(mine: dict, published: dict, peers: tuple[str, ...] = PEERS) -> None:
    """Every field must be there on both sides, and equal."""
    wrong = [k for k in peers if k not in mine or k not in published or mine[k] != published[k]]
    if wrong:
        raise ValueError(f"the submission differs from the published data in {wrong}")


def write_bundle(e: Evaluation, names: list[str] | str, path: str) -> dict:
    """Publish the measured side's tables with their record; a bundle that was there is replaced whole."""
    spark = e.counts.sparkSession
    real = e.counts.filter("side = 0").select("pert", "cell", "gene", "x")
    made = reference.build(real, e.genes, e.own, e.config)
    what = record(e, names) | {"names": names, "config": asdict(e.config), "reference": made.record}

    def write(folder: str) -> None:
        for name in (*reference.TABLES, "genes", "own"):
            getattr(made, name).write.parquet(f"{folder}/{name}")

    store.publish(spark, path, write, what)
    return what


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> tuple[reference.Reference, dict]:
    """The reference that a bundle holds, and its record."""
    what = store.opened(spark, path, verify)
    if what["reference"]["semantics"] != reference.SEMANTICS or what["semantics"][0] != identity.SEMANTICS:
        raise ValueError(f"{path} was made under other semantics: {what['semantics']}")
    tables = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in (*reference.TABLES, "genes", "own")}
    config = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in what["config"].items()})
    return reference.Reference(tables.pop("genes"), tables.pop("own"), config, what["reference"], **tables), what


def replicate_anchor(e: Evaluation, names: list[str] | str, path: str, base_seed: int = 0, n_splits: int = anchoring.SPLITS) -> DataFrame:
    """Make the anchor of a measured side and publish it with its record, and the rule's digest where it is a competition's."""
    splits = anchoring.split_values(e, names, base_seed, n_splits)
    found = anchoring.anchor(splits)
    dealt = anchoring.seeds(base_seed, n_splits)
    what = record(e, names) | {"seeds": list(dealt), "rule": competition.conforming_digest(e.config, names, dealt)}
    write_anchor(found, splits, path, what)
    return found


def write_anchor(anchor: DataFrame, splits: DataFrame, path: str, what: dict) -> None:
    """Publish an anchor with the values of its splits."""

    def write(folder: str) -> None:
        anchor.coalesce(1).write.parquet(f"{folder}/anchor")  # a row a metric
        splits.coalesce(1).write.parquet(f"{folder}/splits")

    store.publish(anchor.sparkSession, path, write, what)


def read_anchor(spark: SparkSession, path: str, names: list[str], like: dict | None = None) -> DataFrame:
    """A published anchor of these metrics; ``like`` names fields of its record that must agree."""
    what = store.opened(spark, path)
    if wrong := [k for k, v in (like or {}).items() if what.get(k) != v]:
        raise ValueError(f"the anchor at {path} belongs to other data: {wrong}")
    found = spark.read.parquet(f"{path.rstrip('/')}/anchor")
    identity.require_anchor(found, names)
    return found


def resolve_anchor(spark: SparkSession, given: str | None, kept: str | None, names: list[str], like: dict | None = None) -> DataFrame:
    """The anchor at ``given``, else the one ``kept`` for these data."""
    for path in (given, kept):
        if path is not None and (path == given or store.Files(spark, path).exists(path)):
            return read_anchor(spark, path, names, like)
    raise ValueError("no anchor was given, and none was kept for these data")
