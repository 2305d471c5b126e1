"""``python -m effectlens run | manifest | score | baseline``: evaluate tables of counts or of differential expression, score the means, build a baseline.

Counts are parquet tables with the columns pert, cell, gene, x; ``--own`` names a
table (pert, gene) of the genes that perturbations target.  Settings come from a
preset, then from ``--config`` (a JSON file: groups of settings, or settings),
then from ``--set name=value`` or ``--set group.name=value``.
"""

from __future__ import annotations

import argparse
import ast
import json
import os
import warnings
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import validation
from effectlens.plans import baselines, catalog, identity, manifest, scoring, supplied
from effectlens.plans.evaluation import GROUPS, Config, Evaluation
from effectlens.sources import tables
from effectlens.sources.store import Files


def field_of(name: str) -> str:
    """The setting that ``name`` or ``group.name`` means; unknown ones are refused."""
    group, _, own = name.rpartition(".")
    known = GROUPS.get(group, ()) if group else tuple(f.name for f in fields(Config))
    if own not in known:
        raise ValueError(f"no setting {name!r}; there are {sorted(known) or sorted(GROUPS)}")
    return own


def configured(preset: str, changes: list[str], settings: dict | None = None) -> Config:
    """A preset with some settings changed, by a file's and then by single ones."""
    config = {"v1": Config.v1, "v2": Config}[preset]()
    flat = [(f"{k}.{n}" if k in GROUPS else k, v) for k, x in (settings or {}).items() for n, v in (x.items() if k in GROUPS else [("", x)])]
    for change in changes:
        name, _, value = change.partition("=")
        try:
            flat.append((name, ast.literal_eval(value)))
        except (ValueError, SyntaxError):
            flat.append((name, value))
    for name, value in flat:
        config = replace(config, **{field_of(name): tuple(value) if isinstance(value, list) else value})
    return config


def config_of(spark: SparkSession, a: argparse.Namespace) -> Config:
    return configured(a.preset, a.set, json.loads(Files(spark, a.config).read(a.config)) if a.config else None)


def named(metrics: str) -> list[str] | str:
    return metrics.split(",") if "," in metrics or metrics in catalog.CATALOG or metrics.startswith("de_") else metrics


def loaded(spark: SparkSession, real: str, pred: str, own: str | None, config: Config, replicates: str | None = None, most: float | None = None, guess: bool = False, discrete: bool = False) -> Evaluation:
    """An evaluation of two tables whose perturbations and genes must agree; ``most`` bounds the totals of cells, ``guess`` finds out what the values are."""
    side = lambda path, s: spark.read.parquet(path).select(F.lit(s).alias("side"), "pert", "cell", "gene", "x")
    both = side(real, 0).unionByName(side(pred, 1))
    validation.require_finite(both, "x")
    validation.require_pair(both, config.control)
    config = replace(config, input_types=validation.resolved_types(both.groupBy("side", "pert", "cell").agg(F.sum("x").alias("lib")), config.input_types, guess, discrete))
    for s, kind in enumerate(config.input_types):
        validation.require_type(both.filter(F.col("side") == s), kind, discrete)
    genes = both.select("gene").distinct()
    if own is not None:
        owns = spark.read.parquet(own).select("pert", "gene")
    else:
        owns = both.select("pert").distinct().join(genes, F.col("pert") == F.col("gene")).select("pert", "gene")
    validation.require_resolution(owns)
    e = Evaluation(both, genes, owns, config, spark.read.parquet(replicates).select("cell", "replicate") if replicates else None)
    if most is not None:
        logged = [s for s, kind in enumerate(config.input_types) if kind == "lognorm"]
        validation.require_scale(e.libs.filter(~F.col("side").isin(logged)), most)
        if logged:
            validation.require_scale(e.libs, most, both.filter(F.col("side").isin(logged)))
    return e


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    config, names = config_of(spark, a), named(a.metrics)
    if a.de_real and a.de_pred and not (a.real or a.pred):
        own = spark.read.parquet(a.own).select(F.col("pert").alias("target"), F.col("gene").alias("feature")) if a.own else None
        s = supplied.from_tables(spark, a.de_real, a.de_pred, config, own)
        tidy = supplied.evaluate(s, names)
        meta = identity.table_meta(s, names)
        tables.write_results(tidy, scoring.aggregate(tidy), a.out, meta)
        tables.write_de(s.table, a.out, meta)
        return
    if not (a.real and a.pred) or a.de_real or a.de_pred:
        raise ValueError("give --real and --pred, or --de-real and --de-pred")
    e = loaded(spark, a.real, a.pred, a.own, config, a.replicates, a.most, a.guess or a.preset == "v1", a.discrete)
    config, notes = e.config, validation.remarks(e.config.input_types, e.config.group_sums, validation.profile_of_values(e.counts))
    for note in notes:
        warnings.warn(note, stacklevel=1)
    tidy = catalog.evaluate(e, names)
    derived = {n: parts for n, parts in catalog.DERIVED.items() if n in catalog.resolve(names, config.de_method)}
    meta = identity.run_meta(e, names) | {"notes": notes, "config": asdict(config)}
    tables.write_results(tidy, catalog.summarize(tidy, names, config.de_method), a.out, meta)
    scoring.cohorts(tidy, derived).withColumn("digest", F.lit(meta["digest"])).orderBy("metric").write.mode("overwrite").option("header", True).csv(os.path.join(a.out, "cohorts.csv"))
    if "de" in e.__dict__:
        tables.write_de(e.de, a.out, meta)


def many(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest.run(spark, a.manifest, named(a.metrics), a.out, config_of(spark, a))


def beside(spark: SparkSession, table: str) -> dict | None:
    """The record that a run or a baseline left beside its table."""
    path = os.path.join(os.path.dirname(table.rstrip("/")), "run_meta.json")
    return json.loads(spark.read.text(path, wholetext=False).first()[0]) if Files(spark, path).exists(path) else None


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda path: spark.read.option("header", True).schema("metric string, mean double").csv(path)
    policies = {n: m.policy for n, m in catalog.CATALOG.items()} | catalog.DERIVED_POLICIES
    mine, theirs = beside(spark, a.results), beside(spark, a.baseline)
    if mine and theirs:
        identity.require_paired(mine, theirs, a.waive)
    elif not a.waive:
        raise ValueError("a run or its baseline has no record beside it; --waive scores them all the same")
    results = read(a.results)
    out: DataFrame = scoring.score(results, read(a.baseline), policies)
    if a.anchor:
        anchor = spark.read.option("header", True).schema("metric string, replicate double").csv(a.anchor)
        out = out.join(scoring.replicate_column(results, read(a.baseline), anchor, policies, catalog.DECISIVE), "metric", "full")
    for name in a.scale:
        out = out.join(scoring.scale_column(results, name), "metric", "full")
    out.orderBy(F.col("metric") == "avg_score", "metric").write.mode("overwrite").option("header", True).csv(a.out)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    e, names = loaded(spark, a.real, a.real, a.own, config_of(spark, a)), named(a.metrics)
    tidy, means = baselines.build(e, names, a.seed)
    tables.write_results(tidy, means, a.out, identity.run_meta(e, names) | {"seed": a.seed})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="effectlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in (("run", run), ("baseline", build), ("manifest", many)):
        q = sub.add_parser(name)
        if name == "run":
            for option in ("--real", "--pred", "--de-real", "--de-pred", "--replicates"):
                q.add_argument(option)
            q.add_argument("--most", type=float, help="largest total of a cell")
            q.add_argument("--guess", action="store_true", help="find out whether values are counts or log-normalised, as preset v1 does")
            q.add_argument("--discrete", action="store_true", help="take all values as counts")
        elif name == "baseline":
            q.add_argument("--real", required=True)
            q.add_argument("--seed", type=int, default=0)
        else:
            q.add_argument("--manifest", required=True)
        if name != "manifest":
            q.add_argument("--own")
        q.add_argument("--config")
        q.add_argument("--preset", choices=("v1", "v2"), default="v2")
        q.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        q.add_argument("--metrics", default="full")
        q.add_argument("--out", required=True)
        q.set_defaults(f=f)
    q = sub.add_parser("score")
    for name in ("--results", "--baseline", "--out"):
        q.add_argument(name, required=True)
    q.add_argument("--anchor")
    q.add_argument("--waive", action="store_true", help="score a run and a baseline that don't belong together")
    q.add_argument("--scale", action="append", default=[], choices=sorted(scoring.SCALES))
    q.set_defaults(f=score)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.f(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
