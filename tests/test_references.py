"""Scores, baselines, references and pieces against their SQL, and small cases by hand."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from effectlens.operators import baseline, references, validation
from effectlens.plans import more
from effectlens.plans.evaluation import Config
from effectlens.streaming import pieces

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 5)
    return v


@pytest.mark.parametrize("name", sorted(more.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = more.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(more.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(*columns).fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


def counts(spark, rows):
    return spark.createDataFrame([(s, p, c, g, float(x)) for s, p, c, g, x in rows], "side int, pert int, cell bigint, gene int, x double")


def test_checks_refuse_bad_inputs(spark):
    good = [(s, p, 10 * p + i, g, 1 + i) for s in (0, 1) for p in (0, 1) for i in (0, 1) for g in (1, 2)]
    validation.require_pair(counts(spark, good), 0)
    validation.require_type(counts(spark, good), "counts")
    with pytest.raises(ValueError, match="only on one side"):
        validation.require_pair(counts(spark, [*good, (1, 7, 70, 1, 1)]), 0)
    with pytest.raises(ValueError, match="least value"):
        validation.require_type(counts(spark, [*good, (0, 1, 11, 2, -1)]), "counts")
    with pytest.raises(ValueError, match="whole"):
        validation.require_type(counts(spark, [*good, (0, 1, 11, 2, 0.5)]), "counts")
    with pytest.raises(ValueError, match="NaN"):
        validation.require_type(counts(spark, [*good, (0, 1, 11, 2, float("nan"))]), "counts")
    with pytest.raises(ValueError, match="look like counts"):
        validation.require_type(counts(spark, good), "lognorm")


def test_halves_are_disjoint_and_need_a_control(spark):
    c = counts(spark, [(0, p, 100 * p + i, 1, 1) for p in (0, 1) for i in range(5)])
    libs = c.groupBy("side", "pert", "cell").agg(F.sum("x").alias("lib"))
    out = references.split(c, libs, 3, 0).collect()
    assert len(out) == 8 and len({r["cell"] for r in out}) == 8
    with pytest.raises(ValueError, match="control"):
        references.split(c.filter("cell <> 9"), libs.filter("pert = 1"), 3, 0)


def test_emission_scale_is_zero_without_control(spark):
    p = spark.createDataFrame([(0, 0, 1, 0.0), (0, 0, 2, 2.0), (0, 1, 1, 3.0), (0, 1, 2, 4.0)], "side int, pert int, gene int, m double")
    own = spark.createDataFrame([(9, 9)], "pert int, gene int")
    g = baseline.generic_response(p, own, 0, "m")
    assert {r["gene"]: r["ratio"] for r in baseline.emission_scale(p, g, 0, "m").collect()} == {1: 0.0, 2: 2.0}


def test_pieces_from_a_stream_equal_one_run(spark, tmp_path):
    rows = [(s, p, 1000 * s + 10 * p + i, g, 1 + (p * g + i + s) % 5) for s in (0, 1) for p in range(4) for i in range(3) for g in range(1, 6)]
    both = counts(spark, rows)
    genes = spark.range(1, 6).select(F.col("id").cast("int").alias("gene"))
    own = spark.createDataFrame([(1, 1)], "pert int, gene int")
    real, pred = (both.filter(F.col("side") == s).select("pert", "cell", "gene", "x") for s in (0, 1))
    names = ["expr_mae", "expr_mse", "delta_pearson"]
    for i, perts in enumerate(([1, 2], [3])):
        pred.filter(F.col("pert").isin(perts)).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    query = pieces.score_stream(spark, f"{tmp_path}/in/*", real, genes, own, names, f"{tmp_path}/out", f"{tmp_path}/cp", Config())
    query.awaitTermination(120)
    partials = spark.read.parquet(f"{tmp_path}/out")
    merged = pieces.merge(partials, spark.createDataFrame([(1,), (2,), (3,)], "pert int"))
    whole = pieces.score_piece(real, pred.filter("pert > 0"), genes, own, names, Config())
    key = lambda df: {(r["perturbation"], r["metric"]): round(r["value"], 9) for r in df.collect()}
    assert key(merged) == key(whole) and merged.count() == 9
    with pytest.raises(ValueError, match="not scored"):
        pieces.merge(partials, spark.createDataFrame([(8,)], "pert int"))
    with pytest.raises(ValueError, match="more than once"):
        pieces.merge(partials.unionByName(partials), spark.createDataFrame([(1,)], "pert int"))
    with pytest.raises(ValueError, match="pool"):
        pieces.piece_config(Config.v1(), names)
    with pytest.raises(ValueError, match="all perturbations"):
        pieces.piece_config(Config(), ["pds_l1"])
    assert pieces.piece_config(Config(), names).auc_floor == "replace_zero"
    other = pieces.score_piece(real, pred.filter("pert = 2"), genes, own, names, Config(bulk_target_sum=1e4))
    with pytest.raises(ValueError):
        pieces.merge(pieces.score_piece(real, pred.filter("pert = 1"), genes, own, names, Config()).unionByName(other), spark.createDataFrame([(1,), (2,)], "pert int"))


def test_input_type_looks_at_every_cell(spark):
    from effectlens.operators import validation

    rows = [(side, c, 10.5 if side and c % 1500 == 0 else 10.0) for side in (0, 1) for c in range(1, 3001)]
    libs = spark.createDataFrame(rows, "side int, cell bigint, lib double")
    assert {tuple(r) for r in validation.guess_type(libs).collect()} == {(0, "counts"), (1, "lognorm")}
    assert {r["side"] for r in validation.guess_type(libs, 5).collect()} == {0, 1}


def test_command_line_runs_scores_and_builds(spark, tmp_path):
    from effectlens import __main__ as cli
    from effectlens.plans.evaluation import Config

    rows = [(p, 10 * p + c, g, float((3 * p + 7 * c + 5 * g) % 9 + (4 if p == g else 1))) for p in range(4) for c in range(6) for g in range(1, 9)]
    real = spark.createDataFrame(rows, "pert int, cell bigint, gene int, x double")
    real.write.parquet(f"{tmp_path}/real")
    real.withColumn("x", F.col("x") + (F.col("gene") % 2)).write.parquet(f"{tmp_path}/pred")
    names = "expr_mae,expr_mse,delta_pearson"
    cli.main(["run", "--real", f"{tmp_path}/real", "--pred", f"{tmp_path}/pred", "--metrics", names, "--set", "cpm_gate=1.0", "--out", f"{tmp_path}/run"], spark)
    cli.main(["baseline", "--real", f"{tmp_path}/real", "--metrics", names, "--set", "de.cpm_gate=1.0", "--seed", "3", "--out", f"{tmp_path}/base"], spark)
    cli.main(["score", "--results", f"{tmp_path}/run/agg_results.csv", "--baseline", f"{tmp_path}/base/agg_results.csv", "--out", f"{tmp_path}/score"], spark)
    got = [r["metric"] for r in spark.read.option("header", True).csv(f"{tmp_path}/score").collect()]
    assert sorted(got) == ["avg_score", "delta_pearson", "expr_mae", "expr_mse"]
    assert cli.configured("v1", ["control='ctrl'", "pds_scope=panel"]) == Config.v1().__class__(**{**Config.v1().__dict__, "control": "ctrl", "pds_scope": "panel"})
    with pytest.raises(ValueError):
        cli.configured("v2", ["nothing=1"])


def test_records_tell_differences(spark):
    from effectlens.plans import competition, identity
    from effectlens.plans.evaluation import Config

    a = identity.digest(identity.semantics(Config(), ["expr_mae"]))
    assert a == identity.digest(identity.semantics(Config(), ["mae"])) != identity.digest(identity.semantics(Config(epsilon=0.0), ["expr_mae"]))
    df = spark.range(100).selectExpr("id", "cast(id as string) as s")
    assert identity.fingerprint(df) == identity.fingerprint(df.repartition(7)) != identity.fingerprint(df.filter("id <> 5"))
    run = {"comparator": "bulk", "digest": "x", "real": "r", "metrics": ["m"]}
    assert identity.require_paired(run, run) == [] and identity.require_paired(run, run | {"digest": "y"}, waive=True) == ["digest"]
    for other in (run | {"digest": "y"}, run | {"comparator": "lognorm"}):
        with pytest.raises(ValueError):
            identity.require_paired(run, other)
    fine = spark.createDataFrame([("m", 0.5, 0.1, 0.4, 0.6)], "metric string, replicate double, replicate_sd double, replicate_min double, replicate_max double")
    identity.require_anchor(fine, ["m"])
    for given, names in ((fine, ["n"]), (fine.withColumn("replicate", F.lit(float("nan"))), ["m"]), (fine.drop("replicate"), ["m"])):
        with pytest.raises(ValueError):
            identity.require_anchor(given, names)
    assert competition.rule_digest() != competition.rule_digest(1) != competition.rule_digest(0, 2)


def test_scores_of_unusable_values(spark):
    from effectlens.plans import scoring as sc

    rows = [(float("inf"), 1.0), (0.5, float("nan")), (0.5, float("inf")), (float("nan"), 0.5), (None, 0.5), (0.5, 0.25)]
    df = spark.createDataFrame(rows, "u double, b double")
    got = [r[0] for r in df.select(sc.value_of(F.col("u"), F.col("b"), sc.BOUNDED)).collect()]
    assert got == [None, None, None, 0.0, 0.0, pytest.approx(1 / 3)]
    results = spark.createDataFrame([("de_wilcoxon_lfc_nmae", 0.6), ("expr_mae", 0.1)], "metric string, mean double")
    at = lambda raw, n: {r["metric"]: r["from_reference"] for r in sc.reference_column(results, raw, n).collect()}
    assert at(0.5, 3) == {"de_wilcoxon_lfc_nmae": pytest.approx(0.8), "expr_mae": None} and at(1.5, 3)["de_wilcoxon_lfc_nmae"] == pytest.approx(0.4)
    assert at(None, 0)["de_wilcoxon_lfc_nmae"] is None
    for raw, n in ((None, 2), (0.5, 0), (-1.0, 2), (float("nan"), 2)):
        with pytest.raises(ValueError):
            sc.reference_column(results, raw, n)
    with pytest.raises(ValueError):
        sc.scale_column(results, "low-random_high-1_v10")
    with pytest.raises(ValueError):
        sc.Scale("from_replicate", {"expr_mae": (1.0, sc.ERROR)})
    with pytest.raises(ValueError):
        sc.Scale("mine", {"expr_mae": (0.0, sc.ERROR)})
    with pytest.raises(ValueError):
        sc.with_overrides({"expr_mae": sc.ERROR}, {"mae": sc.ERROR, "expr_mae": sc.ERROR}, {"mae": "expr_mae"})
