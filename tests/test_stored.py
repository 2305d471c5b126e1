"""Stores, published folders, references, manifests, supplied tables and the command line."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from effectlens import __main__ as cli
from effectlens.operators import de, profiles, validation
from effectlens.plans import artefacts, catalog, evaluation, manifest, reference, supplied
from effectlens.plans.evaluation import Config, Evaluation
from effectlens.sources import store, tables
from effectlens.streaming import pieces

NAMES = ["expr_mae", "delta_pearson", "de_wilcoxon_sig_jaccard", "expr_mse_unbiased"]


@pytest.fixture(scope="module")
def sides(spark):
    rows = [(s, p, 1000 * s + 20 * p + c, g, float((3 * p + 7 * c + 5 * g + s) % 9 + (9 if p == g else 0))) for s in (0, 1) for p in range(5) for c in range(9) for g in range(1, 8)]
    both = spark.createDataFrame([r for r in rows if r[4]], "side int, pert int, cell bigint, gene int, x double")
    genes = spark.createDataFrame([(g,) for g in range(1, 8)], "gene int")
    own = spark.createDataFrame([(p, p) for p in range(1, 5)], "pert int, gene int")
    return both, genes, own


def side(both, s):
    return both.filter(F.col("side") == s).select("pert", "cell", "gene", "x")


def values(df):
    return {(r["perturbation"], r["metric"]): round(r["value"], 9) for r in df.collect()}


# ---- store


def test_store_keeps_heals_and_tells_records_apart(spark, tmp_path):
    s, made = store.Store(spark, f"{tmp_path}/store"), []
    make = lambda: made.append(1) or spark.range(5)
    for _ in range(2):
        assert s.get_or_compute("t", {"a": 1}, make).count() == 5
    assert len(made) == 1 and s.get("t", {"a": 2}) is None and s.get("u", {"a": 1}) is None
    assert s.put("t", {"a": 1}, spark.range(9)).count() == 5  # the first writer's stands
    place = s.place("t", {"a": 1})
    os.remove(f"{place}/table/_SUCCESS")
    assert s.get("t", {"a": 1}) is None and not os.path.exists(place)
    s.put("t", {"a": 1}, spark.range(3))
    with open(f"{place}/record.json", "w") as f:
        f.write("{")
    assert s.get_or_compute("t", {"a": 1}, make).count() == 5 and not os.listdir(f"{tmp_path}/store/.staging")


def test_second_session_reads_no_counts_and_changes_miss(spark, sides, tmp_path):
    both, genes, own = sides
    s = store.Store(spark, f"{tmp_path}/store")
    first = Evaluation(both, genes, own, store=s, source={"state": 1})
    evaluation.warm(first)
    gone = both.withColumn("x", F.raise_error(F.lit("counts were read")).cast("double"))
    again = Evaluation(gone, genes, own, store=s, source={"state": 1})
    assert values(catalog.evaluate(again, NAMES)) == values(catalog.evaluate(first, NAMES))
    with pytest.raises(Exception, match="counts were read"):
        evaluation.warm(Evaluation(gone, genes, own, store=s, source={"state": 2}))
    with pytest.raises(Exception, match="counts were read"):
        evaluation.warm(Evaluation(gone, genes, own, Config(target_sum=1e4), store=s, source={"state": 1}), ("profile",))
    with pytest.raises(ValueError, match="source"):
        _ = Evaluation(both, genes, own, store=s).libs


def test_listing_sees_a_changed_file(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    one = store.listing(spark, [f"{tmp_path}/a"])
    assert one == store.listing(spark, [f"{tmp_path}/a"])
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert one != store.listing(spark, [f"{tmp_path}/a"])


# ---- published folders


def test_publishing_replaces_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/b"
    put = lambda n: store.publish(spark, path, lambda at: spark.range(n).write.parquet(f"{at}/t"), {"n": n})
    put(3)
    put(4)
    assert store.opened(spark, path) == {"n": 4} and os.listdir(tmp_path) == ["b"]

    def failing(at):
        spark.range(9).write.parquet(f"{at}/t")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.publish(spark, path, failing, {})
    assert store.opened(spark, path) == {"n": 4} and os.listdir(tmp_path) == ["b"]
    plain = store.Files.rename
    with monkeypatch.context() as m:  # the second rename fails: the old folder comes back
        m.setattr(store.Files, "rename", lambda self, a, b: False if ".staging-" in a and not b.endswith("backup") else plain(self, a, b))
        with pytest.raises(OSError):
            put(5)
    assert store.opened(spark, path) == {"n": 4}
    os.rename(path, f"{path}.backup-x")  # a crash between the renames
    assert store.opened(spark, path) == {"n": 4} and os.listdir(tmp_path) == ["b"]
    with pytest.raises(FileNotFoundError):
        store.opened(spark, f"{tmp_path}/none")
    spark.range(1).write.parquet(f"{path}/more")
    with pytest.raises(ValueError, match="as it was published"):
        store.opened(spark, path)


def test_bundles_and_submissions(spark, sides, tmp_path):
    both, genes, own = sides
    e, path = Evaluation(both, genes, own), f"{tmp_path}/bundle"
    artefacts.write_bundle(e, NAMES, path)
    measured, record = artefacts.read_bundle(spark, path)
    mine = artefacts.record(e, NAMES)
    artefacts.check_submission(mine, record)
    assert values(catalog.evaluate(reference.against(measured, side(both, 1).filter("pert > 0")), NAMES[:3])) == values(catalog.evaluate(e, NAMES[:3]))
    for key in artefacts.PEERS:
        with pytest.raises(ValueError, match=key):
            artefacts.check_submission(mine | {key: "other"}, record)
        with pytest.raises(ValueError, match=key):
            artefacts.check_submission({k: v for k, v in mine.items() if k != key}, record)
    anchor = spark.createDataFrame([("m", 0.5, 0.1, 0.4, 0.6)], "metric string, replicate double, replicate_sd double, replicate_min double, replicate_max double")
    artefacts.write_anchor(anchor, spark.createDataFrame([(0, "m", 0.5)], "split_index int, metric string, value double"), f"{tmp_path}/anchor", {"real": "r"})
    assert artefacts.resolve_anchor(spark, None, f"{tmp_path}/anchor", ["m"], {"real": "r"}).count() == 1
    for given, kept, names, like in ((None, None, ["m"], None), (None, f"{tmp_path}/none", ["m"], None), (f"{tmp_path}/anchor", None, ["n"], None), (f"{tmp_path}/anchor", None, ["m"], {"real": "s"})):
        with pytest.raises(ValueError):
            artefacts.resolve_anchor(spark, given, kept, names, like)


# ---- references and pieces


def test_pieces_against_one_reference_read_no_measured_counts(spark, sides):
    both, genes, own = sides
    config = pieces.piece_config(Config(), NAMES)
    measured = reference.build(side(both, 0), genes, own, config)
    parts = [pieces.scored(measured, side(both, 1).filter(F.col("pert").isin(p)), NAMES) for p in ([1, 3], [2, 4])]
    merged = pieces.merge(parts[0].unionByName(parts[1]), spark.createDataFrame([(p,) for p in range(1, 5)], "pert int"))
    assert values(merged) == values(catalog.evaluate(Evaluation(both, genes, own, config), NAMES))
    changed = reference.build(side(both, 0).withColumn("x", F.col("x") + (F.col("cell") == 3).cast("int")), genes, own, config)
    other = pieces.scored(changed, side(both, 1).filter("pert = 2"), NAMES)
    with pytest.raises(ValueError, match="different measured data"):
        pieces.merge(parts[0].unionByName(other), spark.createDataFrame([(1,)], "pert int"))
    with pytest.raises(ValueError, match="not measured"):
        reference.against(measured, side(both, 1).withColumn("pert", F.col("pert") + 50))
    with pytest.raises(ValueError, match="genes beyond"):
        reference.against(measured, side(both, 1).withColumn("gene", F.col("gene") + 50))
    for wrong in (Config(control_source="pred"), Config(de_method="deseq2"), Config(fdr_scope="global")):
        with pytest.raises(ValueError):
            reference.build(side(both, 0), genes, own, wrong)


def test_sides_must_have_the_same_perturbations(spark, sides):
    both, genes, own = sides
    with pytest.raises(ValueError, match="one side only"):
        _ = Evaluation(both.filter("not (side = 1 and pert = 3)"), genes, own).profile
    with pytest.raises(ValueError, match="control"):
        _ = Evaluation(both.filter("pert > 0"), genes, own).profile


# ---- manifests


def test_manifest_runs_by_context(spark, sides, tmp_path):
    both, genes, own = sides
    genes.write.parquet(f"{tmp_path}/genes")
    lines = ["dataset,panel_id,context,control_value,path_real,path_pred,var_names_path,n_cells,n_genes"]
    for c, part in (("A", "cell % 2 = 0"), ("B", "cell % 2 = 1")):
        for s, name in enumerate(("real", "pred")):
            tables.write_expression(side(both.filter(part), s), f"{tmp_path}/{c}/{name}")
        lines.append(f"d,1,{c},0,{c}/real,{tmp_path}/{c}/pred,genes,,")
    with open(f"{tmp_path}/m.csv", "w") as f:
        f.write("\n".join(lines))
    for _ in range(2):  # the second run finds the first one's artifacts
        cli.main(["manifest", "--manifest", f"{tmp_path}/m.csv", "--metrics", "expr_mae,expr_mse", "--out", f"{tmp_path}/out"], spark)
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/out/{name}.csv")
    want = {c: values(catalog.evaluate(Evaluation(both.filter(p), genes, own), ["expr_mae", "expr_mse"])) for c, p in (("A", "cell % 2 = 0"), ("B", "cell % 2 = 1"))}
    got = {(r["context"], r["perturbation"], r["metric"]): round(float(r["value"]), 9) for r in read("per_pert").collect()}
    assert got == {(c, *k): v for c, x in want.items() for k, v in x.items()}
    mean = {c: sum(v for (_, m), v in x.items() if m == "expr_mae") / 4 for c, x in want.items()}
    assert {r["context"]: float(r["value"]) for r in read("per_context").filter("metric = 'expr_mae'").collect()} == pytest.approx(mean)
    assert float(read("overall").filter("metric = 'expr_mae'").first()["value"]) == pytest.approx(sum(mean.values()) / 2)
    one = spark.createDataFrame([("d", 1, "A", "p", "m", float("nan"))], "dataset string, panel_id int, context string, perturbation string, metric string, value double")
    assert math.isnan(manifest.per_context(one).first()["value"]) and math.isnan(manifest.overall(manifest.per_context(one)).first()["value"])
    with pytest.raises(ValueError, match="ratio of sums"):
        manifest.per_context(one.withColumn("metric", F.lit("expr_mse_unbiased_capped_norm")))
    unit = {"dataset": "d", "panel_id": 1, "context": "A"}
    with pytest.raises(ValueError, match="twice"):
        manifest.per_perturbation(spark, [(unit, lambda: Evaluation(both, genes, own)), (unit, None)], ["expr_mae"], f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="at least"):
        manifest.per_perturbation(spark, [], ["expr_mae"], f"{tmp_path}/none")


# ---- supplied tables


def test_supplied_tables_end_to_end(spark, sides, tmp_path):
    both, genes, own = sides
    e = Evaluation(both, genes, own)
    for s, name in enumerate(("real", "pred")):
        e.de.filter(F.col("side") == s).drop("side").withColumnRenamed("p_adj", "fdr").coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    names = "de_wilcoxon_sig_jaccard,de_wilcoxon_direction_match"
    cli.main(["run", "--de-real", f"{tmp_path}/real.csv", "--de-pred", f"{tmp_path}/pred.csv", "--metrics", names, "--out", f"{tmp_path}/out"], spark)
    assert values(spark.read.parquet(f"{tmp_path}/out/results.parquet")) == values(catalog.evaluate(e, names.split(",")))
    digest = spark.read.parquet(f"{tmp_path}/out/de_real.parquet").first()["digest"]
    meta = json.loads(spark.read.text(f"{tmp_path}/out/run_meta.json").first()[0])
    assert meta["digest"] == digest and meta["tables"]["real"]["rows"] == e.de.filter("side = 0").count()
    real, pred = (e.de.filter(F.col("side") == s).drop("side") for s in (0, 1))
    for a, b, what in (
        (real.unionByName(real.limit(1)), pred, "duplicate"), (real.filter("target > 1"), pred, "one table only"), (real.withColumn("p_adj", F.lit(2.0)), pred, "outside"),
        (real.withColumn("feature", F.lit(None).cast("int")), pred, "lack a target"), (real.withColumn("target", F.lit(0)).dropDuplicates(["feature"]), pred.withColumn("target", F.lit(0)).dropDuplicates(["feature"]), "control"),
    ):
        with pytest.raises(ValueError, match=what):
            supplied.from_tables(spark, a, b)
    s = supplied.from_tables(spark, real, pred)
    with pytest.raises(ValueError, match="need counts"):
        supplied.evaluate(s, ["expr_mae"])
    lost = real.withColumn("feature", F.col("feature") + 100)
    with pytest.raises(ValueError, match="measured gene"):
        supplied.evaluate(supplied.from_tables(spark, lost, pred.withColumn("feature", F.col("feature") + 100)), ["de_wilcoxon_lfc_nmae"])
    mapped = spark.createDataFrame([(p, p + 100) for p in range(1, 5)], "target int, feature int")
    assert supplied.evaluate(supplied.from_tables(spark, lost, pred.withColumn("feature", F.col("feature") + 100), own=mapped), "full").count() > 0


# ---- false-discovery rates, noise, checks


def test_rates_by_ranges_equal_one_sort(spark):
    rows = [(i % 2, i, None if i % 50 == 3 else float("nan") if i % 50 == 4 else ((i * 7919) % 1000) / 1000.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "side int, k int, p double")
    for scope in (["side"], []):
        one, ranges = de.benjamini_hochberg(df, "p", scope, ["k"]), de.benjamini_hochberg_wide(df, "p", scope, ["k"])
        key = lambda d: {(r["side"], r["k"]): None if r["p_adj"] is None else "nan" if math.isnan(r["p_adj"]) else r["p_adj"] for r in d.collect()}  # noqa: B023, E731
        assert key(one) == key(ranges)
    assert de.benjamini_hochberg_wide(df.limit(0), "p", ["side"], ["k"]).count() == 0


def test_noise_is_the_same_in_any_partitioning(spark):
    df = spark.createDataFrame([(0, 1, c, g, float(40 + c % 5)) for c in range(50) for g in range(10)], "side int, pert int, cell bigint, gene int, x double")
    total = df.agg(F.sum("x")).first()[0]
    for kind, level in (("downsample", 0.3), ("gaussian", 0.2)):
        a, b = (profiles.noise(d, level, 5, kind) for d in (df, df.repartition(7)))
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and profiles.noise(df, 0, 5, kind) is df
        mean = a.agg(F.sum("x")).first()[0] / total
        assert mean == pytest.approx(0.7 if kind == "downsample" else math.exp(0.02), abs=0.03)
    var = profiles.thinned(df.withColumn("x", F.lit(40.0)), 0.5, 9).agg(F.var_samp("x")).first()[0]
    assert var == pytest.approx(40 * 0.25, rel=0.25)
    assert profiles.noise(df, 1.0, 5, "downsample").count() == 0 and profiles.noise(df, 5.0, 5, "downsample").count() == 0
    for bad in (lambda: profiles.thinned(df.withColumn("x", F.col("x") + 0.5), 0.5, 1), lambda: profiles.noise(df, -1, 1), lambda: profiles.noise(df, 1, 1, "other")):
        with pytest.raises(ValueError):
            bad()


def test_scales_types_and_remarks(spark):
    libs = spark.createDataFrame([(0, 1, 1, 10.0), (1, 1, 2, 10.5)], "side int, pert int, cell bigint, lib double")
    assert validation.resolved_types(libs, ("counts", "counts")) == ("counts", "counts")
    assert validation.resolved_types(libs, ("counts", "counts"), guess=True) == ("counts", "lognorm")
    assert validation.resolved_types(libs, ("counts", "lognorm"), guess=True, allow_discrete=True) == ("counts", "counts")
    logged = spark.createDataFrame([(0, 1, 1, 1, math.log1p(100.0)), (0, 1, 2, 1, math.log1p(60.0)), (0, 1, 2, 2, math.log1p(60.0)), (0, 1, 3, 1, float("nan"))], "side int, pert int, cell bigint, gene int, x double")
    assert {r["cell"] for r in validation.beyond_scale_logged(logged, 100.0).collect()} == {2, 3}
    with pytest.raises(ValueError):
        validation.require_scale(libs, 100.0, logged)
    with pytest.raises(ValueError):
        validation.require_scale(libs, 10.2)
    validation.require_scale(libs, 11.0)
    seen = validation.profile_of_values(spark.createDataFrame([(0, 1.0), (1, 1.25)], "side int, x double"))
    assert len(validation.remarks(("counts", "lognorm"), True)) == 2 and len(validation.remarks(("counts", "counts"), True, seen)) == 1


def test_settings_from_files_and_groups(spark, sides, tmp_path):
    assert cli.configured("v2", ["de.cpm_gate=2.0"], {"de": {"cpm_gate": 1.0, "epsilon": 0.5}, "control": "c", "norm": {"input_types": ["counts", "lognorm"]}}) == Config(cpm_gate=2.0, epsilon=0.5, control="c", input_types=("counts", "lognorm"))
    for wrong in (["pds.cpm_gate=1"], ["other.cpm_gate=1"], ["cpm=1"]):
        with pytest.raises(ValueError):
            cli.configured("v2", wrong)
    both, _, own = sides
    for s, name in enumerate(("real", "pred")):
        side(both, s).write.parquet(f"{tmp_path}/{name}")
    own.write.parquet(f"{tmp_path}/own")
    with open(f"{tmp_path}/settings.json", "w") as f:
        json.dump({"de": {"cpm_gate": 1.0}}, f)
    common = ["--own", f"{tmp_path}/own", "--config", f"{tmp_path}/settings.json", "--metrics", "expr_mae,de_wilcoxon_sig_jaccard"]
    cli.main(["run", "--real", f"{tmp_path}/real", "--pred", f"{tmp_path}/pred", "--most", "1000", *common, "--out", f"{tmp_path}/run"], spark)
    meta = json.loads(spark.read.text(f"{tmp_path}/run/run_meta.json").first()[0])
    assert meta["config"]["cpm_gate"] == 1.0 and meta["notes"] == []
    assert {r["agg"] for r in spark.read.option("header", True).csv(f"{tmp_path}/run/metric_aggregation.csv").collect()} == {"mean"}
    assert spark.read.parquet(f"{tmp_path}/run/de_pred.parquet").count() > 0
    with pytest.raises(ValueError, match="beyond"):
        cli.main(["run", "--real", f"{tmp_path}/real", "--pred", f"{tmp_path}/pred", "--most", "10", *common, "--out", f"{tmp_path}/x"], spark)
    with pytest.raises(ValueError, match="give --real"):
        cli.main(["run", "--real", f"{tmp_path}/real", *common, "--out", f"{tmp_path}/x"], spark)
    cli.main(["baseline", "--real", f"{tmp_path}/real", "--own", f"{tmp_path}/own", "--metrics", "expr_mae,expr_mse", "--out", f"{tmp_path}/base"], spark)
    score = ["score", "--results", f"{tmp_path}/run/agg_results.csv", "--baseline", f"{tmp_path}/base/agg_results.csv", "--out", f"{tmp_path}/score"]
    with pytest.raises(ValueError, match="differ"):
        cli.main(score, spark)
    cli.main([*score, "--waive"], spark)
    bare = spark.createDataFrame([("expr_mae", 0.5)], "metric string, mean double")
    bare.write.option("header", True).csv(f"{tmp_path}/bare/agg.csv")
    with pytest.raises(ValueError, match="record"):
        cli.main([*score[:3], "--baseline", f"{tmp_path}/bare/agg.csv", "--out", f"{tmp_path}/s2"], spark)
