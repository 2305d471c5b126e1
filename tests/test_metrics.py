"""Closed-form cases of the metrics over hand-made DE tables, and brute force on small matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlens.functions import numeric
from effectlens.operators import agreement, de, profiles
from effectlens.plans import catalog, scoring
from effectlens.sources import tables

SCHEMA = "target string, feature string, log2_fold_change double, p_value double, p_adj double"


def table(spark, rows):
    return spark.createDataFrame([(t, f, float(l) if l is not None else None, float(p), float(p)) for t, f, l, p in rows], SCHEMA)


def evidence(spark, real, pred, own=()):
    names = sorted({r[0] for r in real} | {r[0] for r in pred})
    targets = spark.createDataFrame([(n,) for n in names], "target string")
    return agreement.Evidence(table(spark, real), table(spark, pred), targets, spark.createDataFrame(list(own), "target string, feature string"))


def values(df, column):
    return {r["target"]: r[column] for r in df.collect()}


def test_erfc_matches_math(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.9, 2.0, 2.1, 3.0, 5.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(numeric.erfc_sql("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-9)


def test_jaccard_excludes_the_own_gene_and_empty_union_is_one(spark):
    real = [("A", "A", 3, 0.01), ("A", "g1", 1, 0.01), ("A", "g2", 1, 0.9), ("B", "g1", 1, 0.9)]
    pred = [("A", "A", 3, 0.9), ("A", "g1", 1, 0.01), ("A", "g2", 1, 0.01), ("B", "g1", 1, 0.9)]
    got = values(agreement.set_metrics(evidence(spark, real, pred, [("A", "A")])), "sig_jaccard")
    assert got == {"A": 0.5, "B": 1.0}


def test_nmae_anchors(spark):
    genes = [(f"g{i}", (-1) ** i * (1 + i)) for i in range(12)]
    real = [("A", g, x, 0.01) for g, x in genes]
    for factor, want in ((1, 0.0), (0, 1.0), (-1, 2.0)):
        pred = [("A", g, factor * x, 0.5) for g, x in genes]
        assert values(agreement.fold_change_nmae(evidence(spark, real, pred)), "lfc_nmae")["A"] == pytest.approx(want)
    short = evidence(spark, real[:9], real[:9])
    assert values(agreement.fold_change_nmae(short), "lfc_nmae") == {}


def test_overlap_lengths(spark):
    real = [("A", f"g{i}", 10 - i, 0.01 if i < 4 else 0.9) for i in range(6)]
    pred = [("A", f"g{i}", i, 0.01) for i in range(6)]
    got = agreement.top_metrics(evidence(spark, real, pred)).first()
    assert got["overlap"] == pytest.approx(2 / 4)  # the four largest predicted are g5 g4 g3 g2
    assert got["precision"] == pytest.approx(4 / 6)


def test_auc_by_hand(spark):
    real = [("A", "a", 1, 0.01), ("A", "b", 1, 0.9), ("A", "c", 1, 0.01), ("A", "d", 1, 0.9)]
    pred = [("A", "a", 1, 0.001), ("A", "b", 1, 0.01), ("A", "c", 1, 0.02), ("A", "d", 1, 0.5)]
    got = agreement.area_metrics(evidence(spark, real, pred)).first()
    assert got["roc_auc"] == pytest.approx(0.75)
    assert got["pr_auc"] == pytest.approx((1 + 2 / 3) / 2)


def test_direction_counts_infinities_but_not_nan_or_zero(spark):
    real = [("A", "a", float("inf"), 0.01), ("A", "b", float("nan"), 0.01), ("A", "c", 0.0, 0.01), ("A", "d", -1, 0.01)]
    pred = [("A", "a", 2, 0.01), ("A", "b", 1, 0.01), ("A", "c", 1, 0.01), ("A", "d", 1, 0.01)]
    got = agreement.direction_metrics(evidence(spark, real, pred)).first()
    assert got["direction_precision"] == pytest.approx(0.5)
    assert got["direction_coverage"] == pytest.approx(2 / 4)


def test_bh_matches_definition_and_keeps_nan(spark):
    p = [0.01, 0.04, 0.03, 0.005, float("nan")]
    df = spark.createDataFrame([("A", f"g{i}", x) for i, x in enumerate(p)], "target string, feature string, p double")
    got = {r["feature"]: r["p_adj"] for r in de.benjamini_hochberg(df, "p", ["target"], ["target", "feature"]).collect()}
    assert got["g3"] == pytest.approx(0.02) and got["g0"] == pytest.approx(0.02) and got["g2"] == pytest.approx(0.04) and got["g1"] == pytest.approx(0.04)
    assert math.isnan(got["g4"])


def small_counts(spark, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.poisson(1.5, (2, 3, 8, 5)).astype(float)
    x[..., 0] += 1  # no empty cell
    rows = [(s, p, p * 100 + c, g, float(x[s, p, c, g])) for s in range(2) for p in range(3) for c in range(8) for g in range(5) if x[s, p, c, g] > 0]
    return x, spark.createDataFrame(rows, "side int, pert int, cell bigint, gene int, x double")


def test_rank_sum_and_jackknife_against_brute_force(spark):
    x, counts = small_counts(spark)
    libs = profiles.libraries(counts)
    sizes = profiles.group_sizes(libs)
    vals = profiles.normalized(counts, libs)
    prof = profiles.profiles(vals, sizes, spark.createDataFrame([(g,) for g in range(5)], "gene int"))
    got = {(r["side"], r["pert"], r["gene"]): r["z"] for r in de.rank_sum(vals, sizes, prof, 0).collect()}
    v = x * 1e6 / x.sum(axis=-1, keepdims=True)
    for (s, p, g), z in got.items():
        a, b = v[s, p, :, g], v[0, 0, :, g]
        u = sum((i > j) + 0.5 * (i == j) for i in a for j in b)
        n = 16
        t = np.unique(np.r_[a, b], return_counts=True)[1]
        var = 64 / 12 * (17 - (t**3 - t).sum() / (n * (n - 1)))
        assert z == pytest.approx((u - 32) / math.sqrt(var) if var > 0 else 0.0, abs=1e-9)
    jk = {(r["side"], r["pert"]): r["jk"] for r in profiles.jackknife(counts, libs, prof).collect()}
    for (s, p), j in jk.items():
        y = x[s, p]
        loo = np.array([np.log1p(5e4 * np.delete(y, i, 0).sum(0) / np.delete(y, i, 0).sum()) for i in range(8)])
        assert j == pytest.approx(7 / 8 * ((loo - loo.mean(0)) ** 2).sum(), rel=1e-9)


def test_results_do_not_depend_on_partitioning(spark):
    _, counts = small_counts(spark)
    def run(c):
        libs = profiles.libraries(c)
        p = profiles.profiles(profiles.normalized(c, libs), profiles.group_sizes(libs), spark.createDataFrame([(g,) for g in range(5)], "gene int"))
        return {(r["side"], r["pert"], r["gene"]): round(r["bulk"], 9) for r in p.collect()}
    assert run(counts.repartition(1)) == run(counts.repartition(7, "gene"))


def test_halves_are_disjoint_and_even(spark):
    _, counts = small_counts(spark)
    rows = profiles.halves(profiles.libraries(counts), 5).groupBy("side", "pert", "half").count().collect()
    assert len(rows) == 12 and {r["count"] for r in rows} == {4}


def test_scores_of_baseline_anchor_and_bad_values(spark):
    base = spark.createDataFrame([("expr_mae", 2.0), ("delta_pearson", 0.2)], "metric string, mean double")
    policies = {m.name: m.policy for m in catalog.CATALOG.values()}
    def run(a, b):
        df = spark.createDataFrame([("expr_mae", a), ("delta_pearson", b)], "metric string, mean double")
        return {r["metric"]: r["from_baseline"] for r in scoring.score(df, base, policies).collect()}
    assert run(2.0, 0.2) == {"expr_mae": 0.0, "delta_pearson": 0.0, "avg_score": 0.0}
    assert run(0.0, 1.0) == {"expr_mae": 1.0, "delta_pearson": 1.0, "avg_score": 1.0}
    worse = run(4.0, -1.0)
    assert worse["expr_mae"] == pytest.approx(-(2.0**2 - 1) / 2) and worse["delta_pearson"] == 0.0


def test_aggregates_skip_nan(spark):
    tidy = spark.createDataFrame([("A", "m", 1.0), ("B", "m", float("nan")), ("C", "m", 3.0), ("A", "n", float("nan"))], "perturbation string, metric string, value double")
    got = {r["metric"]: r["mean"] for r in scoring.aggregate(tidy).collect()}
    assert got["m"] == 2.0 and math.isnan(got["n"])
    c = {r["metric"]: (r["n_rows"], r["n_used"], r["n_nan"]) for r in scoring.cohorts(tidy).collect()}
    assert c["m"] == (3, 2, 1)


def test_catalog_counts_and_names():
    assert len([m for m in catalog.CATALOG.values() if "full" in m.profiles]) + len(catalog.DERIVED) == 54
    assert len(catalog.resolve("vcc2026")) == 10 and len(catalog.resolve("de")) == 41 and len(catalog.resolve("minimal")) == 8
    assert catalog.resolve(["mae"]) == ["expr_mae"]
    with pytest.raises(ValueError):
        catalog.resolve(["nothing"])


def test_de_table_source(spark, tmp_path):
    path = str(tmp_path / "de.csv")
    with open(path, "w") as f:
        f.write("target,feature,log2_fold_change,fdr\n001,1e5,-2.0,0.01\n")
    row = tables.read_de(spark, path).first()
    assert (row["target"], row["feature"], row["p_adj"], row["p_value"], row["abs_log2_fold_change"]) == ("001", "1e5", 0.01, None, 2.0)
    with pytest.raises(ValueError):
        tables.read_de(spark, "x.json")
    with pytest.raises(ValueError):
        tables.read_de(spark, tables.read_de(spark, path).drop("feature"))


def test_manifest_paths(spark, tmp_path):
    head = "dataset,panel_id,context,control_value,path_real,path_pred,var_names_path,n_cells,n_genes\n"
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write(head + "a,1,c,ctrl,real,/data/pred,s3://x/genes,10,20\n")
    row = tables.read_manifest(spark, path).first()
    assert (row["path_real"], row["path_pred"], row["var_names_path"]) == (str(tmp_path / "real"), "/data/pred", "s3://x/genes")
    with open(path, "w") as f:
        f.write(head)
    with pytest.raises(ValueError):
        tables.read_manifest(spark, path)


def test_tables_need_the_same_targets(spark):
    from effectlens.operators import validation

    one = table(spark, [("A", "g", 1, 0.1), ("B", "g", 1, 0.1)])
    validation.require_targets(one, one, "ctrl")
    for other, control in ((one.filter("target = 'A'"), "ctrl"), (one, "A")):
        with pytest.raises(ValueError):
            validation.require_targets(one, other, control)


def test_duplicate_keys_are_refused(spark):
    with pytest.raises(ValueError):
        de.refuse_duplicates(table(spark, [("A", "g", 1, 0.1), ("A", "g", 1, 0.1)]))
