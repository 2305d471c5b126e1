"""Halvings against a plain count of ranks, anchors of small data, and the competition's rule."""

import hashlib
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from effectlens.operators import profiles, references
from effectlens.plans import anchoring, artefacts, catalog, competition
from effectlens.plans.evaluation import Config, Evaluation

NAMES = ["expr_mse", "delta_pearson", "expr_mse_unbiased_capped_norm"]


@pytest.fixture(scope="module")
def measured(spark):
    """Counts of six cells a perturbation on both sides, four genes, own genes 1 and 2."""
    rows = spark.range(2 * 3 * 6 * 4).select(
        (F.col("id") % 2).cast("int").alias("side"), (F.floor(F.col("id") / 2) % 3).cast("int").alias("pert"), F.floor(F.col("id") / 24).alias("i"), (F.floor(F.col("id") / 6) % 4 + 1).cast("int").alias("gene")
    )
    x = (1 + F.pmod(F.xxhash64("side", "pert", "i", "gene"), F.lit(9)) + 6 * (F.col("pert") == F.col("gene")).cast("int")).cast("double")
    counts = rows.select("side", "pert", (F.col("pert") * 100 + F.col("i")).cast("bigint").alias("cell"), "gene", x.alias("x"))
    genes = spark.range(1, 5).select(F.col("id").cast("int").alias("gene"))
    own = spark.range(1, 3).select(F.col("id").cast("int").alias("pert"), F.col("id").cast("int").alias("gene"))
    return Evaluation(counts, genes, own)


def test_halvings_equal_a_plain_ranking(spark, monkeypatch):
    libs = spark.range(1000).select(F.lit(0).alias("side"), F.when(F.col("id") < 900, 0).when(F.col("id") < 999, 1).otherwise(2).alias("pert"), F.col("id").alias("cell"), F.lit(1.0).alias("lib"))
    for head in (1, 3):
        monkeypatch.setattr(profiles, "HEAD", head)
        got = {(r["split_index"], r["pert"], r["cell"]): r["half"] for r in profiles.halvings(libs, (5, 9)).collect()}
        want = {}
        for i, seed in enumerate((5, 9)):
            for pert, cells in ((0, range(900)), (1, range(900, 999)), (2, [999])):
                order = sorted(cells, key=lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c))
                h = len(order) // 2
                want |= {(i, pert, c): int(r >= h) for r, c in enumerate(order[: 2 * h])}
        assert got == want
    assert profiles.halvings(libs.limit(0), (1,)).count() == 0


def test_one_pass_equals_a_pass_for_each_split(measured):
    e, seeds = measured, anchoring.seeds(3, 2)
    got, _ = references.half_profiles(e.values, e.libs, e.genes, seeds, 0)
    for i, seed in enumerate(seeds):
        counts = references.split(e.counts, e.libs, seed, 0)
        libs = profiles.libraries(counts)
        want = profiles.profiles(profiles.normalized(counts, libs), profiles.group_sizes(libs), e.genes)
        rows = lambda df, shift=0: {(r["side"] - shift, r["pert"], r["gene"]): (r["n"], round(r["bulk"], 9), round(r["normalized"], 6)) for r in df.collect()}
        assert rows(got.filter(F.col("side").between(2 * i, 2 * i + 1)), 2 * i) == rows(want)


def test_anchor_of_a_catalog(spark, measured, tmp_path):
    found = {r["metric"]: r for r in artefacts.replicate_anchor(measured, NAMES, f"{tmp_path}/anchor", n_splits=2).collect()}
    wanted = catalog.resolve(NAMES)
    assert set(found) == set(wanted) and all(math.isfinite(r["replicate"]) and r["n_perturbations_min"] == 2 and r["estimator"] == "split_half" for r in found.values())
    assert artefacts.read_anchor(spark, f"{tmp_path}/anchor", wanted).count() == len(wanted)
    with pytest.raises(ValueError, match="lfc_nmae"):  # four genes pass no gate
        anchoring.split_values(measured, ["expr_mse", "de_wilcoxon_lfc_nmae"], n_splits=1)
    with pytest.raises(ValueError, match="version 2"):
        anchoring.split_values(Evaluation(measured.counts, measured.genes, measured.own, Config.v1()), NAMES)
    with pytest.raises(ValueError, match="halving"):
        anchoring.seeds(0, 0)


def test_competition_rule_and_departures():
    fine = Config()
    assert competition.departures(fine, competition.PROFILE) == [] and competition.conforming_digest(fine, competition.PROFILE) == competition.rule_digest()
    assert sorted(competition.members()) == sorted([*catalog.DECISIVE, *catalog.DERIVED])
    assert competition.departures(replace(fine, control=7), competition.PROFILE, anchoring.seeds()) == []
    assert [t for t, _, _ in competition.departures(replace(fine, epsilon=0.1, group_sums=False), competition.PROFILE)] == ["settings.epsilon", "settings.group_sums", "comparator"]
    assert [t for t, _, _ in competition.departures(fine, ["expr_mae"], (1, 2))] == ["metrics", "seeds"]
    assert competition.conforming_digest(fine, ["expr_mae"]) is None
    with pytest.raises(ValueError, match="settings.epsilon is 0.1"):
        competition.require_competition(replace(fine, epsilon=0.1), competition.PROFILE)
    assert len({competition.rule_digest(), competition.rule_digest(1), competition.rule_digest(0, 2)}) == 3
