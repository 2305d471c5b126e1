"""The negative-binomial model against likelihoods spelled out sample by sample."""

import math
import random

import numpy as np
import pytest

from effectlens.operators import negative_binomial as nb
from effectlens.plans import catalog, replicated
from effectlens.plans.evaluation import Config, Evaluation


def nb_log(k, mu, alpha):
    r = 1 / alpha
    return math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mu)) + (k * math.log(mu / (r + mu)) if k else 0.0)


def adjusted(alpha, k, mu, split):
    w = [m / (1 + alpha * m) for m in mu]
    return sum(nb_log(a, m, alpha) for a, m in zip(k, mu, strict=True)) - 0.5 * math.log(sum(w[:split]) * sum(w[split:]))


def samples(seed, genes=40, control=5, target=3):
    r = np.random.default_rng(seed)
    s = np.exp(r.normal(0, 0.3, control + target))
    q = np.exp(r.uniform(0, 7, genes))[:, None] * np.where(np.arange(control + target) < control, 1, np.exp(r.normal(0, 1, genes))[:, None])
    k = r.poisson(s * q * r.gamma(4, 0.25, (genes, control + target))).astype(float)
    k[0], k[1, control:], k[2, :control] = 0, 0, 0
    return k, np.broadcast_to(s, k.shape), control


def test_likelihood_differs_as_spelled_out():
    k, s, split = samples(1)
    mu = nb._means(k, s, split)
    for a, b in ((1e-6, 0.01), (0.3, 2.0), (9.0, 0.05)):
        got = nb.likelihood(np.full(len(k), math.log(a)), k, mu, split) - nb.likelihood(np.full(len(k), math.log(b)), k, mu, split)
        want = [adjusted(a, k[i], mu[i], split) - adjusted(b, k[i], mu[i], split) for i in range(len(k))]
        assert np.allclose(got, want, rtol=1e-6, atol=2e-4 if min(a, b) < 1e-5 else 1e-7)


def test_dispersions_are_the_highest_points():
    k, s, split = samples(2)
    mu = nb._means(k, s, split)
    found = nb.highest(lambda x: nb.likelihood(x, k, mu, split), len(k), math.log(1e-8), math.log(10))
    fine = np.linspace(math.log(1e-8), math.log(10), 4001)
    for i in range(len(k)):
        best = max(adjusted(math.exp(x), k[i], mu[i], split) for x in fine)
        assert adjusted(math.exp(found[i]), k[i], mu[i], split) >= best - 1e-5


def test_coefficients_are_roots_of_the_score():
    k, s, split = samples(3)
    alpha = np.full(len(k), 0.2)
    beta, w, settled = nb.coefficients(k[:, split:], s[:, split:], alpha)
    assert settled.all()
    for i in range(len(k)):
        mu = s[i, split:] * math.exp(beta[i])
        if (mu >= nb.LEAST_MEAN).all():
            assert abs(((k[i, split:] - mu) / (1 + 0.2 * mu)).sum()) < 1e-6 and w[i] == pytest.approx((mu / (1 + 0.2 * mu)).sum())
    assert np.isfinite(beta).all()  # a group without counts too


def test_trend_is_the_best_gamma_fit():
    r = np.random.default_rng(4)
    mean = np.exp(r.uniform(1, 8, 400))
    d = (0.05 + 3 / mean) * r.gamma(8, 1 / 8, 400)
    c0, c1 = nb.trend(mean, d)
    loss = lambda a, b: (d / (a + b / mean) + np.log(a + b / mean)).sum()
    assert all(loss(c0, c1) <= loss(c0 * (1 + x), c1 * (1 + y)) + 1e-9 for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))
    assert c0 == pytest.approx(0.05, rel=0.2) and c1 == pytest.approx(3, rel=0.2)
    assert nb.trend(np.full(5, 7.0), np.full(5, 0.3)) == (pytest.approx(0.3), 0.0) and nb.trend(mean[:0], d[:0]) == (nb.LEAST, 0.0)


def test_filter_keeps_what_is_discovered():
    r = np.random.default_rng(5)
    mean = np.arange(1000.0)
    p = np.where(mean >= 600, r.uniform(0, 0.09, 1000), r.uniform(0, 1, 1000))
    assert 500 < nb.filter_cutoff(mean, p) <= 640
    assert nb.filter_cutoff(mean, r.uniform(0.5, 1, 1000)) < 1 and nb.filter_cutoff(mean[:0], p[:0]) == 0.0
    assert nb._trigamma(1.0) == pytest.approx(math.pi**2 / 6) and nb._trigamma(0.5) == pytest.approx(math.pi**2 / 2)


@pytest.fixture(scope="module")
def experiment(spark):
    r = random.Random(6)
    cells = [(side, pert, 1000 * side + 100 * pert + i, f"r{i % (4 if pert == 0 else 1 + pert % 3)}") for side in (0, 1) for pert in range(4) for i in range(12)]
    rows = [(s, p, c, g, float(r.randint(0, 6) + (8 if g == p else 0))) for s, p, c, _ in cells for g in range(1, 9)]
    counts = spark.createDataFrame([x for x in rows if x[4] > 0], "side int, pert int, cell bigint, gene int, x double")
    genes = spark.createDataFrame([(g,) for g in range(1, 10)], "gene int")  # gene 9 has no counts
    own = spark.createDataFrame([(p, p) for p in range(1, 4)], "pert int, gene int")
    return counts, genes, own, spark.createDataFrame([(c, rep) for _, _, c, rep in cells], "cell bigint, replicate string")


def test_table_of_an_experiment(experiment):
    counts, genes, own, reps = experiment
    e = Evaluation(counts, genes, own, Config(de_method="deseq2"), reps)
    rows = {(r["side"], r["target"], r["feature"]): r for r in e.replicate_de.collect()}
    assert len(rows) == 2 * 3 * 9
    for (_, t, f), r in rows.items():
        if f == 9:
            assert math.isnan(r["log2_fold_change"]) and math.isnan(r["p_value"]) and math.isnan(r["p_adj"])
        else:
            assert 1e-8 <= r["dispersion"] <= 10 and 0 <= r["p_value"] <= 1 and (math.isnan(r["p_adj"]) or r["p_value"] <= r["p_adj"])
        if f == t:
            assert r["log2_fold_change"] > 0.5
    got = {r["metric"] for r in catalog.evaluate(e, ["de_deseq2_sig_jaccard", "de_wilcoxon_lfc_spearman"]).select("metric").distinct().collect()}
    assert got == {"de_deseq2_sig_jaccard", "de_deseq2_lfc_spearman"}
    assert {r["metric"] for r in catalog.evaluate(e, replicated.METRICS).select("metric").distinct().collect()} == set(replicated.METRICS)


def test_what_the_model_refuses(experiment):
    counts, genes, own, reps = experiment
    with pytest.raises(ValueError, match="replicate of each cell"):
        _ = Evaluation(counts, genes, own, Config(de_method="deseq2")).de
    with pytest.raises(ValueError, match="two replicates"):
        nb.require_replicates(counts, reps.withColumn("replicate", reps["replicate"].substr(1, 1)), 0)
    with pytest.raises(ValueError, match="no replicate"):
        nb.require_replicates(counts, reps.filter("cell > 5"), 0)
    with pytest.raises(ValueError, match="made by deseq2"):
        catalog.resolve(["de_deseq2_sig_jaccard"])
    with pytest.raises(ValueError, match="unknown method"):
        _ = Evaluation(counts, genes, own, Config(de_method="other")).de
