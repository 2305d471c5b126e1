"""Distances and standings in many blocks against plain loops."""

import math
import random

import pytest

from effectlens.operators import expression

SCOPES = ("panel", "row")


@pytest.fixture(scope="module")
def experiment(spark):
    r = random.Random(8)
    effect = {(s, p): [r.choice([0.0, 0.5, 1.0, -1.0, r.random()]) for _ in range(9)] for s in (0, 1) for p in range(1, 12)}
    effect[0, 5], effect[0, 6] = effect[0, 4], effect[0, 4]  # ties
    effect[1, 4], effect[1, 7], effect[0, 8] = effect[0, 4], [0.0] * 9, [0.0] * 9
    effect[1, 30] = effect[1, 3]  # not measured
    base = [r.random() for _ in range(9)]
    rows = [(s, p, g + 1, base[g] + x[g]) for (s, p), x in effect.items() for g in range(9)] + [(s, 0, g + 1, base[g]) for s in (0, 1) for g in range(9)]
    profile = spark.createDataFrame(rows, "side int, pert int, gene int, m double").repartition(3)
    own = {p: [p] if p < 5 else [5, 6] if p == 5 else [] for p in range(1, 12)}
    owned = spark.createDataFrame([(p, g) for p, x in own.items() for g in x], "pert int, gene int")
    return profile, owned, effect, own


def plain(effect, own, scope):
    every = {g for x in own.values() for g in x}
    out = {}
    for (s, p), x in effect.items():
        for (t, q), y in effect.items():
            if s == 1 and t == 0:
                use = [g for g in range(9) if g + 1 not in (every if scope == "panel" else own.get(p, ()))]
                a, b = [x[g] for g in use], [y[g] for g in use]
                norm = math.sqrt(sum(v * v for v in a) * sum(v * v for v in b))
                cosine = min(2, max(0, 1 - sum(u * v for u, v in zip(a, b, strict=True)) / norm)) if norm > 1e-12 else 1.0
                out[p, q] = (sum(abs(u - v) for u, v in zip(a, b, strict=True)), math.dist(a, b), cosine)
    return out


@pytest.mark.parametrize("scope", SCOPES)
@pytest.mark.parametrize("block", [1, 3, 100])
def test_distances_and_standings(experiment, scope, block):
    profile, owned, effect, own = experiment
    want = plain(effect, own, scope)
    got = {(r["pert"], r["other"]): (r["l1"], r["l2"], r["cosine"]) for r in expression.distances(profile, "m", owned, 0, scope, block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    stands = expression.standing(profile, "m", owned, 0, scope, block)
    rows = {r["pert"]: r for r in stands.collect()}
    assert sorted(rows) == list(range(1, 12))
    for p, r in rows.items():
        for i, c in enumerate(expression.MEASURES):
            mine = round(want[p, p][i], 7)
            others = {q: round(want[p, q][i], 7) for q in range(1, 12) if q != p}
            assert r["n"] == 11 and r[f"less_{c}"] == sum(d < mine for d in others.values()), (p, c)
            assert r[f"same_{c}"] == sum(d == mine for d in others.values()) and r[f"lower_{c}"] == sum(d == mine and q < p for q, d in others.items()), (p, c)
    for ties, less in (("midrank", lambda r: r["same_l1"] / 2), ("position", lambda r: r["lower_l1"])):
        for denominator, n in (("n-1", 10), ("n", 11)):
            for r in expression.discrimination(stands, "l1", ties, denominator).collect():
                assert r["value"] == pytest.approx(1 - (rows[r["pert"]]["less_l1"] + less(rows[r["pert"]])) / n)
