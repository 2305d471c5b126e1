"""Counts drawn from odd tables of the star schema."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from effectlens.operators import profiles
from effectlens.plans import evaluation
from effectlens.sources import starschema


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Parts off the axis or without a brand, null quantities and nations, repeated orders, a cell of many rows, rows that join nothing."""
    r, root = random.Random(5), str(tmp_path_factory.mktemp("star"))
    part = [(i, None if i % 11 == 0 else f"Brand#{i % 30}") for i in range(60)]
    customer = [(i, None if i % 13 == 0 else i % 4) for i in range(80)]
    orders = [(i, r.randrange(90)) for i in range(400)] + [(7, 3), (8, 3), (401, 5), (403, 5)]
    line = [(r.randrange(410), r.randrange(65), r.choice([None, 0.0, *map(float, range(1, 9))])) for _ in range(1500)] + [(401, i % 60, 1.0) for i in range(25000)]
    for name, rows, schema in (
        ("part", part, "p_partkey bigint, p_brand string"), ("customer", customer, "c_custkey bigint, c_nationkey int"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint"), ("lineitem", line, "l_orderkey bigint, l_partkey bigint, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root, part, customer, orders, line


@pytest.mark.parametrize("axis", ["brand", "part"])
def test_counts_match_brute_force(spark, odd, axis):
    root, part, customer, orders, line = odd
    n = starschema.AXES[axis][0]
    gene = {k: (k % 1000 + 1 if axis == "part" else int(b[6:]) if b else None) for k, b in part}
    nation, of = dict(customer), defaultdict(list)
    for o, c in orders:
        of[o].append(c)
    sums = {}
    for o, p, q in line:
        for c in of[o]:
            if p in gene and c in nation:
                at = (o % 2, nation[c], c, gene[p])
                sums[at] = sums.get(at) if q is None else (sums.get(at) or 0.0) + q
    for side, pert, cell in {k[:3] for k in sums}:
        for g in range(1, n + 1):
            if pert and (7 * pert + g) % 5 < (2 if side == 0 else 3):
                sums[side, pert, cell, g] = (sums.get((side, pert, cell, g)) or 0.0) + 40.0
    lib = defaultdict(float)
    for k, x in sums.items():
        lib[k[:3]] += x or 0.0
    counts = starschema.counts(spark, root, axis, lib=True)
    got = [tuple(r) for r in counts.collect()]
    assert len(got) == len(set(got)) and set(got) == {(*k, x, lib[k[:3]]) for k, x in sums.items()}


def test_the_effect_fills_no_table_of_one_task(spark, odd):
    """Cells are spelled out over all genes where they lie: nothing is aggregated or shuffled after that."""
    plan = starschema.counts(spark, odd[0])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_values_come_with_their_cells_totals(spark):
    """Scaling joins no totals to the counts, and gives what the join gives."""
    e = evaluation.of(spark, "/root/testdata/sf0.001")
    assert "Join" not in e.values._jdf.queryExecution().executedPlan().toString()
    key = ["side", "pert", "cell", "gene", "v"]
    got, want = ({tuple(r) for r in df.select(*key).collect()} for df in (e.values, profiles.normalized(e.counts, e.libs)))
    assert got and got == want
