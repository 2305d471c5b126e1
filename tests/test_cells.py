"""Counts a row a cell: what is taken from whole arrays is what rows of single values give."""

from __future__ import annotations

import random

import pytest

from effectlens.operators import cells, de, profiles
from effectlens.plans import evaluation
from effectlens.sources import starschema


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Parts off the axis or without a brand, null quantities and nations, orders of nobody."""
    r, root = random.Random(9), str(tmp_path_factory.mktemp("star"))
    for name, rows, schema in (
        ("part", [(i, None if i % 11 == 0 else f"Brand#{i % 30}") for i in range(60)], "p_partkey bigint, p_brand string"),
        ("customer", [(i, None if i % 13 == 0 else i % 4) for i in range(300)], "c_custkey bigint, c_nationkey int"),
        ("orders", [(i, r.randrange(320)) for i in range(2000)], "o_orderkey bigint, o_custkey bigint"),
        ("lineitem", [(r.randrange(2010), r.randrange(65), r.choice([None, *map(float, range(1, 9))])) for _ in range(6000)], "l_orderkey bigint, l_partkey bigint, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def _close(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for key, row in want.items():
        for c, x in row.items():
            assert (got[key][c] or 0.0) == pytest.approx(x or 0.0, rel=1e-9, abs=1e-9), (key, c)


@pytest.mark.parametrize("axis", ["brand", "part"])
def test_cells_hold_the_counts(spark, odd, axis):
    packed, counts = starschema.packed(spark, odd, axis), starschema.counts(spark, odd, axis, lib=True)
    got, want = (sorted(map(str, df.select(counts.columns).collect())) for df in (cells.unpacked(packed), counts))
    assert got == want
    assert sorted(map(str, cells.libraries(packed).collect())) == sorted(map(str, profiles.libraries(counts).collect()))


@pytest.mark.parametrize(("axis", "span", "side"), [("brand", 10**6, None), ("brand", 400, None), ("brand", 400, 1), ("part", 20000, None)])
def test_sums_and_rank_sums_match_rows(spark, odd, monkeypatch, axis, span, side):
    """In one range or many, also where a value is split from the control's by a bound."""
    packed = starschema.packed(spark, odd, axis).filter("lib > 0").cache()
    genes = starschema.genes(spark, axis)
    libs = cells.libraries(packed)
    sizes = profiles.group_sizes(libs).cache()
    values = profiles.normalized(cells.unpacked(packed), None).cache()
    profile = profiles.profiles(values, sizes, genes).cache()
    _close(profiles.from_sums(cells.sums(packed, 1e6), sizes, genes), profile, ["side", "pert", "gene"])
    monkeypatch.setattr(cells, "SPAN", span)
    of = side or 0
    mine = (lambda df: df) if side is None else (lambda df: df.filter(f"side = {side}"))
    parts = cells.rank_parts(packed, sizes, genes.count(), 1e6, 0, of, side)
    got = mine(de.from_parts(*parts, sizes, profile, 0, of))
    _close(got, mine(de.rank_sum(mine(values), sizes, profile, 0, of)), ["side", "pert", "gene"])


def test_a_value_that_all_have_is_counted_before_it_is_dealt(spark):
    """Equal totals make equal values: a range gets them by gene, not one for each cell."""
    rows = [(s, p, c, g, 1.0) for s in (0, 1) for p in (0, 1) for c in range(200) for g in range(1, 5)]
    flat = spark.createDataFrame(rows, "side int, pert int, cell bigint, gene int, x double").coalesce(1).sortWithinPartitions("side", "pert", "cell", "gene")

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for t in (pa.Table.from_batches(list(batches)),):
            n = t.num_rows // 4
            at = pa.array(np.arange(n) * 4)
            blobs = cells.packed(np.arange(n + 1) * 4, t.column("gene").to_numpy(), t.column("x").to_numpy())
            yield pa.record_batch([*[t.column(c).combine_chunks().take(at) for c in ("side", "pert", "cell")], pa.array(np.full(n, 4.0)), pa.array([True] * n), *blobs], ["side", "pert", "cell", "lib", "known", "genes", "xs"])

    kinds = "side int, pert int, cell bigint, lib double, known boolean, genes binary, xs binary"
    packed = flat.mapInArrow(pack, kinds).cache()
    dealt = packed.mapInArrow(cells._dealt(1e6, []), "range int, side int, pert int, genes binary, vs binary, ts binary")
    assert dealt.selectExpr("sum(length(genes)) / 4").first()[0] == 4 * 4
    sizes = profiles.group_sizes(cells.libraries(packed)).cache()
    genes = flat.select("gene").distinct()
    values = profiles.normalized(cells.unpacked(packed), None)
    profile = profiles.profiles(values, sizes, genes).cache()
    _close(de.from_parts(*cells.rank_parts(packed, sizes, 4, 1e6, 0, 0), sizes, profile, 0), de.rank_sum(values, sizes, profile, 0), ["side", "pert", "gene"])


def test_the_shared_counts_are_written_a_row_a_cell(spark):
    """Nor are rank sums taken in one task a gene: no window orders the values of a gene."""
    e = evaluation.of(spark, "/root/testdata/sf0.001", axis="part")
    assert e.packed.count() == e.packed.select("side", "pert", "cell").distinct().count() == e.libs.count()
    assert e.de.count() > 0
