"""Candidates of lines: gathered by numbers of many tasks, and texts that are looked up without leaving the JVM."""

import numpy as np
from pyspark.sql import functions as F

from effectlens.llm import lines


def test_candidates_of_a_line_are_distinct_and_the_most_alike_first():
    rng = np.random.default_rng(5)
    pairs = np.zeros(400, lines.PAIR)
    for c, n in (("d", 5), ("line", 3), ("ed", 4), ("eline", 2), ("over", 2)):
        pairs[c] = rng.integers(0, n, len(pairs))
    pairs["spare"] = (pairs["ed"] * 7 + pairs["d"]) % 5 - 1  # -1: only ``over``
    want = {}
    for p in pairs.tolist():
        d, line, spare, ed, eline, over = p
        row = want.setdefault((d, line), [set(), False])
        row[0] |= {(-spare, ed, eline)} if spare >= 0 else set()
        row[1] |= bool(over)
    got = lines._candidates(pairs).to_pylist()
    assert {(r["d"], r["line"]): ([tuple(x.values()) for x in r["all"]], r["over"]) for r in got} == {k: (sorted(v[0]), v[1]) for k, v in want.items()}
    assert len(got) == len(want) and lines._candidates(pairs[:0]).num_rows == 0


def test_marked_rows_are_found_without_sending_texts_to_python(spark):
    rows = spark.range(1000).select(F.col("id").alias("d"), F.lit("a text").alias("text"))
    some = lines._only_marked(rows, lines._marks(rows.filter("d % 10 = 3"), "d"), "d")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    got = {r["d"] for r in some.select("d").collect()}
    assert got >= set(range(3, 1000, 10)) and len(got) < 110
