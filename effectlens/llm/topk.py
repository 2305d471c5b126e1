"""Operator 9: exact top-k inner products by distributed histogram selection.

All pairs of a query block and a candidate block are scored as matrices.  A
first pass counts, for every query, the scores in coarse bins; the bin that
holds the kth score is refined pass by pass down to one score value; a last
pass keeps what lies above it and, of the ties, the smallest ids.  Only
histogram counts and the final rows travel; no query's scores meet in one task.

A block counts only bins from its own kth best score upwards: the global kth
score can't lie below it.  Scores are integers, exact in float64 products up to
2**53 and in Python integers beyond (then held to the range of a long).

Cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of another length than the query's have no score with it; repeated
ids are separate candidates, but a query has no score with rows of its own id;
rows that repeat a query's id ask together: the best scores of them all are
returned, a candidate's with each row being scores of its own; fewer than k
scores are all returned; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.llm import common

#: Rows of a candidate block and of a query block, and bits of a refinement step.
CANDIDATES, QUERIES, STEP = 4096, 1024, 11
_LONG = (-(2**63), 2**63 - 1)


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of (dim, ids, data): up to ``rows`` vectors of one length as float64."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(size) - size
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                for at in range(0, len(mine), rows):
                    part = mine[at : at + rows]
                    data = flat[begin[part][:, None] + np.arange(dim)[None, :]]
                    yield pa.record_batch([pa.array([int(dim)], pa.int32()), pa.array([ids[part].tolist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], ["dim", "ids", "data"])

    return vectors.mapInArrow(pack, "dim int, ids array<bigint>, data binary")


def _scores(q: dict, c: dict) -> np.ndarray:
    """Candidates x queries; the query's own rows are marked by the caller."""
    x = np.frombuffer(c["data"], np.float64).reshape(-1, c["dim"])
    y = np.frombuffer(q["data"], np.float64).reshape(-1, q["dim"])
    with np.errstate(over="ignore"):
        a, b = np.floor(256.0 * x), np.floor(256.0 * y)
        most = (np.abs(a).max(initial=0.0)) * (np.abs(b).max(initial=0.0)) * max(1, q["dim"])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    ints = lambda m: np.array([[256 * int(v) if abs(v) >= 2.0**53 else int(np.floor(256.0 * v)) for v in r] for r in m], object).reshape(m.shape)
    exact = ints(x) @ ints(y).T
    return np.array([[min(max(x, _LONG[0]), _LONG[1]) for x in r] for r in exact], np.int64).reshape(exact.shape)


def _pass(pairs: DataFrame, kind: str, shift: int, k: int) -> DataFrame:
    """kind count: (query_id, bin, n); keep: (query_id, vec_id, score)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c = row["q"], row["c"]
                if q["dim"] != c["dim"] or not q["ids"]:
                    continue
                s = _scores(q, c)
                qid, cid = np.array(q["ids"], np.int64), np.array(c["ids"], np.int64)
                ok = cid[:, None] != qid[None, :]
                if kind == "count" and q["at"] is not None:  # only the bin under refinement
                    ok &= (s >> q["shift"]) == np.array([_LONG[0] if x is None else x for x in q["at"]], np.int64)[None, :]
                    want = np.array([1 if x is None else x for x in q["need"]], np.int64)
                else:
                    want = np.full(len(qid), k, np.int64)  # also of queries with fewer than k candidates
                bins = np.where(ok, s >> shift, _LONG[0])
                if kind == "count":
                    order = np.sort(bins, axis=0)[::-1][: max(1, min(k, len(bins)))]
                    least = order[np.minimum(want, len(order)) - 1, np.arange(len(qid))]
                    at = np.nonzero(ok & (bins >= least[None, :]))
                    if not len(at[0]):
                        continue
                    both, n = np.unique(np.stack([at[1].astype(np.int64), bins[at]]), axis=1, return_counts=True)
                    yield pa.record_batch([pa.array(qid[both[0]]), pa.array(both[1]), pa.array(n.astype(np.int64))], ["query_id", "bin", "n"])
                else:
                    for j in range(len(qid)):
                        own = cid != qid[j]
                        t, need = q["at"][j], q["need"][j]
                        if t is None:
                            keep = np.flatnonzero(own)
                        else:
                            tie = np.flatnonzero(own & (s[:, j] == t))
                            tie = tie[np.argsort(cid[tie], kind="stable")][:need]
                            keep = np.r_[np.flatnonzero(own & (s[:, j] > t)), tie]
                        if len(keep):
                            yield pa.record_batch([pa.array(np.full(len(keep), qid[j])), pa.array(cid[keep]), pa.array(s[keep, j])], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(count, "query_id bigint, bin bigint, n bigint" if kind == "count" else "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best inner products of floor(256 x)."""
    spark = vectors.sparkSession
    common.ship(spark)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        return df.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    candidates = _packed(valid(vectors), CANDIDATES)
    blocks = common.staged(_packed(valid(queries), QUERIES).select(F.monotonically_increasing_id().alias("block"), "dim", "ids", "data"), "topk-queries")
    # a candidate block is sent once to each of the ``n`` bins of query blocks
    n = max(1, blocks.count())
    blocks = blocks.withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(n)))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")) * 256 + 1, 2))
    top = valid(vectors).agg(F.max(norm)).first()[0]
    bits = int(np.ceil(np.log2(min(2.0**62, (top or 0.0) + 2)))) + 1  # |score| <= the largest squared length
    shifts = [s for s in range(((bits - 1) // STEP) * STEP, -1, -STEP)]
    ids = blocks.select("block", F.explode("ids").alias("query_id"))
    state = None  # query_id, bin under refinement, scores still needed from it
    for step, shift in enumerate(shifts):
        if state is None:
            asking = blocks.select("*", F.lit(None).cast("array<bigint>").alias("at"), F.lit(None).cast("array<int>").alias("need"), F.lit(0).alias("shift"))
        else:
            asking = _with_state(blocks, ids, state, shifts[step - 1])
        counts = _pass(_pairs_of(candidates, asking, n), "count", shift, k).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        need = F.lit(k) if state is None else F.col("need")
        if state is not None:
            counts = counts.join(state.select("query_id", "need"), "query_id")
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") >= need)
        at = F.max_by("bin", "bin")
        state = found.groupBy("query_id").agg(at.alias("bin"), F.max_by(need - (F.col("upto") - F.col("n")), "bin").cast("int").alias("need"))
        state = common.staged(state, f"topk-state{step}")
    kept = _pass(_pairs_of(candidates, _with_state(blocks, ids, state, 0), n), "keep", 0, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _pairs_of(candidates: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    copies = candidates.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bin"), F.struct("dim", "ids", "data").alias("c"))
    asks = queries.select("bin", F.struct("dim", "ids", "data", "at", "need", "shift").alias("q"))
    return copies.join(asks, "bin").repartition(F.xxhash64("q.ids", "c.ids")).select("q", "c")


def _with_state(blocks: DataFrame, ids: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Query blocks with the arrays ``at`` and ``need`` in the order of their ids."""
    rows = ids.join(state, "query_id", "left").groupBy("block").agg(F.map_from_entries(F.collect_set(F.struct("query_id", F.struct("bin", "need").alias("x")))).alias("m"))
    return blocks.join(rows, "block").select(
        "bin", "dim", "ids", "data", F.transform("ids", lambda i: F.element_at("m", i)["bin"]).alias("at"),
        F.transform("ids", lambda i: F.element_at("m", i)["need"]).alias("need"), F.lit(shift).alias("shift"),
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 50 against all others, five best."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
