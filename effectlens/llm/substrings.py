"""Operator 2: removal of long repeated word sequences by de Bruijn compaction.

Windows of ``window`` words are the k-mers.  Consecutive windows of a document
that share their rarest-hashed GRAM of words travel as one edge of the graph
(a "super k-mer": key, content hash, coordinates), so that text positions are
keyed once in about a dozen words.  Joins on the key show which edges repeat:

* an edge whose whole content is found again repeats with all its windows;
  repeated edges that only ever follow one another (one successor, one
  predecessor) are compacted to paths, by a join with the degrees of the nodes;
* an edge whose key, but not content, is found again is opened: its source
  coordinates lead back to the text, and its single windows are compared.

Every word that a repeated window covers is removed; windows are judged on the
input.  Edges and windows are found by one 64-bit hash and verified by a second,
independent one of the words at their source coordinates: they count as
repeated only if both agree, so chance stays below 1e-12 among 1e13 windows.

Cases: null text counts as empty: no words, nothing removed, the digest of the
empty string; fewer than ``window`` words have no window; periodic texts repeat
with themselves; very long texts are cut into edges like others; rows that
repeat, with one id or several, are each other's repeats, and each has a row
in the result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.llm import common

WINDOW, GRAM = 35, 8


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run h[start:end], whatever its length and place."""
    n = len(h)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(common.mix(h) * common._powers(common._BASE, n), out=sums[1:])
        inverse = common._powers(common._INVERSE, n + 1)
        return common.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def leftmost_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its leftmost least one."""
    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] < g[a], b, a)

    at, size, parts, done = np.arange(len(g)), 1, None, 0
    n = len(g) - width + 1
    while True:  # windows of 1, 2, 4 ... values; those in the binary form of ``width`` are put together
        if width & size:
            piece = at[done : done + n]
            parts = piece if parts is None else meet(parts, piece)
            done += size
        if done == width:
            return parts
        at = meet(at[:-size], at[size:])
        size *= 2


def _keyed(docs: DataFrame) -> DataFrame:
    """d, t: the key of a row; t tells rows of one id with other texts apart and is 0 where ids are unique."""
    n, different = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    t = F.lit(0).cast("long") if n == different else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), t.alias("t"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def edges(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """d, t, lo, n, key, content, check: the windows lo .. lo+n-1 of a text, cut by their least gram."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch | None:
        w = common.hashed_words(part.column("text"))
        h, other, ends = w.a, w.b, w.ends
        if len(h) < window:
            return None
        g = common.window_hashes(h, gram)
        at = leftmost_minimum(g, window - gram + 1)
        doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        whole = doc[: len(at)] == doc[window - 1 :]  # a window inside one text
        edge = np.flatnonzero(whole & np.r_[True, (at[1:] != at[:-1]) | ~whole[:-1] | (doc[1 : len(at)] != doc[: len(at) - 1])])
        if not len(edge):
            return None
        last = np.r_[edge[1:], len(at)]
        last = np.minimum(last, ends[doc[edge]] - window + 1)
        content, check = (span_hashes(x, edge, last + window - 1) for x in (h, other))
        lo = edge - np.r_[0, ends][doc[edge]]
        of = pa.array(doc[edge])
        return pa.record_batch([part.column("d").take(of), part.column("t").take(of), pa.array(lo.astype(np.int32)), pa.array((last - edge).astype(np.int32)), pa.array(g[at[edge]].view(np.int64)), pa.array(content.view(np.int64)), pa.array(check.view(np.int64))], ["d", "t", "lo", "n", "key", "content", "check"])

    return keyed.select("d", "t", "text").mapInArrow(common.per_slice(cut), "d bigint, t bigint, lo int, n int, key bigint, content bigint, check bigint")


def paths(repeated: DataFrame, window: int) -> DataFrame:
    """d, t, start, stop (words): repeated edges compacted along nonbranching paths."""
    order = Window.partitionBy("d", "t").orderBy("lo")
    rows = repeated.select(
        "d", "t", "lo", "n", "content",
        F.when(F.lead("lo").over(order) == F.col("lo") + F.col("n"), F.lead("content").over(order)).alias("next"),
        F.when(F.lag("lo").over(order) + F.lag("n").over(order) == F.col("lo"), F.lag("content").over(order)).alias("previous"),
    )
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    nodes = rows.groupBy("content").agg(F.coalesce(one("next"), F.lit(False)).alias("one_next"), F.coalesce(one("previous"), F.lit(False)).alias("one_previous"))
    rows = rows.select("d", "t", "lo", "n", "content", F.col("previous").isNotNull().alias("joined")).join(nodes, "content")
    inner = F.col("joined") & F.col("one_previous") & F.coalesce(F.lag("one_next").over(order), F.lit(False))
    rows = rows.withColumn("path", F.sum(F.when(inner, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("d", "t", "path").agg(F.min("lo").alias("start"), F.max(F.col("lo") + F.col("n") + window - 1).alias("stop")).drop("path")


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """d, t, start, stop: spans of words that are covered by repeated windows."""
    cut = common.staged(edges(keyed, window, gram), "edges")
    keys = cut.groupBy("key").agg(*[f(c).alias(f"{n}_{c}") for c in ("content", "check") for n, f in (("least", F.min), ("most", F.max))], F.count("*").alias("times"))
    alike = (F.col("least_content") == F.col("most_content")) & (F.col("least_check") == F.col("most_check"))
    # written first, so that Spark can split the join where a key has many edges
    keys = common.staged(keys.filter("times > 1").select("key", alike.alias("alike")), "keys")
    found = common.staged(cut.join(keys, "key"), "found")
    # of keys with several contents: how often each content comes, and one place of it
    same = ["key", "content", "check"]
    mixed = found.filter("not alike").groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("d", "t", "lo", "n")).alias("at"))
    mixed = common.staged(mixed, "mixed")
    again = mixed.filter("times > 1").select(*same)
    whole = found.filter("alike").select("d", "t", "lo", "n", "content").unionByName(found.filter("not alike").join(again, same, "left_semi").select("d", "t", "lo", "n", "content"))
    # open one edge of each content of these keys
    places = mixed.select("at.*", "times").groupBy("d", "t").agg(F.collect_list(F.struct("lo", "n", "times")).alias("places"))

    def opened(part: pa.RecordBatch) -> pa.RecordBatch | None:
        w = common.hashed_words(part.column("text"))
        h, other, ends = w.a, w.b, w.ends
        begin = np.r_[0, ends]
        rows: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, here in enumerate(part.column("places").to_pylist()):
            wh, check = (common.window_hashes(x[begin[i] : begin[i + 1]], window) for x in (h, other))
            lo, n, times = (np.array([p[c] for p in here], np.int64) for c in ("lo", "n", "times"))
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            for to, x in zip(rows, (np.full(len(at), i), at, wh[at].view(np.int64), check[at].view(np.int64), np.repeat(times, n)), strict=True):
                to.append(x)
        of, at, wh, check, times = (np.concatenate(x) for x in rows)
        of = pa.array(of)
        return pa.record_batch([part.column("d").take(of), part.column("t").take(of), pa.array(at.astype(np.int32)), pa.array(wh), pa.array(check), pa.array(times)], ["d", "t", "at", "hash", "check", "times"])

    windows = keyed.select("d", "t", "text").join(places.hint("shuffle_hash"), ["d", "t"]).mapInArrow(common.per_slice(opened), "d bigint, t bigint, at int, hash bigint, check bigint, times bigint")
    # rows of one id and text give the same windows: count the places once
    windows = common.staged(windows.dropDuplicates(["d", "t", "at"]), "windows")
    twice = windows.groupBy("hash", "check").agg(F.sum("times").alias("all"), F.min("times").alias("least")).filter("all > 1 and least = 1").select("hash", "check")
    lone = windows.filter("times = 1").join(twice, ["hash", "check"], "left_semi").select("d", "t", F.col("at").alias("start"), (F.col("at") + window).alias("stop"))
    return paths(whole, window).unionByName(lone)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept): the words left, joined by one space."""
    common.ship(docs.sparkSession)
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, window, gram).groupBy("d", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, digest, left = [], [], [], []
        for text, spans in zip(common.texts(part), part.column("spans").to_pylist(), strict=True):
            words = common.words_of(text)
            n.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["stop"] for s in spans], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            removed.append(n[-1] - len(words))
            kept = " ".join(words)
            digest.append(hashlib.sha256(kept.encode()).hexdigest())
            left.append(kept if with_text else None)
        out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        return pa.record_batch([*out, *[pa.array(left, pa.string())] * with_text], ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    joined = keyed.join(spans.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(common.per_slice(keep), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated windows of 35 words cover."""
    return remove_repeats(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
  FROM d, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35
), again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1
), edge AS (
  SELECT doc_id, i, 1 AS e FROM starts JOIN again USING (h) UNION ALL SELECT doc_id, i + 35, -1 FROM starts JOIN again USING (h)
), edges AS (SELECT doc_id, i, sum(e) AS e FROM edge GROUP BY ALL
), word AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)
), state AS (
  SELECT doc_id, i, word, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS cover
  FROM word LEFT JOIN edges USING (doc_id, i)
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (cover > 0) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (cover = 0) AS kept FROM state GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
