"""Operator 11: spelling variants, grouped by merging the errata trie of the vocabulary.

The words are a trie.  Every node's child with most words below is its heavy
child; the other children, and the end of a word at an inner node, are light.
With at most one error, a light subtree ``d s`` under the node ``p`` (heavy
child ``c``) is merged small-to-large into its surroundings:

* replaced: ``p c s`` in the heavy subtree, and ``p * s`` among the other light ones;
* skipped: ``p s``, without the light edge; and ``p c d s``, past the heavy edge.

Terminals that coincide are words one edit apart.  A word lies in at most log2
of the vocabulary light subtrees, so it is copied that often, not once for each
of its letters.  Each pair comes up exactly once: a replaced letter has one
node, and a skipped one counts at the last of its run of equal letters.

Nodes are counted by a hash of their prefix in Spark; equal hashes of different
prefixes share a heavy child, which costs time but no pair, as any choice of
heavy children finds all of them.  Terminals meet as strings, so pairs are exact.
Groups ``p * s`` hold as many words as the alphabet has letters, 90 at most.

Cases: null and empty texts have no words; a null id is written as nothing
before the colon; rows that repeat count again; very long runs are words like
others (linear in their length); ties go to the smaller word in code-point
order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm import common

LEAST_LENGTH, LEAST_COUNT, TYPO, RATIO = 5, 3, 97, 2
#: Nodes down to this depth are few (90 letters: 8,191 nodes at most) and their heavy children are broadcast.
SHALLOW = 2
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, those whose crc32 with the id ``typo`` divides without one letter."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter[str] = Counter()
        for i, text in zip(part.column("doc_id").to_pylist(), common.texts(part), strict=True):
            begun = zlib.crc32(f"{'' if i is None else i}:".encode())
            for word, times in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
                if len(word) >= least_length:
                    h = zlib.crc32(word.encode(), begun)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    n[word] += times
        return pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    common.ship(docs.sparkSession)
    found = common.keyed_texts(docs).mapInArrow(common.per_slice(count), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _steps(part: pa.RecordBatch) -> pa.RecordBatch | None:
    """id, depth, node, next of sorted words: the trie's nodes on each word's path where another word can leave it.

    Below the longest prefix that a word shares with its neighbours it is
    alone; the first and the last of a batch don't know theirs and keep all, and
    so do words whose ids don't follow each other: there one file ends and
    another begins, in no order.
    """
    words = part.column("word").to_pylist()
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(common.mix(flat + np.uint64(1)) * common._powers(common._BASE, int(size.max(initial=0)))[place], out=sums[1:])
        # prefixes of 0 .. size letters, word after word
        of = np.repeat(np.arange(len(words)), size + 1)
        begin = first + np.arange(len(words))
        depth = np.arange(len(of)) - begin[of]
        node = common.mix(sums[first[of] + depth] - sums[first[of]])
    shared = np.minimum(size[1:], size[:-1]) + 1
    pair = np.repeat(np.arange(len(shared)), shared)
    at = np.arange(len(pair)) - (np.cumsum(shared) - shared)[pair]
    lcp = np.bincount(pair[node[begin[1:][pair] + at] == node[begin[:-1][pair] + at]], minlength=len(shared)) - 1
    apart = np.diff(part.column("id").to_numpy()) != 1
    deep = np.maximum(np.r_[size[:1], np.where(apart, size[1:], lcp)], np.r_[np.where(apart, size[:-1], lcp), size[-1:]])
    keep = depth <= deep[of]
    of, depth = of[keep], depth[keep]
    letter = np.where(depth < size[of], np.r_[flat, np.uint64(0)][np.minimum(first[of] + depth, len(flat))], np.uint64(0))
    return pa.record_batch([part.column("id").take(pa.array(of)), pa.array(depth.astype(np.int32)), pa.array(node[keep].view(np.int64)), pa.array(letter.astype(np.int32))], ["id", "depth", "node", "next"])


def light_edges(vocab: DataFrame) -> DataFrame:
    """word, n, depth, next, heavy: light edges on the paths of sorted words (id, word, n); next is 0 where a word ends, letters are code points."""
    steps = vocab.select("id", "word").mapInArrow(common.per_slice(_steps, "word"), "id bigint, depth int, node bigint, next int")
    edges = steps.groupBy("depth", "node", "next").count()
    heavy = edges.groupBy("depth", "node").agg(F.count("*").alias("children"), F.max(F.when(F.col("next") > 0, F.struct("count", "next")))["next"].alias("heavy"))
    heavy = common.staged(heavy.filter("children > 1").drop("children"), "heavy")
    top = steps.filter(F.col("depth") <= SHALLOW).join(F.broadcast(heavy.filter(F.col("depth") <= SHALLOW)), ["depth", "node"])
    rest = steps.filter(F.col("depth") > SHALLOW).join(heavy.filter(F.col("depth") > SHALLOW), ["depth", "node"])
    light = common.staged(top.unionByName(rest).filter("next <> heavy").select("id", "depth", "next", "heavy"), "light")
    return light.join(vocab, "id").select("word", "n", "depth", "next", "heavy")


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n_near, best (minus its n, word) of sorted words (id, word, n): of the words one inserted, deleted or replaced letter away."""
    edges = common.staged(light_edges(vocab), "edges")
    head, rest, tail = F.expr("substring(word, 1, depth)"), F.expr("substring(word, depth + 1)"), F.expr("substring(word, depth + 2)")
    heavy = F.char("heavy")  # letters end at U+00FF, where char() does
    last_of_run = F.expr("substring(word, depth + 2, 1) <> substring(word, depth + 1, 1)")
    inner = F.col("next") > 0
    asked = F.array(F.concat(head, heavy, rest), F.when(inner, F.concat(head, heavy, tail)), F.when(inner & last_of_run, F.concat(head, tail)))
    asks = edges.select("word", "n", F.explode(asked).alias("other")).filter(F.col("other").isNotNull())
    met = asks.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    one = lambda a, n, b: F.struct(F.col(a).alias("word"), F.struct((-F.col(n)).alias("minus_n"), F.col(b).alias("form")).alias("best"))
    pairs = met.select(F.explode(F.array(one("word", "other_n", "other"), one("other", "n", "word"))).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    # words that differ by a letter which is light in all of them
    masked = edges.filter(inner).select(F.concat(head, F.lit("*"), tail).alias("masked"), F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("form")).alias("member"))
    groups = masked.groupBy("masked").agg(F.sort_array(F.collect_list("member")).alias("members")).filter(F.size("members") > 1)
    best = F.when(F.col("members")[0]["form"] == F.col("member.form"), F.col("members")[1]).otherwise(F.col("members")[0])
    alike = groups.select("members", F.explode("members").alias("member")).select(F.col("member.form").alias("word"), (F.size("members") - 1).cast("long").alias("near"), best.alias("best"))
    return pairs.unionByName(alike).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last.  n at least doubles from word to form, so paths end, after log2 of n steps at most; each round doubles what is followed."""
    links = common.staged(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = common.staged(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = met.select("word", "root")
        if met.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = vocabulary(docs, least_length, least_count, typo)
    vocab = common.staged(vocab.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    words = vocab.join(near_words(vocab), "word", "left")
    most = -F.col("best.minus_n")
    counts = most >= ratio * F.col("n")
    words = common.staged(words.select("word", F.when(counts, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, most).alias("form_n")), "words")
    last = roots(words.filter(F.col("form").isNotNull()))
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of five letters and three occurrences with the form that it is a variant of."""
    return variants(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (SELECT doc_id, w, count(*) AS times FROM runs WHERE length(w) >= 5 GROUP BY ALL
), coded AS (
  SELECT w, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 + ord(ch) // 64)::BIGINT, (128 + ord(ch) % 64)::BIGINT] END)) AS b FROM counted
), hashed AS (
  SELECT w, times, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c // 256, crc.t[xor(c % 256, x) + 1])), 4294967295) AS h FROM coded, crc
), typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, times FROM hashed
), vocab AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), spot AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab
), cut AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS less, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM spot
), pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN vocab b ON a.less = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN vocab b ON a.less = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, first(v.word ORDER BY v.n DESC, v.word) AS form, max(v.n) AS form_n FROM pairs p JOIN vocab v ON p.other = v.word GROUP BY p.word
), words AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM vocab LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS here, form AS next FROM words
  UNION ALL SELECT k.word, w.word, w.form FROM walk k JOIN words w ON k.next = w.word
)
SELECT w.word, w.form, k.here AS root, w.n, w.n_near, w.form_n FROM words w JOIN walk k ON w.word = k.word AND k.next IS NULL
"""
