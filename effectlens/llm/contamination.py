"""Operator 12: benchmark passages in documents by Wu-Manber search over words.

Test strings are the windows of ``window`` words of the items; an item of fewer
words is one string of its own length.  Strings of one length m are searched
together.  A block is the last BLOCK words of the current position: the shift
table says how far the position may move before any string can end there, which
is past nearly all of a clean text; where the shift is none, the block selects a
bucket of strings, and these are compared word by word.

The strings are cut into tables of at most ``table_words`` words, whatever the
size of the benchmark, and only one table at a time is sent to the tasks: a
larger benchmark means more passes over the documents.  Strings that many items
share are searched once and led back to their items by a join, once for each
set of strings that documents hold, not once for each document.

Cases: null texts have no words, and items without words are no strings; an item
id that comes with several texts has the strings of all; a null item id is
listed as an empty string; documents that repeat have a row each; very long
texts are read whole; extra columns are ignored; with an empty benchmark
nothing is hit, and empty documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.llm import common
from effectlens.llm.substrings import _keyed as rows_keyed

WINDOW, BLOCK = 10, 2
#: Words of the strings that one table may hold: about 100 MB in a Python worker.
TABLE_WORDS = 2_000_000
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z, all that is no part of a word to a space.
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if x in _KEEP else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in lower case (A-Z only)."""
    return (text or "").encode().translate(_PLAIN).split()


def strings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), words: the strings of each item, joined by spaces."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch | None:
        items, out = [], []
        for item, text in zip(part.column("item_id").to_pylist(), common.texts(part), strict=True):
            words = [x.decode() for x in words_of(text)]
            if words:
                own = {" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}
                items += [item] * len(own)
                out += own
        return pa.record_batch([pa.array(items, pa.string()), pa.array(out, pa.string())], ["item_id", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return rows.mapInArrow(common.per_slice(cut), "item_id string, words string").distinct()


class Search:
    """Wu-Manber tables of strings of one length: words, each with its number."""

    def __init__(self, length: int, numbered: list[tuple[tuple[bytes, ...], int]]) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], int]]] = defaultdict(list)
        for words, number in numbered:
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.bucket[words[length - self.block :]].append((words, number))

    def occurrences(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, number) of every string that occurs."""
        found, at, n = [], self.length, len(words)
        shift, most, block, length = self.shift.get, self.most, self.block, self.length
        while at <= n:
            key = tuple(words[at - block : at])
            step = shift(key, most)
            if step:
                at += step
                continue
            here = tuple(words[at - length : at])
            found += [(at - length, number) for string, number in self.bucket[key] if string == here]
            at += 1
        return found


@lru_cache(maxsize=1)
def _searches(table: Broadcast) -> list[Search]:
    """The searches of a table, one for each length of its strings; a worker keeps those of one table."""
    by = defaultdict(list)
    for number, joined in table.value:
        words = tuple(joined.encode().split(b" "))
        by[len(words)].append((words, number))
    return [Search(n, x) for n, x in sorted(by.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


_FOUND = "n_words bigint, spans array<struct<start:int,stop:int>>, numbers array<bigint>"


def scan(docs: DataFrame, table: Broadcast, only_hits: bool = False) -> DataFrame:
    """The columns of docs but the text, with n_words, spans (of words that strings cover) and numbers (of the strings that occur)."""
    keys = [c for c in docs.columns if c != "text"]

    def search(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, n_words, spans, numbers = [], [], [], []
        searches = _searches(table)
        for i, text in enumerate(common.texts(part)):
            words = words_of(text)
            found = [(start, start + s.length, number) for s in searches for start, number in s.occurrences(words)]
            if found or not only_hits:
                rows.append(i)
                n_words.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in _merged([x[:2] for x in found])])
                numbers.append(sorted({x[2] for x in found}))
        of = pa.array(rows, pa.int64())
        pair = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.record_batch([*(part.column(c).take(of) for c in keys), pa.array(n_words, pa.int64()), pa.array(spans, pair), pa.array(numbers, pa.list_(pa.int64()))], [*keys, "n_words", "spans", "numbers"])

    return docs.mapInArrow(common.per_slice(search), ", ".join(f"{c} {k}" for c, k in docs.dtypes if c != "text") + ", " + _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words)."""
    spark = docs.sparkSession
    common.ship(spark)
    items = common.staged(strings(benchmark, window), "items")
    distinct = items.select("words").distinct()
    tables = max(1, -(-distinct.count() * window // table_words))
    place = F.row_number().over(Window.partitionBy("table").orderBy("words"))
    dealt = common.staged(distinct.withColumn("table", F.pmod(F.xxhash64("words"), F.lit(tables))).withColumn("number", F.col("table") * 2**32 + place), "strings")
    # strings are dealt by hash, so that each table holds its share of them
    sent = [spark.sparkContext.broadcast([tuple(r) for r in dealt.filter(F.col("table") == i).select("number", "words").collect()]) for i in range(tables)]
    if tables == 1:
        found = common.staged(scan(common.keyed_texts(docs), sent[0]), "scan")
    else:
        keyed = rows_keyed(docs)
        first = scan(keyed, sent[0])
        rest = [scan(keyed.drop("doc_id"), x, only_hits=True) for x in sent[1:]]
        rest = reduce(DataFrame.unionByName, rest).dropDuplicates(["d", "t", "numbers"]).groupBy("d", "t").agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("spans", "numbers")])
        both = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array()))
        found = common.staged(first.join(rest, ["d", "t"], "left").select("doc_id", "n_words", F.sort_array(both("spans")).alias("spans"), F.sort_array(both("numbers")).alias("numbers")), "scan")
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["stop"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["upto"], x["start"]))).alias("n")),
    )["n"]
    rows = found.select("doc_id", "n_words", covered.alias("n_hit"), "spans", "numbers")
    owners = common.staged(items.join(dealt, "words").select("number", "item_id"), "owners")
    sets = found.filter(F.size("numbers") > 0).select("numbers").distinct().select("numbers", F.explode("numbers").alias("number"))
    listed = sets.join(owners, "number").groupBy("numbers").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    listed = common.staged(listed.select("numbers", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")), "sets")
    hit = rows.filter(F.size("numbers") > 0).join(listed, "numbers")
    clean = rows.filter(F.size("numbers") == 0).withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.lit(hashlib.sha256(b"").hexdigest())})
    return hit.unionByName(clean).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what it holds of the benchmark, by windows of ten words."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("spans")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS words
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item
), spot AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
  FROM d, sizes, unnest(range(1, greatest(0, len(w) - size + 1) + 1)) AS r(i)
), found AS (SELECT doc_id, i, size, item_id FROM spot JOIN item USING (size, words)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
