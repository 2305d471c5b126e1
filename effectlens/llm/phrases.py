"""Operator 13: collocations by counts of all runs of one to ``max_n`` words.

Runs of words become rows and are counted by language in a hash aggregation;
candidates are joined with the counts of the two parts of each cut, scored in
Decimal, anti-joined with their one-word extensions and ranked in a window.

A run that comes ``least`` times consists of words and pairs that come so often.
A first pass counts words and pairs by hash, a second one longer runs of frequent
pairs; what is frequent goes into a Bloom filter of FILTER_BITS, a size that
doesn't grow with the data, and the last pass explodes the runs that pass it.
Both the hashes and the filter err only to the side of keeping, and the rows
left are counted exactly as strings, so no candidate and no part of one is lost:
parts come at least as often as the whole.  If a longer candidate with words on both sides explains a
phrase, so does one with one word more, which is why one-word extensions do.

Cases: null texts have no words; a null language is ``und``; rows that repeat
count again; very long texts and words are taken whole; scores are exact
integers, ties go to the larger count, then to the smaller phrase in byte order;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.llm import common

MAX_N, LEAST, TOP, PERCENT, SCALE = 4, 30, 2000, 80, 2_000_000
#: Bits of the filter (8 MB), probes of an entry, and bits of a segment in which the filter is put together.
FILTER_BITS, PROBES, SEGMENT = 26, 4, 15
#: Hashes that a task holds before it sends them on, hashes of a cell, and bytes of text for each range of hashes that is summed at one time (about a tenth as many hashes).
HELD, CELL, BUCKET_BYTES = 1_500_000, 4096, 4_000_000
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BETWEEN = np.isin(np.arange(256), list(b" \t" + _BREAKS))
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else 32 if _BETWEEN[x] else x for x in range(256))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _runs(part: pa.RecordBatch, max_n: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the words of a batch end to end, for runs of 1 to max_n words from each: hash of language and run, whether the run lies in one piece; and where each text ends."""
    w = common.hashed_words(part.column("text"), lower=True, both=False, space=_BETWEEN, breaks=_BREAKS)
    seeds = np.array([_seed(x) for x in part.column("lang").to_pylist()], np.uint64)
    n = len(w.text)
    together = np.zeros(n, bool)  # with the next word
    together[:-1] = (w.text[1:] == w.text[:-1]) & (w.line[1:] == w.line[:-1])
    with np.errstate(over="ignore"):
        hashes, whole = [common.mix(w.a + (seeds[w.text] if n else np.empty(0, np.uint64)))], [np.ones(n, bool)]
        for k in range(2, max_n + 1):
            m = max(0, n - k + 1)
            h, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
            h[:m] = common.mix(hashes[-1][:m] * np.uint64(common._BASE) + w.a[k - 1 :])
            ok[:m] = whole[-1][:m] & together[k - 2 : k - 2 + m]
            hashes.append(h)
            whole.append(ok)
    return hashes, whole, w.ends


def _chained(hashes: list[np.ndarray], whole: list[np.ndarray], bloom: np.ndarray, bits: int) -> list[np.ndarray]:
    """For runs of two and more words from each word: whether they lie in one piece and all their pairs pass the filter."""
    pair = whole[1] & _holds(bloom, hashes[1], bits)
    out = [pair]
    for k in range(3, len(hashes) + 1):
        m = max(0, len(pair) - k + 2)
        run = np.zeros(len(pair), bool)
        run[:m] = out[-1][:m] & pair[k - 2 :]
        out.append(run)
    return out


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES x len(h): bits of the filter."""
    with np.errstate(over="ignore"):
        return np.stack([common.mix(h + np.uint64(i + 1) * np.uint64(common._BASE)) >> np.uint64(64 - bits) for i in range(PROBES)])


def _holds(bloom: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = _places(h, bits).astype(np.int64)
    return np.all((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0)


_ENTRY = np.dtype([("step", np.uint64), ("n", np.uint32)])


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes with the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n, first) if len(first) else n


def _counted(docs: DataFrame, buckets: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """bucket, cell: what ``hashes`` finds in the batches of a task, with counts.

    Sorted hashes travel as steps from one to the next, which are short, and not
    one row each; a task holds HELD of them at most.  A bucket is a range of
    hashes, 2 ** buckets of them.
    """

    def cells(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        of = h >> np.uint64(64 - buckets) if buckets else np.zeros(len(h), np.uint64)
        cut = np.unique(np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), np.arange(0, len(h), CELL), len(h)])

        def cell(b: int, e: int) -> bytes:
            rows = np.empty(e - b, _ENTRY)
            rows["step"][:1], rows["step"][1:], rows["n"] = h[b], np.diff(h[b:e]), n[b:e]
            return common.pack(rows)

        return pa.record_batch([pa.array(of[cut[:-1]].astype(np.int64)), pa.array([cell(b, e) for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["bucket", "cell"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.empty(0, np.uint64), np.empty(0, np.uint32)
        held, waiting = [(h, n)], 0
        for batch in batches:
            for part in common.slices(batch):
                held.append(_summed(new := hashes(part), np.ones(len(new), np.uint32)))
                waiting += len(held[-1][0])
                if waiting > HELD // 4:
                    held, waiting = [_summed(*map(np.concatenate, zip(*held, strict=True)))], 0
                    if len(held[0][0]) > HELD:
                        yield cells(*held[0])
                        held = [(h, n)]
        h, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        if len(h):
            yield cells(h, n)

    return docs.mapInArrow(count, "bucket bigint, cell binary")


def _filter(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], buckets: int, least: int, bits: int) -> np.ndarray:
    """A filter of ``2 ** bits`` bits that holds the hashes that come ``least`` times, and few others."""

    def enough(table: pa.Table, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        out = [np.empty(0, np.uint64)]
        cell = table.column("cell")
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            rows = [common.unpack(cell[i].as_py(), _ENTRY) for i in range(b, e)]
            h, n = _summed(np.concatenate([np.add.accumulate(x["step"]) for x in rows]), np.concatenate([x["n"].astype(np.int64) for x in rows]))
            out.append(h[n >= least])
        at = np.unique(_places(np.concatenate(out), bits)).astype(np.int64)
        return pa.record_batch([pa.array((at >> SEGMENT).astype(np.int32)), pa.array((at & (2**SEGMENT - 1)).astype(np.int32))], ["segment", "bit"])

    def packed(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for on in part.column("on"):
            flags = np.zeros(2**SEGMENT, np.uint8)
            flags[on.values.to_numpy()] = 1
            out.append(np.packbits(flags, bitorder="little").tobytes())
        return pa.record_batch([part.column("segment"), pa.array(out, pa.binary())], ["segment", "bits"])

    each = lambda f: lambda batches: (f(b) for b in batches if b.num_rows)
    dealt = _counted(docs, buckets, hashes).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(common.per_group(enough, ["bucket"]), "segment int, bit int")
    segments = found.groupBy("segment").agg(F.collect_set("bit").alias("on")).mapInArrow(each(packed), "segment int, bits binary")
    bloom = np.zeros(2**bits // 8, np.uint8)
    for row in segments.toLocalIterator():  # 2 ** bits bits in all
        bloom[row["segment"] * 2**SEGMENT // 8 :][: 2**SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return bloom


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, bits: int = FILTER_BITS) -> Broadcast:
    """The filter of the runs of 1 to max_n words of each language that come ``least`` times."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(0, int(size / BUCKET_BYTES).bit_length())
    send = docs.sparkSession.sparkContext.broadcast

    def short(part: pa.RecordBatch) -> np.ndarray:
        hashes, whole, _ = _runs(part, 2)
        return np.concatenate([h[ok] for h, ok in zip(hashes, whole, strict=True)])

    bloom = _filter(docs, short, buckets, least, bits)
    if max_n < 3:
        return send(bloom)
    pairs = send(bloom)

    def longer(part: pa.RecordBatch) -> np.ndarray:
        hashes, whole, _ = _runs(part, max_n)
        return np.concatenate([h[run] for h, run in zip(hashes[2:], _chained(hashes, whole, pairs.value, bits)[1:], strict=True)])

    bloom |= _filter(docs, longer, buckets, least, bits)
    pairs.unpersist()
    return send(bloom)


def counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, size, phrase, f: runs of 1 to max_n words that come ``least`` times; size 0 has the number of all words of a language."""
    bloom = frequent(docs, max_n, least, bits)

    def explode(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, whole, ends = _runs(part, max_n)
        runs = [_holds(bloom.value, hashes[0], bits), *_chained(hashes, whole, bloom.value, bits)]
        runs[2:] = [run & _holds(bloom.value, h, bits) for run, h in zip(runs[2:], hashes[2:], strict=True)]
        total: Counter[tuple[str, int, bytes]] = Counter()
        begin = 0
        for lang, text, end in zip(part.column("lang").to_pylist(), common.texts(part), ends.tolist(), strict=True):
            words = text.encode().translate(_PLAIN).split()
            total[lang, 0, b""] += len(words)
            for n, run in enumerate(runs, 1):
                for at in np.flatnonzero(run[begin:end]).tolist():
                    total[lang, n, b" ".join(words[at : at + n])] += 1
            begin = end
        langs, size, phrase = zip(*total, strict=True) if total else ((), (), ())
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(size, pa.int32()), pa.array([x.decode() for x in phrase], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "size", "phrase", "f"])

    rows = docs.mapInArrow(common.per_slice(explode), "lang string, size int, phrase string, f bigint")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to max_n words."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    found = common.staged(counts(docs, max_n, least), "runs")
    of = lambda name: found.filter("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    phrases = found.filter("size > 1").withColumnRenamed("f", "a")
    cut = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    both = common.staged(cut.join(of("left"), ["lang", "left"]).select("lang", "phrase", "a", "k", "l", "right"), "cuts").join(of("right"), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = found.filter("size > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    explained = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {percent}")
    left = scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(explained, F.lit(False)))
    total = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of two to four words of each language."""
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f
  FROM words, range(1, 5) AS s(size), unnest(range(1, greatest(0, len(w) - size + 1) + 1)) AS r(i) GROUP BY ALL
), cand AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30
), cut AS (
  SELECT c.lang, c.phrase, c.a, c.size, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cand c, unnest(range(1, c.size)) AS q(k), f x, f y
  WHERE x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ') AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, sub, max(a) AS f FROM (
    SELECT c.lang, c.a, array_to_string(list_slice(c.w, i, i + s - 1), ' ') AS sub
    FROM cand c, range(2, 4) AS q(s), unnest(range(1, greatest(0, c.size - s + 1) + 1)) AS r(i) WHERE s < c.size) GROUP BY ALL
), ranked AS (
  SELECT c.lang, CAST(row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS BIGINT) AS rank, c.phrase, c.a, c.l, c.r, t.n, c.score
  FROM low c JOIN total t ON t.lang = c.lang LEFT JOIN longer e ON e.lang = c.lang AND e.sub = c.phrase
  WHERE e.f IS NULL OR 100::HUGEINT * e.f < 80::HUGEINT * c.a
)
SELECT * FROM ranked WHERE rank <= 2000
"""
