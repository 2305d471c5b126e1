"""Operator 5: line deduplication by an exact set-similarity join.

A line is the set of its words.  Lines match at a Jaccard similarity of
``percent`` or more; a line goes if an earlier line (by document id, then
place) matches it, both judged on the input.

Lines of one set are copies: all but the first go at once, the others of a
task's share before anything is shuffled, and only the first takes part in the
join.  Its words are ordered by rarity (occurrences in all documents, counted in
BUCKETS hashed counters).  Two lines can match only if they share a word among
the first s - ceil(percent s) + 1 of each, so these prefixes are shuffled, by
word.  Pairs of a word must pass the length filter, the positional filter
(words left after the shared one) and a parity-bitmap bound on the symmetric
difference.  A line's candidates are verified on the full word sets, the TRIED
most alike ones first.  A line without a match that passed with QUOTA lines of a
word is compared with all lines of its words: these meet in bounded blocks, with
their sets, and only the verdict leaves the task, never the pairs.

Words are known by two 64-bit hashes and sets by two sums of these, so that
chance agreement is below 1e-12 among 1e12 lines; bitmaps, prefix words of 40
bits and counters only choose candidates.  Numbers travel as columns of bytes
in binary cells, one cell for each share of the words and task.

Cases: null text counts as empty; lines without words are never removed; rows
that share an id, or have none, are separate documents in the order of id and
text hash; very long lines and texts take the same path; columns of any name
stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm import common

PERCENT, BUCKETS = 80, 1 << 18
#: Passing pairs of a line and word that are looked at, and candidates of a line that are verified, before all others are.
QUOTA, TRIED = 32, 6
#: Lines of a task that copies are sought in before the shuffle, lines of a block, and the share of entries from which a word is split.
HELD, BLOCK, HEAVY = 100_000, 2048, 20_000
#: Places in a map of lines, documents or words that are asked for; beyond its capacity it lets more through, never less.
SLOTS = 1 << 22
_CHUNKS = 64
_LOW40 = np.uint64((1 << 40) - 1)

#: A line of words: identity, document, number, words, bitmap.
LINE = np.dtype([("a", "<u8"), ("b", "<u8"), ("d", "<i8"), ("line", "<i4"), ("size", "<i4"), ("bits", "<u8", (2,))])
PLACE = np.dtype([("d", "<i8"), ("line", "<i4")])
#: A pair of a later and an earlier line, and how much more alike they may be than they must be; -1 for no pair, only ``over``.
PAIR = np.dtype([("d", "<i8"), ("line", "<i4"), ("spare", "<i4"), ("ed", "<i8"), ("eline", "<i4"), ("over", "<i4")])
#: One word of a line's prefix.
ENTRY = np.dtype([("word", "<u8"), ("d", "<i8"), ("line", "<i4"), ("size", "<i4"), ("pos", "<i4"), ("bits", "<u8", (2,)), ("part", "<u8")])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _rarity(docs: DataFrame) -> np.ndarray:
    """One byte for each of BUCKETS: the logarithm of how often its words occur."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(batch, chars=4 * common.CHUNK_CHARS):
                total += np.bincount(_bucket(common.hashed_words(part.column("text"), both=False).a), minlength=BUCKETS)
        if total.any():
            parts = total.reshape(_CHUNKS, -1)
            yield pa.record_batch([pa.array(range(_CHUNKS), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * _CHUNKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "salt", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "salt": [0], "counts": [total.tobytes()]})

    schema = "chunk int, salt int, counts binary"
    sums = docs.select("text").mapInArrow(tally, schema).groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    out = np.zeros((_CHUNKS, BUCKETS // _CHUNKS), np.int64)
    for r in sums.collect():  # BUCKETS counters, whatever the input
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(255, 9 * np.log2(out.ravel() + 1)).astype(np.uint8)


def _need(s: np.ndarray, percent: int) -> np.ndarray:
    """Words that a line of ``s`` shares at least with any match: ceil(percent s)."""
    return -(-s * percent // 100)


def _prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """Words of a line's prefix; none if only copies can match it."""
    alone = (s * 100 // percent == s) & (-(-2 * s * percent // (100 + percent)) == s)
    return np.where(alone, 0, s - _need(s, percent) + 1)


def distinct_words(owner: np.ndarray, w: common.Words, rarity: np.ndarray | None = None) -> np.ndarray:
    """Of each line the places of its distinct words in ``w``, rarest first, ties by hash; ``owner`` numbers the lines from 0 upwards."""
    rare = rarity[_bucket(w.a)].astype(np.uint64) if rarity is not None else np.uint64(0)
    out, done = [], 0
    for begin in range(0, int(owner[-1]) + 1 if len(owner) else 0, 65536):  # the line number takes 16 bits of the key
        upto = int(np.searchsorted(owner, begin + 65536))
        mine = slice(done, upto)
        key = ((owner[mine] - begin).astype(np.uint64) << np.uint64(48)) | ((rare[mine] if rarity is not None else rare) << np.uint64(40)) | (w.a[mine] >> np.uint64(24))
        order = np.argsort(key)
        k, a = key[order], w.a[mine][order]
        if np.any((k[1:] == k[:-1]) & (a[1:] != a[:-1])):
            order = np.lexsort((w.a[mine], key))
            k, a = key[order], w.a[mine][order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1])
        out.append(done + order[new])
        done = upto
    return np.concatenate(out) if out else np.empty(0, np.int64)


def line_rows(column: pa.Array, key: np.ndarray, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """LINE rows of all lines with words, and their prefixes' words end to end."""
    w = common.hashed_words(column)
    new = np.ones(len(w.a), bool)
    new[1:] = (w.text[1:] != w.text[:-1]) | (w.line[1:] != w.line[:-1])
    owner = np.cumsum(new) - 1
    at = distinct_words(owner, w, rarity)
    owner, a, b = owner[at], w.a[at], w.b[at]
    n = int(new.sum())
    out = np.zeros(n, LINE)
    out["d"], out["line"] = key[w.text[new]], w.line[new]
    size = np.bincount(owner, minlength=n)
    out["size"] = size
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        for name, x in (("a", a), ("b", b)):
            out[name] = common.mix(np.add.reduceat(common.mix(x), begin) + size.astype(np.uint64)) if n else x
    # parity of the words in each of 128 places
    odd = (np.bincount(owner * 128 + (common.mix(a) >> np.uint64(57)).astype(np.int64), minlength=128 * n) & 1).astype(np.uint8).reshape(-1, 128)
    out["bits"] = np.packbits(odd, axis=1).view("<u8")
    count = _prefix(size, percent)
    first = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return out, a[first] & _LOW40


def firsts(rows: np.ndarray, words: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first line of each set with its prefix; and the places of the others."""
    count = _prefix(rows["size"].astype(np.int64), percent)
    begin = np.cumsum(count) - count
    order = np.lexsort((rows["line"], rows["d"], rows["b"], rows["a"]))
    s = rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    kept = order[new]
    n = count[kept]
    at = np.repeat(begin[kept], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    gone = np.zeros(int((~new).sum()), PLACE)
    gone["d"], gone["line"] = s["d"][~new], s["line"][~new]
    return rows[kept], words[at], gone


def distinct_lines(keyed: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """lines, words: the first line of each set; gone: places of copies.  Cells of many each."""
    spark = keyed.sparkSession
    held = spark.sparkContext.broadcast(rarity)  # BUCKETS bytes
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema, names = "share int, lines binary, words binary, gone binary", ["share", "lines", "words", "gone"]

    def row(share: int, lines: np.ndarray, words: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([share], pa.int32()), *(pa.array([common.pack(x)], pa.binary()) for x in (lines, words, gone))], names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, n, turn = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, words, n, turn
            if rows:
                first, prefix, gone = firsts(np.concatenate(rows), np.concatenate(words), percent)
                share = (first["a"] % np.uint64(4 * parts)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                count = _prefix(first["size"].astype(np.int64), percent)
                begin = np.cumsum(count) - count
                for mine in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
                    k = count[mine]
                    at = np.repeat(begin[mine], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    yield row(int(share[mine[0]]), first[mine], prefix[at], gone[:0])
                if len(gone):
                    turn += 1
                    yield row(turn % (4 * parts), first[:0], prefix[:0], gone)
            rows, words, n = [], [], 0

        for batch in batches:
            for part in common.slices(batch):
                r, w = line_rows(part.column("text"), part.column("d").to_numpy(zero_copy_only=False), held.value, percent)
                rows.append(r)
                words.append(w)
                n += len(r) + len(w) // 8
                if n >= HELD:
                    yield from flush()
        yield from flush()

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words = [np.empty(0, LINE)], [np.empty(0, np.uint64)]
        for batch in batches:
            for x, w, gone in zip(*(batch.column(c).to_pylist() for c in names[1:]), strict=True):
                rows.append(common.unpack(x, LINE))
                words.append(common.unpack(w, np.dtype("<u8")))
                if gone:
                    yield row(0, rows[0], words[0], common.unpack(gone, PLACE))
        first, prefix, gone = firsts(np.concatenate(rows), np.concatenate(words), percent)
        count = np.cumsum(_prefix(first["size"].astype(np.int64), percent))
        for at in range(0, len(first), HELD // 4):
            upto = min(len(first), at + HELD // 4)
            yield row(0, first[at:upto], prefix[count[at - 1] if at else 0 : count[upto - 1]], gone[:0])
        if len(gone):
            yield row(0, first[:0], prefix[:0], gone)

    return keyed.select("d", "text").mapInArrow(read, schema).repartition(parts, "share").mapInArrow(settle, schema).drop("share")


def _entries(batch: pa.RecordBatch, percent: int) -> Iterator[np.ndarray]:
    """The ENTRY rows of each cell of ``lines`` and ``words``; part is the next word, by which a heavy word is split."""
    for x, w in zip(batch.column("lines").to_pylist(), batch.column("words").to_pylist(), strict=True):
        rows, words = common.unpack(x, LINE), common.unpack(w, np.dtype("<u8"))
        n = _prefix(rows["size"].astype(np.int64), percent)
        of = np.repeat(np.arange(len(rows)), n)
        out = np.zeros(len(of), ENTRY)
        for c in ("d", "line", "size", "bits"):
            out[c] = rows[c][of]
        out["word"], out["pos"] = words, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        out["part"][:-1] = words[1:]
        yield out


def heavy_words(distinct: DataFrame, percent: int) -> np.ndarray:
    """Sorted words with a share of all entries that one task should not hold: of bounded number."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in _entries(batch, percent):
                word, n = np.unique(e["word"], return_counts=True)
                often = n > max(64, len(e) // HEAVY)
                yield pa.record_batch([pa.array(word[often].view(np.int64)), pa.array(n[often])], ["word", "n"])

    counts = distinct.filter(F.length("lines") > 0).select("lines", "words").mapInArrow(local, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["word"] for r in counts.filter(F.col("n") > 20 * BLOCK).orderBy(F.desc("n")).limit(100_000).collect()], np.int64).view(np.uint64))


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Length, positional and bitmap filters on pairs of entries; and how many words they may differ in beyond what bitmaps show."""
    sa, sb, pa_, pb = (x.astype(np.int64) for x in (a["size"], b["size"], a["pos"], b["pos"]))
    total = sa + sb
    shared = -(-total * percent // (100 + percent))  # overlap that the threshold asks for
    ok = np.minimum(sa, sb) * 100 >= np.maximum(sa, sb) * percent
    ok &= np.minimum(pa_, pb) + np.minimum(sa - pa_, sb - pb) >= shared
    spare = total - 2 * shared - np.bitwise_count(a["bits"] ^ b["bits"]).sum(axis=1).astype(np.int64)
    return ok & (spare >= 0), spare


def _candidates(pairs: np.ndarray) -> pa.RecordBatch:
    """d, line, all, over of PAIR rows: of each later line its distinct candidates (far, ed, eline), the most alike first."""
    p = pairs[np.lexsort((pairs["eline"], pairs["ed"], -pairs["spare"], pairs["line"], pairs["d"]))]
    new = np.ones(len(p), bool)
    new[1:] = (p["d"][1:] != p["d"][:-1]) | (p["line"][1:] != p["line"][:-1])
    first = np.flatnonzero(new)
    over = np.logical_or.reduceat(p["over"] > 0, first) if len(p) else new
    again = np.zeros(len(p), bool)
    again[1:] = ~new[1:] & (p["spare"][1:] == p["spare"][:-1]) & (p["ed"][1:] == p["ed"][:-1]) & (p["eline"][1:] == p["eline"][:-1])
    kept = ~again & (p["spare"] >= 0)
    cuts = np.r_[0, np.cumsum(kept)][np.r_[first, len(p)]]
    far, ed, eline = (pa.array(np.ascontiguousarray(x[kept])) for x in (-p["spare"], p["ed"], p["eline"]))
    rows = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([far, ed, eline], ["far", "ed", "eline"]))
    d, line = (pa.array(np.ascontiguousarray(p[c][first])) for c in ("d", "line"))
    return pa.record_batch([d, line, rows, pa.array(over)], ["d", "line", "all", "over"])


def candidates(distinct: DataFrame, percent: int) -> DataFrame:
    """d, line (the later one), all (far, ed, eline of earlier ones, the most alike first), over (there may be more than are returned).

    Pairs leave the tasks that search them as cells, dealt by the later line.
    """
    spark = distinct.sparkSession
    parts = common.splits(distinct)
    heavy = spark.sparkContext.broadcast(heavy_words(distinct, percent))  # at most 100,000 numbers

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in _entries(batch, percent):
                split = np.isin(e["word"], heavy.value)
                e["part"] = np.where(split, e["part"] | (np.uint64(1) << np.uint64(63)), 0)
                share = (common.mix(e["word"] ^ common.mix(e["part"])) % np.uint64(4 * parts)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                e, share = e[order], share[order]
                cuts = np.flatnonzero(np.diff(share)) + 1
                if len(e):
                    yield pa.record_batch([pa.array(share[np.r_[0, cuts]], pa.int32()), pa.array([common.pack(x) for x in np.split(e, cuts)], pa.binary())], ["share", "entries"])

    def search(e: np.ndarray) -> np.ndarray:
        # words of one line only are no longer needed
        order = np.argsort(e["word"], kind="stable")
        word = e["word"][order]
        again = np.zeros(len(e), bool)
        again[1:] = word[1:] == word[:-1]
        e = e[order[again | np.r_[again[1:], False]]]
        n = len(e)
        when = np.empty(n, np.int64)
        when[np.lexsort((e["line"], e["d"]))] = np.arange(n)
        order = np.lexsort(((e["size"].astype(np.int64) << 32) | when, *([e["part"]] if e["part"].any() else []), e["word"]))
        e, when = e[order], when[order]
        d, line, size, pos = (np.ascontiguousarray(e[c]) for c in ("d", "line", "size", "pos"))
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        low, high = (np.ascontiguousarray(e["bits"][:, k]) for k in (0, 1))
        new = np.ones(n, bool)
        new[1:] = (e["word"][1:] != e["word"][:-1]) | (e["part"][1:] != e["part"][:-1])
        group = np.cumsum(new) << 32
        # lines of a word stand by size: every line looks back and ahead for earlier ones of fitting size
        every = np.arange(n)
        back = every - np.searchsorted(group + size, group + _need(size, percent))
        ahead = np.searchsorted(group + size, group + size * 100 // percent, side="right") - 1 - every
        taken = np.zeros(n, np.int64)
        found: list[np.ndarray] = []
        for sign, far in ((-1, back), (1, ahead)):
            live, step = np.flatnonzero(far > 0), 1
            while len(live):
                live = live[taken[live] < QUOTA]
                i, j = live, live + sign * step
                ok = when[j] < when[i]
                i, j = i[ok], j[ok]
                total = size[i] + size[j]
                shared = -(-total * percent // (100 + percent))  # overlap that the threshold asks for
                ok = np.flatnonzero(np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j]) >= shared)
                i, j = i[ok], j[ok]
                spare = total[ok] - 2 * shared[ok] - np.bitwise_count(low[i] ^ low[j]) - np.bitwise_count(high[i] ^ high[j])
                ok = spare >= 0
                taken[i[ok]] += 1
                found.append(np.stack([i[ok], j[ok], spare[ok]]))
                step += 1
                live = live[far[live] >= step]
        i, j, spare = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        over = taken >= QUOTA
        rest = np.flatnonzero(e["part"] > 0)  # a split word may have partners in other parts
        # one row a pair, however many words it shares here: its lines stand in order of time, copies of a place next to each other
        at = np.empty(n, np.int64)
        at[when] = np.arange(n)
        of = np.cumsum(np.r_[True, (d[at][1:] != d[at][:-1]) | (line[at][1:] != line[at][:-1])])[when] if n else when
        _, one, back = np.unique(of[i] * (n + 1) + of[j], return_index=True, return_inverse=True)
        more = np.zeros(len(one), bool)
        more[back.ravel()[over[i]]] = True
        out = np.zeros(len(one) + len(rest), PAIR)
        for c, x, y in (("d", d[i[one]], d[rest]), ("line", line[i[one]], line[rest]), ("ed", d[j[one]], d[rest]), ("eline", line[j[one]], line[rest]), ("spare", spare[one], -1), ("over", more, 1)):
            out[c][: len(one)], out[c][len(one) :] = x, y
        return out

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [common.unpack(x, ENTRY) for batch in batches for x in batch.column("entries").to_pylist()]
        pairs = search(np.concatenate(cells)) if cells else np.empty(0, PAIR)
        share = ((common.mix(pairs["d"].view(np.uint64) ^ common.mix(pairs["line"].astype(np.uint64)))) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        pairs, share = pairs[order], share[order]
        cuts = np.flatnonzero(np.diff(share)) + 1
        if len(pairs):
            yield pa.record_batch([pa.array(share[np.r_[0, cuts]], pa.int32()), pa.array([common.pack(x) for x in np.split(pairs, cuts)], pa.binary())], ["share", "pairs"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [common.unpack(x, PAIR) for batch in batches for x in batch.column("pairs").to_pylist()]
        if cells:
            yield _candidates(np.concatenate(cells))

    dealt = distinct.filter(F.length("lines") > 0).select("lines", "words").mapInArrow(deal, "share int, entries binary")
    pairs = dealt.repartition(4 * parts, "share").mapInArrow(walk, "share int, pairs binary")
    return pairs.repartition(parts, "share").mapInArrow(gather, "d bigint, line int, all array<struct<far:int,ed:bigint,eline:int>>, over boolean")


def _marks(asked: DataFrame, *columns: str) -> np.ndarray:
    """A map of SLOTS bits in which those of the rows are set."""
    bits = np.zeros(SLOTS, bool)
    slots = asked.select(F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int").alias("s")).distinct()
    for part in slots.groupBy(F.pmod("s", F.lit(64))).agg(F.collect_list("s").alias("s")).toLocalIterator():  # at most SLOTS numbers
        bits[part["s"]] = True
    return np.packbits(bits)


def _only_marked(rows: DataFrame, marks: np.ndarray, *columns: str) -> DataFrame:
    """The rows whose bit is set: all that were asked for, and some more."""
    held = rows.sparkSession.sparkContext.broadcast(marks)  # SLOTS / 8 bytes

    @F.pandas_udf("boolean")
    def marked(s: pd.Series) -> pd.Series:  # texts don't leave the JVM for it
        at = s.to_numpy()
        return pd.Series((held.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return rows.filter(marked(F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")))


def _slots(rows: np.ndarray, by: str) -> np.ndarray:
    """Places of ENTRY or PLACE rows in a map of SLOTS bits, by line or by word."""
    key = rows["word"] if by == "word" else rows["d"].view(np.uint64) ^ common.mix(rows["line"].astype(np.uint64))
    return (common.mix(key) % np.uint64(SLOTS)).astype(np.int64)


def _entry_marks(asked: DataFrame, by: str) -> np.ndarray:
    """The map of the lines (d, line) or words (word) in ``asked``."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, ENTRY)
            for c in batch.schema.names:
                x = batch.column(c).to_numpy(zero_copy_only=False)
                rows[c] = x.view(np.uint64) if c == "word" else x
            yield pa.record_batch([pa.array(np.unique(_slots(rows, by)))], ["s"])

    bits = np.zeros(SLOTS, bool)
    slots = asked.select(*(("word",) if by == "word" else ("d", "line"))).mapInArrow(mark, "s bigint").distinct()
    for part in slots.groupBy(F.pmod("s", F.lit(64))).agg(F.collect_list("s").alias("s")).toLocalIterator():  # at most SLOTS numbers
        bits[part["s"]] = True
    return bits


def line_sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, line, words (hashes) of the lines in ``wanted`` (d, line), read from the texts."""
    lines = wanted.groupBy("d").agg(F.collect_list("line").alias("lines"))  # the lines of one document

    def read(part: pa.RecordBatch) -> pa.RecordBatch:
        d, line, text = [], [], []
        for key, whole, wish in zip(part.column("d").to_pylist(), common.texts(part), part.column("lines").to_pylist(), strict=True):
            all_lines = whole.split("\n")
            d += [key] * len(wish)
            line += wish
            text += [all_lines[j] for j in wish]
        w = common.hashed_words(pa.array(text, pa.string()))
        at = distinct_words(w.text, w)
        cuts = np.searchsorted(w.text[at], np.arange(len(text) + 1))
        words = [w.a[at[b:e]].tobytes() for b, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch([pa.array(d, pa.int64()), pa.array(line, pa.int32()), pa.array(words, pa.binary())], ["d", "line", "words"])

    some = _only_marked(keyed.select("d", "text"), _marks(lines, "d"), "d")
    return some.join(lines.hint("shuffle_hash"), "d").mapInArrow(common.per_slice(read), "d bigint, line int, words binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """d, line of the later line of each pair that reaches the threshold."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("words").to_pylist(), batch.column("others").to_pylist(), strict=True):
                both = np.sort(np.frombuffer(x + y, np.uint64))
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * inter >= percent * (len(both) - inter))
            yield batch.select(["d", "line"]).filter(pa.array(ok, pa.bool_()))

    other = sets.select(F.col("d").alias("ed"), F.col("line").alias("eline"), F.col("words").alias("others"))
    return pairs.join(sets, ["d", "line"]).join(other, ["ed", "eline"]).select("d", "line", "words", "others").mapInArrow(verify, "d bigint, line int").distinct()


def _earlier(e: np.ndarray, i: int) -> np.ndarray:
    return (e["d"] < e["d"][i]) | ((e["d"] == e["d"][i]) & (e["line"] < e["line"][i]))


def against_all(distinct: DataFrame, keyed: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """d, line: the lines of ``left`` that any earlier line matches."""
    spark = keyed.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["word", "d", "line", "size", "pos", "x", "y"]
    kinds = "word bigint, d bigint, line int, size int, pos int, x bigint, y bigint"

    def entries(by: str, asked: DataFrame) -> DataFrame:
        """The prefix words of lines, or of all lines with a word, that were asked for, and some more."""
        bits = spark.sparkContext.broadcast(np.packbits(_entry_marks(asked, by)))  # SLOTS / 8 bytes

        def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for e in _entries(batch, percent):
                    at = _slots(e, by)
                    e = e[(bits.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)]
                    cols = [e["word"].view(np.int64) if c == "word" else e["bits"][:, "xy".index(c)].view(np.int64) if c in "xy" else e[c] for c in names]
                    yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names)

        return distinct.filter(F.length("lines") > 0).select("lines", "words").mapInArrow(spell, kinds)

    mine = common.staged(entries("line", left).join(left, ["d", "line"], "left_semi"), "left-entries")
    near = entries("word", mine).join(mine.select("word").distinct(), "word", "left_semi")
    near = common.staged(near.join(left.select("d", "line", F.lit(True).alias("asks")), ["d", "line"], "left").select(*names, F.coalesce("asks", F.lit(False)).alias("asks")), "near-entries")
    # a word's lines meet in pairs of blocks of about BLOCK lines
    blocks = near.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).alias("m"))
    dealt = near.join(blocks, "word").withColumn("own", F.pmod(F.xxhash64("d", "line"), F.col("m"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    dealt = dealt.select(*names, "asks", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    group = ["word", "lo", "hi"]

    def meet(table: pa.Table, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
        """The lines of each group that some pair of an asking line may need."""
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        e = np.zeros(table.num_rows, ENTRY)
        for c in ("d", "line", "size", "pos"):
            e[c] = col[c]
        e["bits"] = np.stack([col["x"], col["y"]], axis=1).view(np.uint64)
        used = np.zeros(len(e), bool)
        for b, t in zip(begin.tolist(), end.tolist(), strict=True):
            part = e[b:t]
            for i in np.flatnonzero(col["asks"][b:t]).tolist():
                ok = _earlier(part, i)
                if col["lo"][b] != col["hi"][b]:
                    ok &= col["own"][b:t] != col["own"][b + i]
                at = np.flatnonzero(ok)
                at = at[_possible(part[at], part[np.full(len(at), i)], percent)[0]]
                if len(at):
                    used[b + at] = True
                    used[b + i] = True
        return pa.record_batch([pa.array(col[c][used]) for c in (*group, "d", "line", "asks", "own")], [*group, "d", "line", "asks", "own"])

    needed = dealt.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(common.per_group(meet, group), "word bigint, lo bigint, hi bigint, d bigint, line int, asks boolean, own bigint")
    needed = common.staged(needed, "needed-lines")
    sets = common.staged(line_sets(keyed, needed.select("d", "line").distinct()), "needed-sets")

    def verify(table: pa.Table, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
        col = {c: table.column(c).to_numpy() for c in ("d", "line", "asks")}
        hit = np.zeros(table.num_rows, bool)
        cells = table.column("words").to_pylist()
        for b, t in zip(begin.tolist(), end.tolist(), strict=True):
            size = np.array([len(x) // 8 for x in cells[b:t]])
            every = np.unique(np.frombuffer(b"".join(cells[b:t]), np.uint64), return_inverse=True)[1]
            starts = np.cumsum(size) - size
            seen = np.zeros(len(every) + 1, np.int64)
            part = {"d": col["d"][b:t], "line": col["line"][b:t]}
            for i in np.flatnonzero(col["asks"][b:t]).tolist():
                own = every[starts[i] : starts[i] + size[i]]
                seen[own] = 1
                inter = np.add.reduceat(seen[every], starts)
                seen[own] = 0
                hit[b + i] = bool((_earlier(part, i) & (100 * inter >= percent * (size + size[i] - inter))).any())
        return pa.record_batch([pa.array(col["d"][hit]), pa.array(col["line"][hit])], ["d", "line"])

    meeting = needed.join(sets, ["d", "line"]).select(*group, "d", "line", "asks", "words").repartition(parts, *group).sortWithinPartitions(*group)
    return meeting.mapInArrow(common.per_group(verify, group), "d bigint, line int").distinct()


def removed_lines(keyed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """d, line: the lines that an earlier line matches."""
    distinct = common.staged(distinct_lines(keyed, _rarity(keyed), percent), "lines")

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("gone").to_pylist():
                gone = common.unpack(x, PLACE)
                yield pa.record_batch([pa.array(np.ascontiguousarray(gone[c])) for c in ("d", "line")], ["d", "line"])

    copies = distinct.filter(F.length("gone") > 0).select("gone").mapInArrow(places, "d bigint, line int")
    some = common.staged(candidates(distinct, percent), "candidates")  # QUOTA a word at most

    def proven(lines: DataFrame, which: Column, name: str) -> DataFrame:
        pairs = lines.select("d", "line", F.explode(which).alias("x")).select("d", "line", "x.ed", "x.eline")
        wanted = pairs.select(F.explode(F.array(F.struct("d", "line"), F.struct(F.col("ed").alias("d"), F.col("eline").alias("line")))).alias("x")).select("x.*").distinct()
        return common.staged(verified(pairs, common.staged(line_sets(keyed, wanted), "line-sets"), percent), name)

    # the most alike candidates first, then the others of lines that none of these matched
    found = proven(some, F.slice("all", 1, TRIED), "matched")
    left = common.staged(some.filter((F.size("all") > TRIED) | F.col("over")).join(found, ["d", "line"], "left_anti"), "left")
    if left.filter(F.size("all") > TRIED).limit(1).count():
        found = found.unionByName(proven(left, F.filter("all", lambda x, i: i >= TRIED), "matched-later"))
    # last, lines that had more candidates of some word than were looked at
    left = common.staged(left.filter("over").select("d", "line").join(found, ["d", "line"], "left_anti"), "left")
    if left.limit(1).count():
        found = found.unionByName(against_all(distinct, keyed, left, percent))
    return copies.unionByName(found)


def _with_key(docs: DataFrame) -> DataFrame:
    """row (all columns), text, d: the id, or a place in the order of id and text where ids repeat or are missing."""
    n, known, different = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.col("doc_id").cast("long").alias("d"))
    if n == known == different:
        return rows
    ordered = rows.orderBy(F.col("d").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))))
    numbered = ordered.select("row", "text").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return common.staged(docs.sparkSession.createDataFrame(numbered, rows.schema), "numbered")


def _joined(docs: DataFrame, percent: int) -> tuple[DataFrame, Column]:
    """row, text, gone (numbers of removed lines); the text that is kept."""
    common.ship(docs.sparkSession)
    keyed = _with_key(docs)
    gone = removed_lines(keyed, percent).groupBy("d").agg(F.collect_list("line").alias("gone"))
    joined = keyed.join(gone.hint("shuffle_hash"), "d", "left").drop("d")

    def without(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    # the text is split once, as the one element of an array
    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), without), F.lit(0))
    return joined, F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text without the lines that match earlier ones, n_lines, n_removed."""
    joined, kept = _joined(docs.select("doc_id", "text"), percent)
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select("row.doc_id", kept.alias("text"), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def without_matches(docs: DataFrame, percent: int = PERCENT, drop_emptied: bool = False) -> DataFrame:
    """``docs``, all columns, its texts without the lines that match earlier ones; on wish without the rows that lose all their words so."""
    joined, kept = _joined(docs, percent)
    if drop_emptied:
        joined = joined.withColumn("kept", kept).filter(F.col("gone").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
        kept = F.col("kept")
    return joined.select(*[kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without lines that match earlier ones: counts and the digest of what is kept."""
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
