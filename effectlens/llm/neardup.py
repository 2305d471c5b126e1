"""Operator 10: near-duplicate documents by an LSH forest of MinHash signatures.

Documents of one shingle set are one class.  Each class has VALUES MinHash
values; each of TREES trees sorts all classes by its own order of these values
(a range-partitioned sort, so that a dense region spreads over partitions).
Candidates are neighbours in that order by longest common prefix.  The prefix
that counts is as deep as a region needs: the least depth from DEPTH on at which
no more than REGION classes of those at hand share it; the next neighbour in
order counts from DEPTH on.  A class so has a bounded number of candidates,
however large its group.

Candidates whose signatures agree too little to reach the threshold (five
standard errors below it) are dropped.  The rest are confirmed on full shingle
sets in two rounds: the best earlier candidate of each class first; then every
candidate pair whose ends lie in different components by then.  So groups of
copies cost a pair each, not all pairs.

The forest alone can miss links, so an exact prefix-filter join of all classes
follows: sets that reach the threshold share one of the first n - need + 1
shingles in any fixed order.  Shingles that a sample finds in many classes come
last in it, and their classes are dealt to pairs of blocks; the sample decides
the order and the salt only, never the result.  Pairs within one component are
left out; the others are confirmed on full sets, block by block.

A set is known by a 64-bit hash: among 1e10 different sets about three pairs
would be taken for copies by chance.

Cases: null text counts as empty; an empty set is linked with nothing and its
document is kept; fewer words than a shingle are one shingle; repeated rows and
copies share a class; rows of one id form one group; a null id has a null
component and is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm import common

VALUES, TREES, KEY = 64, 16, 8
DEPTH, REGION, NEAR = 3, 64, 4
#: Classes of a common shingle that share a block, documents that are sampled for common shingles, common shingles at most,
#: and classes in a block of confirmation.
BLOCK, SAMPLED, COMMON, CONFIRMED = 500, 4000, 100_000, 1500
_FACTORS = np.random.default_rng(20240501).integers(1, 2**63, (2, VALUES), dtype=np.int64).astype(np.uint64)
_FACTORS[0] |= np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the runs of ``k`` words, A-Z lower-cased."""
    w = common.hashed_words(column, lower=True, both=False)
    every = common.window_hashes(w.a, k)
    begin = np.r_[0, w.ends[:-1]]
    out = []
    for b, e in zip(begin.tolist(), w.ends.tolist(), strict=True):
        if e - b >= k:
            x = np.sort(every[b : e - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        else:  # the whole sequence as one
            out.append(common.window_hashes(w.a[b:e], e - b) + np.uint64(e - b) if e > b else np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set, 16 bits of each."""
    best = np.full(VALUES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):
            x = s[at : at + 1024, None] * _FACTORS[0] + _FACTORS[1]
            np.minimum(best, x.min(axis=0), out=best)
    return (common.mix(best) & np.uint64(0xFFFF)).astype(">u2")


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts of a sample hold, and about how many texts of all hold each."""
    share = max(1, docs.count() // SAMPLED)
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    some = docs.select(t.alias("t"), "text").filter(F.pmod("t", F.lit(share)) == 0).dropDuplicates(["t"])

    def spell(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(shingle_sets(part.column("text"), k)).view(np.int64))], ["x"])

    counts = some.select("text").mapInArrow(common.per_slice(spell), "x bigint").groupBy("x").count()
    rows = counts.filter(F.col("count") >= max(3, BLOCK // share)).orderBy(F.desc("count"), "x").limit(COMMON).collect()
    x, n = np.array([r["x"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] * share for r in rows], np.int64)
    order = np.argsort(x)
    return x[order], n[order]


def times(s: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """About how many texts hold each shingle; 0 if it isn't a common one."""
    x, n = known
    if not len(x):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(x, s), len(x) - 1)
    return np.where(x[at] == s, n[at], 0)


def head(s: np.ndarray, percent: int, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - need + 1 shingles of a set, common ones last."""
    return s[np.lexsort((s, times(s, known)))][: len(s) + 1 - -(-percent * len(s) // 100)]


def sketch(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of 256 ranges, 255 for more: two sets share at most the sum of the lesser counts."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, Broadcast]:
    """doc_id, t (hash of the text), n, node (hash of the shingle set; null if empty), sig, head, sketch; the common shingles."""
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))  # of bounded size

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        n, node, sig, heads, counts = [], [], [], [], []
        for s in shingle_sets(part.column("text"), k):
            n.append(len(s))
            with np.errstate(over="ignore"):
                total = common.mix(np.array([common.mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0]
            node.append(int(total) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
            heads.append(head(s, percent, known.value).tobytes() if len(s) else None)
            counts.append(sketch(s) if len(s) else None)
        cols = [part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(heads, pa.binary()), pa.array(counts, pa.binary())]
        return pa.record_batch(cols, ["doc_id", "t", "n", "node", "sig", "head", "sketch"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    return keyed.mapInArrow(common.per_slice(sign), "doc_id bigint, t bigint, n bigint, node bigint, sig binary, head binary, sketch binary"), known


def _neighbours(tree: np.ndarray, key: np.ndarray, node: np.ndarray, n: np.ndarray, ratio: float, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows sorted by tree and key, of which the second is at or after ``fresh``."""
    left, right = [], []
    size = len(node)
    if size < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # how deep a row must agree with another: until few enough share the prefix
    need = np.full(size, KEY, np.int64)
    for depth in range(KEY - 1, DEPTH - 1, -1):
        new = np.r_[True, (tree[1:] != tree[:-1]) | (key[1:, :depth] != key[:-1, :depth]).any(axis=1)]
        region = np.cumsum(new) - 1
        need[np.bincount(region)[region] <= REGION] = depth
    for step in range(1, NEAR + 1):
        if step >= size:
            break
        a, b = np.arange(size - step), np.arange(step, size)
        same = (key[a] == key[b]) & (tree[a] == tree[b])[:, None]
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        ok = (prefix >= (need[a] if step > 1 else DEPTH)) & (b >= fresh) & (np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b]) - 1e-9)
        left.append(a[ok])
        right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def candidates(classes: DataFrame, ratio: float) -> DataFrame:
    """a, b (a < b): neighbours in some tree."""
    spark = classes.sparkSession
    wrapped = F.concat("sig", F.substring("sig", 1, 2 * KEY))
    per_tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(wrapped, t * (2 * VALUES // TREES) + 1, F.lit(2 * KEY)).alias("key")))
    rows = classes.select("node", F.col("n").cast("int").alias("n"), F.explode(per_tree).alias("x")).select("x.tree", "x.key", "node", "n")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        carry: list[np.ndarray] | None = None
        first: list[np.ndarray] | None = None
        names = ["a", "b", "side", "tree", "key", "n"]

        def out(a: np.ndarray, b: np.ndarray, side: np.ndarray | None = None, x: list[np.ndarray] | None = None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int32())
            if x is None:
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                return pa.record_batch([pa.array(lo), pa.array(hi), none, none, pa.nulls(len(a), pa.binary()), none], names)
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(side, pa.int32()), pa.array(x[0], pa.int32()), pa.array([k.tobytes() for k in x[1]], pa.binary()), pa.array(x[3], pa.int32())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, KEY)
            x = [batch.column(0).to_numpy(zero_copy_only=False), key, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)]
            fresh = len(carry[2]) if carry else 0
            both = [np.concatenate(p) for p in zip(carry, x, strict=True)] if carry else x
            if first is None or len(first[2]) < NEAR:
                first = [c[:NEAR] for c in both]
            a, b = _neighbours(*both, ratio, fresh)
            if len(a):
                yield out(both[2][a], both[2][b])
            carry = [c[-NEAR:] for c in both]
        # the ends of a partition meet those of the next one
        for side, x, border in ((1, first, part - 1), (0, carry, part)):
            if x is not None:
                m = len(x[2])
                yield out(x[2], np.full(m, border, np.int64), np.full(m, side), x)

    schema = "a bigint, b bigint, side int, tree int, key binary, n int"
    found = common.staged(rows.mapInArrow(link, schema), "candidates")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(pdf["key"]), ">u2").reshape(-1, KEY)
        pdf = pdf.assign(k=list(map(bytes, pdf["key"]))).reset_index(drop=True)
        order = pdf.sort_values(["side", "tree", "k", "a"]).index.to_numpy()
        node, side = pdf["a"].to_numpy()[order], pdf["side"].to_numpy()[order]
        i, j = _neighbours(pdf["tree"].to_numpy()[order], key[order], node, pdf["n"].to_numpy()[order], ratio, int((side == 0).sum()))
        ok = side[i] == 0
        i, j = node[i[ok]], node[j[ok]]
        return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)})

    # at most 2 x NEAR rows a border
    border = found.filter("side is not null").groupBy("b").applyInPandas(across, "a bigint, b bigint")
    return found.filter("side is null").select("a", "b").unionByName(border).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: connected components of (a, b), by alternating large and small stars."""
    e = common.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = common.staged(small.filter("u <> v").distinct(), "stars")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(both) - inter)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def verify(part: pa.RecordBatch) -> pa.RecordBatch:
        sets, others = shingle_sets(part.column("text"), k), shingle_sets(part.column("other"), k)
        ok = pa.array([_alike(x, y, percent) for x, y in zip(sets, others, strict=True)], pa.bool_())
        return part.select(["a", "b"]).filter(ok)

    one = texts.select(F.col("node").alias("b"), F.col("text").alias("other"))
    two = texts.select(F.col("node").alias("a"), "text")
    return pairs.join(one, "b").join(two, "a").select("a", "b", "text", "other").mapInArrow(common.per_slice(verify), "a bigint, b bigint")


#: One shingle of a set's head: the shingle, or a pair of blocks of it; size of the set, place in its order, side of the blocks, class and its label (0: its own).
HEAD = np.dtype([("key", "<u8"), ("n", "<u4"), ("place", "<u4"), ("side", "u1"), ("node", "<i8"), ("label", "<i8")])


def sharing(classes: DataFrame, known: Broadcast, percent: int, parts: int) -> DataFrame:
    """a, b (a < b): all pairs of (node, n, head, label) of two labels that share a shingle of their heads and may reach the threshold.

    A task holds the entries of a share; there are four times ``parts`` shares.
    """

    def spread(part: pa.RecordBatch) -> np.ndarray:
        """HEAD rows of some classes."""
        node, n, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "label"))
        heads = [np.frombuffer(h, np.uint64) for h in part.column("head").to_pylist()]
        size = np.array([len(h) for h in heads])
        x, of = np.concatenate(heads), np.repeat(np.arange(len(heads)), size)
        place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
        m = np.maximum(1, -(-times(x, known.value) // BLOCK))  # blocks of a common shingle
        at = np.repeat(np.arange(len(x)), m)
        other = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
        m, of = m[at], of[at]
        own = node[of] % m
        out = np.zeros(len(at), HEAD)
        with np.errstate(over="ignore"):
            both = common.mix(x[at] + common.mix((np.minimum(own, other) * m + np.maximum(own, other) + 1).astype(np.uint64)))
        out["key"] = np.where(m > 1, both, x[at])
        out["side"] = np.where(own == other, 2, np.where(own < other, 0, 1))
        out["n"], out["place"], out["node"] = n[of], place[at], node[of]
        out["label"] = np.where(label[of] == node[of], 0, label[of])
        return out

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = spread(batch.slice(at, 1000))
                share = (rows["key"] % np.uint64(4 * parts)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                rows, share = rows[order], share[order]
                cuts = np.flatnonzero(np.diff(share)) + 1
                if len(rows):
                    yield pa.record_batch([pa.array(share[np.r_[0, cuts]], pa.int32()), pa.array([common.pack(x) for x in np.split(rows, cuts)], pa.binary())], ["share", "rows"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [common.unpack(x, HEAD) for batch in batches for x in batch.column("rows").to_pylist()]
        if not cells:
            return
        rows = np.concatenate(cells)
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        again = np.zeros(len(rows), bool)
        again[1:] = key[1:] == key[:-1]
        rows = rows[order[again | np.r_[again[1:], False]]]  # shingles of one class only are no longer needed
        rows = rows[np.lexsort((rows["n"], rows["key"]))]
        n, place, side, node = (rows[c].astype(np.int64) for c in ("n", "place", "side", "node"))
        label = np.where(rows["label"] == 0, node, rows["label"])
        new = np.ones(len(rows), bool)
        new[1:] = rows["key"][1:] != rows["key"][:-1]
        group = np.cumsum(new) << 32
        # sets of a shingle by size: those before a set that are large enough for it
        first = np.searchsorted(group + n, group - (-percent * n // 100))
        live, back = np.flatnonzero(np.arange(len(n)) > first), 1
        while len(live):
            i, j = live, live - back
            rest = np.minimum(n[i] - place[i], n[j] - place[j])  # what two sets can share from here on
            ok = (label[i] != label[j]) & ((side[i] == 2) | (side[i] != side[j])) & ((100 + percent) * rest >= percent * (n[i] + n[j]))
            a, b = node[i[ok]], node[j[ok]]
            if len(a):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            back += 1
            live = live[live - first[live] >= back]

    rows = classes.select("node", "n", "head", "label").mapInArrow(deal, "share int, rows binary")
    return rows.repartition(4 * parts, "share").mapInArrow(meet, "a bigint, b bigint").distinct()


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave room for the threshold; none that reaches it is dropped."""

    def fits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                least = np.minimum(*(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("sketch", "other")))
                ok = (100 + percent) * least.sum(axis=1, dtype=np.int64) >= percent * batch.column("n").to_numpy(zero_copy_only=False)
                yield batch.select(["a", "b"]).filter(pa.array(ok | (least == 255).any(axis=1)))

    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), "sketch")
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("other"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sketch", "other", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(fits, "a bigint, b bigint")


def confirmed_in_blocks(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold, of each block as many as connect what all of them do; a block has each text once."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    m = max(8, -(-ends.count() // CONFIRMED))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(m))
    pairs = pairs.select("a", "b", (F.least(part("a"), part("b")) * m + F.greatest(part("a"), part("b"))).alias("block"))
    sides = pairs.select("block", F.explode(F.array("a", "b")).alias("node")).distinct().join(texts, "node").select(F.col("block").alias("of"), "node", "text")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {}
        for part in right.to_batches(max_chunksize=200):
            sets |= dict(zip(part.column("node").to_pylist(), shingle_sets(part.column("text"), k), strict=True))
        up = {x: x for x in sets}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        kept: tuple[list, list] = ([], [])
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                if _alike(sets[a], sets[b], percent):
                    up[x] = y
                    kept[0].append(a)
                    kept[1].append(b)
        return pa.table({"a": pa.array(kept[0], pa.int64()), "b": pa.array(kept[1], pa.int64())})

    return pairs.groupBy("block").cogroup(sides.groupBy("of")).applyInArrow(verify, "a bigint, b bigint")


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, text of the classes (node, t); copies of a text have one hash, and one of them is enough."""
    text = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    return text.join(needed.hint("shuffle_hash"), "t").select("node", "text").dropDuplicates(["node"])


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), n, label (of the group; null if it has no shingles), component_id."""
    common.ship(docs.sparkSession)
    signed, known = signatures(docs, k, percent)
    signed = common.staged(signed, "signatures")
    filled = signed.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = filled.groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "t")).alias("x"), F.min(F.struct("sig", "head", "sketch")).alias("y"))
    classes = common.staged(classes.select("node", "n", "x.t", F.col("x.doc_id").alias("first"), "y.sig", "y.head", "y.sketch"), "classes")
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / VALUES) ** 0.5
    pairs = candidates(classes, percent / 100)

    def agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, VALUES) for c in ("sig", "other"))
                same = (x == y).mean(axis=1)
                ok = np.flatnonzero(same >= least)
                rows = batch.take(pa.array(ok))
                yield pa.record_batch([rows.column("a"), rows.column("b"), pa.array(same[ok])], ["a", "b", "estimate"])

    sig = classes.select("node", "sig")
    pairs = pairs.join(sig.select(F.col("node").alias("a"), "sig"), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("other")), "b")
    pairs = common.staged(pairs.select("a", "b", "sig", "other").mapInArrow(agreeing, "a bigint, b bigint, estimate double"), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "t"), "node")
    texts = common.staged(texts_of(docs, needed), "texts")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")
    links = common.staged(confirmed(best, texts, k, percent), "links")
    label = components(links)
    ends = pairs.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    open_pairs = ends.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    links = common.staged(links.unionByName(confirmed(open_pairs, texts, k, percent)), "links")
    label = common.staged(components(links), "labels")
    # whatever the forest missed, by the exact way
    labelled = classes.select("node", F.col("n"), "head").join(label, "node", "left").select("node", "n", "head", F.coalesce("label", "node").alias("label"))
    left = common.staged(possible(sharing(labelled, known, percent, common.splits(classes)), classes, percent), "left")
    needed = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "t"), "node")
    found = common.staged(confirmed_in_blocks(left, common.staged(texts_of(docs, needed), "left-texts"), k, percent), "left-links")
    if found.limit(1).count():
        label = common.staged(components(links.unionByName(found)), "labels")
    # classes that share an id are one group too, as rows of one id are one document
    named = classes.select("node", "first").join(label, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    least_id = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = named.join(least_id, "label").select("node", "label", "component_id")
    return signed.select("doc_id", "t", "n", "node").join(of, "node", "left").select("doc_id", "t", "n", "label", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; links have 100 |A & B| >= percent |A | B|."""
    component = F.coalesce("component_id", "doc_id")
    return grouped(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group, that of the least id and text hash; rows without an id stay.

    Rows that share an id are rows of their own: only linked ones go, and all but one of those equal in id and text.
    """
    found = common.staged(grouped(docs, k, percent).filter("doc_id is not null").groupBy("doc_id", "t", "label").count(), "grouped")
    first = found.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "t")).alias("x")).select("x.doc_id", "x.t")
    stay = common.staged(first.unionByName(found.filter("label is null").select("doc_id", "t")), "kept-rows")
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    of = stay.select(F.col("doc_id").alias("stays"), F.col("t").alias("hash"))
    out = docs.filter("doc_id is not null").join(of, (F.col("doc_id") == F.col("stays")) & (t == F.col("hash")), "left_semi").select(*docs.columns)
    if found.filter("count > 1").limit(1).count():
        least = F.min(F.struct(*docs.columns)).alias("x")
        out = out.groupBy(F.col("doc_id").alias("stays"), t.alias("hash")).agg(least).select("x.*")
    return out.unionByName(docs.filter("doc_id is null"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``, four-word shingles, similarity 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(list_slice(w, i, i + 3), ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), class AS (SELECT list_sort(s) AS s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), item AS (SELECT c, n, unnest(s) AS x FROM class
), pair AS (
  SELECT a.c AS a, b.c AS b FROM item a JOIN item b ON a.x = b.x AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (SELECT c, c AS r FROM class UNION SELECT reach.c, edge.b FROM reach JOIN edge ON reach.r = edge.a
), part AS (SELECT c, min(r) AS component FROM reach GROUP BY c)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN class ON class.s = list_sort(sets.s) LEFT JOIN part USING (c)
"""
