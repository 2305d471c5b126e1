"""Operator 4: best-fit packing of token sequences with a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens.  Pieces of one length
are interchangeable, so a packing is a multiset of patterns (the lengths in a
bin) with copies: its size depends on ``capacity`` alone, never on the number
of documents.  Islands begin with packings made in orders of their own and
evolve them apart: crossover injects whole well-filled bins of one parent, the
other parent's bins that would use pieces twice are removed, displaced pieces
take the places of shorter ones where that fills a bin further, and what is then
left goes back by best fit.  After each epoch every island's elite also moves to
the next island through a shuffle.  The packing that is returned comes from
crossover; an island stops breeding at the lower bound, ceil(tokens /
capacity).  Pieces then take the places of their length by rank, numbered
without bringing a length's pieces together in one task.

Cases: null and empty texts are one piece of the separator alone; very long
texts are cut into pieces of ``capacity``, of which the first may be shorter;
repeated rows are separate pieces; extra columns of ``documents`` are ignored,
those of pieces stay, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from effectlens.llm import bpe, common

CAPACITY, SEPARATOR = 2048, 0
#: Islands, epochs between migrations, individuals of an island, generations of an epoch.
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4, 3, 6, 12
#: Patterns of a packing at most, in units of the capacity: what is broadcast is bounded by it.
PATTERNS = 8
#: Pieces of one length that are numbered together.
RANKED = 50_000

Packing = dict[tuple[int, ...], int]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents ended by the separator, long ones cut."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, ids in zip(part.column("doc_id").to_pylist(), bpe.cached_encoder(raw.value).encode(common.texts(part)), strict=True):
            ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
            first = len(ids) % capacity or capacity
            starts = [0, *range(first, len(ids), capacity)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                for to, x in zip(rows, (doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist() if with_ids else None), strict=True):
                    to.append(x)
        out = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
        return pa.record_batch(out if with_ids else out[:5], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return common.keyed_texts(docs).mapInArrow(common.per_slice(cut), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def best_fit(counts: dict[int, int], packing: Packing, capacity: int, order: list[int] | None = None) -> Packing:
    """Place ``counts`` pieces of each length, longest first unless ordered, into the fullest bins that hold them."""
    out: Packing = Counter(packing)
    by_room: dict[int, list[tuple[int, ...]]] = {}
    for p in out:
        by_room.setdefault(capacity - sum(p), []).append(p)
    rooms = sorted(by_room)

    def add(p: tuple[int, ...], n: int) -> None:
        if out[p] == 0:
            room = capacity - sum(p)
            if room not in by_room or not by_room[room]:
                by_room.setdefault(room, [])
                if (i := bisect.bisect_left(rooms, room)) == len(rooms) or rooms[i] != room:
                    rooms.insert(i, room)
            by_room[room].append(p)
        out[p] += n

    for length in order or sorted(counts, reverse=True):
        left = counts.get(length, 0)
        while left:
            i = bisect.bisect_left(rooms, length)
            while i < len(rooms) and not by_room[rooms[i]]:
                rooms.pop(i)
            if i < len(rooms):
                p = by_room[rooms[i]][-1]
                n = min(left, out[p])
                if n == out[p]:
                    by_room[rooms[i]].pop()
                    del out[p]
                else:
                    out[p] -= n
                add(tuple(sorted((*p, length), reverse=True)), n)
                left -= n
            else:
                fit = capacity // length
                if left >= fit:
                    add((length,) * fit, left // fit)
                if left % fit:
                    add((length,) * (left % fit), 1)
                left = 0
    return dict(out)


def cost(packing: Packing, capacity: int) -> tuple[int, float]:
    """Bins, then how unevenly they are filled (less is better)."""
    return sum(packing.values()), -sum(n * (sum(p) / capacity) ** 2 for p, n in packing.items())


def replace(child: Packing, left: Counter, capacity: int) -> None:
    """Let displaced pieces take the places of shorter ones where a bin gets fuller so; the shorter ones are displaced."""
    for p in sorted((p for p in child if sum(p) < capacity), key=lambda p: (sum(p), p)):
        room = capacity - sum(p)
        best = (0, 0, 0)
        for y in set(p):
            x = next((x for x in range(y + room, y, -1) if left.get(x, 0) > 0), 0)
            if x - y > best[0] and x:
                best = (x - y, x, y)
        if best[0]:
            _, x, y = best
            n = min(child[p], left[x])
            q = list(p)
            q.remove(y)
            child[tuple(sorted((*q, x), reverse=True))] += n
            child[p] -= n
            if not child[p]:
                del child[p]
            left[x] -= n
            left[y] += n


def crossover(a: Packing, b: Packing, counts: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Whole well-filled bins of ``b``, the bins of ``a`` that use no piece twice, then replacement and best fit of the rest."""
    left, child = Counter(counts), Counter()

    def take(p: tuple[int, ...], n: int) -> None:
        need = Counter(p)
        n = min([n, *(left[x] // m for x, m in need.items())])
        if n > 0:
            child[p] += n
            for x, m in need.items():
                left[x] -= n * m

    full, share = sorted(b, key=lambda p: (-sum(p), p)), rng.choice((0.05, 0.2, 0.5))
    for p in full[: max(1, len(full) // 2)]:
        if rng.random() < share:
            take(p, rng.randint(1, b[p]))
    # of the other parent more or fewer of the worst-filled bins are dissolved too, so that there are pieces to move
    other = sorted(a, key=lambda p: (-sum(p), rng.random()))
    for p in other[: int(len(other) * rng.random())]:
        take(p, a[p])
    replace(child, left, capacity)
    return best_fit({x: n for x, n in left.items() if n > 0}, child, capacity)


def evolve(counts: dict[int, int], elites: list[Packing], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> tuple[Packing, int]:
    """The best packing that crossover makes on an island, and the generations that were bred.

    ``elites`` come from earlier epochs; without any the island begins with random orders.
    """
    rng = random.Random(seed)
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    better = lambda p: cost(p, capacity)
    bred = sorted(elites, key=better)[:1]
    if bred and better(bred[0])[0] <= bound:
        return bred[0], 0
    people = list(elites)
    while len(people) < population:  # orders by length, more or less disturbed
        stir = rng.choice((0.0, 0.02, 0.05, 0.1, 0.2, 0.4))
        people.append(best_fit(counts, {}, capacity, sorted(counts, key=lambda x: -x * rng.uniform(1 - stir, 1 + stir))))
    done = 0
    while done < generations and not (bred and better(bred[0])[0] <= bound):
        done += 1
        children = []
        for _ in range(population):
            child = crossover(*rng.sample(people, 2), counts, capacity, rng)
            if len(child) <= max(PATTERNS * capacity, 64):
                children.append(child)
                if better(child)[0] <= bound:
                    break
        bred = sorted([*bred, *children], key=better)[:1]
        # one of each packing, so that an island does not become all alike
        people = sorted({tuple(sorted(p.items())): p for p in [*people, *children]}.values(), key=better)[:population]
        if len(people) < 2:
            break
    return min([*bred, *people], key=lambda p: better(p)[0]), done  # of as few bins, the bred one


def _dump(p: Packing) -> bytes:
    return np.array([y for k, n in sorted(p.items()) for y in (n, len(k), *k)], np.int64).tobytes()


def _load(x: bytes) -> Packing:
    v, out, i = np.frombuffer(x, np.int64).tolist(), {}, 0
    while i < len(v):
        out[tuple(v[i + 2 : i + 2 + v[i + 1]])] = v[i]
        i += 2 + v[i + 1]
    return out


@dataclass(frozen=True)
class Plan:
    """A packing, and the generations and migrations that led to it."""

    packing: Packing
    generations: int = 0
    migrations: int = 0


def plan(spark: SparkSession, counts: dict[int, int], capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> Plan:
    """Evolve on islands; ``counts`` has at most ``capacity`` entries."""
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)

    def grower(epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            island = int(pdf["island"].iloc[0])
            best, done = evolve(counts, [_load(x) for x in pdf["packing"] if x is not None], capacity, 1000 * epoch + island)
            bins, evenness = cost(best, capacity)
            return pd.DataFrame({"island": [island], "bins": [bins], "evenness": [evenness], "generations": [done + int(pdf["generations"].max())], "packing": [_dump(best)]})

        return grow

    elites, moved = None, 0
    for epoch in range(epochs):
        if elites is None:
            asked = spark.range(islands).select(F.col("id").alias("island"), F.lit(0).cast("bigint").alias("generations"), F.lit(None).cast("binary").alias("packing"))
        else:  # every elite stays, and a copy moves to the next island
            kept = elites.select("island", "generations", "packing")
            asked = kept.unionByName(kept.withColumn("island", (F.col("island") + 1) % islands))
            moved += islands
        elites = common.staged(asked.repartition(islands, "island").groupBy("island").applyInPandas(grower(epoch), "island bigint, bins bigint, evenness double, generations bigint, packing binary"), f"islands{epoch}")
        if epoch and elites.agg(F.min("bins")).first()[0] <= bound:
            break
    best = elites.orderBy("bins", "evenness", "island").first()
    return Plan(_load(best["packing"]), best["generations"], moved)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id, offset, and the generations and migrations of the packing."""
    spark = pieces.sparkSession
    common.ship(spark)
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("pieces must have 1 to capacity tokens")
    found = plan(spark, counts, capacity) if counts else Plan({})
    slots: dict[int, tuple[list, list, list]] = {}
    used, base = Counter(), 0
    for p, n in sorted(found.packing.items()):
        offset = 0
        for x in p:
            lo, first, at = slots.setdefault(x, ([], [], []))
            lo.append(used[x])
            first.append(base)
            at.append(offset)
            used[x] += n
            offset += x
        base += n
    if used != Counter(counts):
        raise AssertionError("a packing must hold every piece once")
    places = spark.sparkContext.broadcast({x: tuple(np.array(v, np.int64) for v in s) for x, s in slots.items()})  # PATTERNS x capacity patterns at most
    # rank of a piece among those of its length: inside a block, plus the blocks before it
    blocks = max(8, -(-max(counts.values(), default=1) // RANKED))
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), F.col("length").alias("size"))
    dealt = rows.withColumn("hash", F.xxhash64("row")).withColumn("block", F.pmod("hash", F.lit(blocks)))
    before = dealt.groupBy("size", "block").count()
    w = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("size", "block", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy("size", "block").orderBy("hash", "row.doc_id", "row.piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["size", "block"])
    ranked = ranked.select("row", "size", (F.col("rank") + F.col("base")).cast("long").alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = length == x
                lo, first, at = places.value[x]
                i = np.searchsorted(lo, rank[mine], side="right") - 1
                seq[mine], off[mine] = first[i] + rank[mine] - lo[i], at[i]
            yield pa.record_batch([batch.column("row"), pa.array(seq), pa.array(off)], ["row", "sequence", "place"])

    schema = StructType([ranked.schema["row"], *(StructField(c, LongType()) for c in ("sequence", "place"))])
    out = ranked.mapInArrow(place, schema)
    mine = {"sequence_id": F.col("sequence"), "offset": F.col("place"), "generations": F.lit(found.generations).cast("long"), "migrations": F.lit(found.migrations).cast("long")}
    kept = [F.col("row").getField(c).alias(c) for c in pieces.columns if c not in mine]
    return out.select(*kept, *[c.alias(k) for k, c in mine.items()])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(common.staged(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"), common.tokenizer_file())
