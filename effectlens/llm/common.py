"""What the training-data operators share: tables, staging, words, batches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a worker holds as Python objects at one time.
CHUNK_CHARS = 500_000

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package wherever the driver was started.

    On a cluster the package is given with ``--py-files`` or installed.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/effectlens-{os.getpid()}"
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: this cuts lineage
    and survives lost executors, as every executor sees the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def splits(table: DataFrame) -> int:
    """How many tasks read a staged table: a number that grows with it, by which its rows can be dealt in shares of bounded size."""
    return max(8, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.rdd.getNumPartitions())


def words_of(text: str) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    if text.isascii():
        return text.split() if not _ODD_SPACE.search(text) else _WORD.findall(text)
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every worker of an application.

    Spark starts all Python workers with one fixed PYTHONHASHSEED, so that
    ``hash`` agrees between them; without it equal words would not meet.
    """
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def keyed_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id as a long, whatever integer it is, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)


def require_stable_hash() -> None:
    seed = os.environ.get("PYTHONHASHSEED", "random")
    if seed == "random":
        raise RuntimeError("Python workers need one fixed PYTHONHASHSEED")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """The words of texts end to end: two independent 64-bit hashes, text and line of each, and where each text's words end."""

    a: np.ndarray
    b: np.ndarray
    text: np.ndarray
    line: np.ndarray
    ends: np.ndarray


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _factors(n: int, seed: int) -> np.ndarray:
    """Odd numbers by place, as if drawn at random."""
    with np.errstate(over="ignore"):
        return mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def hashed_words(column: pa.Array, lower: bool = False, both: bool = True, space: np.ndarray = _SPACE, breaks: bytes = b"\n") -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column, found and hashed on its bytes; null is empty; ``lower`` maps A-Z to a-z, without ``both`` there is one hash.

    ``space`` says of each byte whether it stands between words, ``breaks`` which of these end a line.

    A word's hashes are sums of its bytes times random numbers of their places.
    """
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        raw = _LOWER[raw]
    inside = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a word goes on after a byte of its own, but not in the next text
    edge[1:] = inside
    edge[offsets[:-1]] = False
    start = np.flatnonzero(inside & ~edge[:-1])
    edge = np.ones(len(raw) + 1, bool)
    edge[:-1] = ~inside
    edge[offsets[1:]] = True
    upto = np.flatnonzero(edge[1:] & inside) + 1
    size = upto - start
    place = np.arange(len(raw), dtype=np.int32 if len(raw) < 2**31 else np.int64)
    if len(start):
        place -= np.repeat(np.r_[place[:1], place[start]], np.diff(np.r_[0, start, len(raw)]))
    longest = int(place.max(initial=-1)) + 1
    value = raw.astype(np.uint64) + np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x1234567, 0x89ABCDEF)[: 1 + both]:  # what stands between words is in no difference of sums
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(value * _factors(longest, seed)[place], out=sums[1:])
            out.append(mix(sums[upto] - sums[start] + size.astype(np.uint64) * np.uint64(seed)))
    ends = np.searchsorted(start, offsets[1:])
    held = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(n), held)
    lines = np.flatnonzero(np.isin(raw, np.frombuffer(breaks, np.uint8)) if len(breaks) > 1 else raw == breaks[0])
    line = np.cumsum(np.bincount(np.searchsorted(start, lines), minlength=len(start) + 1))[: len(start)] - np.repeat(np.searchsorted(lines, offsets[:-1]), held)
    return Words(out[0], out[-1], text, line, ends)


#: An odd base; its powers and inverse powers turn running sums into window hashes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values; empty if there are fewer."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h) * _powers(_BASE, n), out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1))


def slices(batch: pa.RecordBatch, text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``chars`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    begin, n = 0, batch.num_rows
    while begin < n:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def per_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``, applied to bounded slices of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        require_stable_hash()
        for batch in batches:
            for part in slices(batch, text):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def per_group(f: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None], keys: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow`` over rows sorted by ``keys``: it gets whole groups, and where each begins and ends."""

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                cuts = ends(table.to_batches()[0])
                made = f(table, np.r_[0, cuts], np.r_[cuts, table.num_rows])
                if made is not None and made.num_rows:
                    yield made

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = ends(batch)
            if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in keys):
                yield from out()
                held = []
            if len(cuts):  # the last group may go on
                held.append(batch.slice(0, int(cuts[-1])))
                yield from out()
                held = [batch.slice(int(cuts[-1]))]
            else:
                held.append(batch)
        yield from out()

    return run


def texts(part: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; a null text is empty."""
    return [x or "" for x in part.column(text).to_pylist()]


def pack(rows: np.ndarray) -> bytes:
    """Rows as columns of bytes: constant ones vanish when Spark compresses a shuffle."""
    return rows.view(np.uint8).reshape(len(rows), rows.itemsize).T.tobytes()


def unpack(cell: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Default place of a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
