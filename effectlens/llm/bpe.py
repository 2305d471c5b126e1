"""Operator 6: byte-level BPE encoding and decoding with a contiguous rank array.

Every pre-token ("word") is a row of part boundaries beside the merge ranks of
neighbouring parts.  A sweep scans each word for its minimum rank, deletes that
boundary and refreshes only the ranks beside it; words without a mergeable pair
leave the arrays.  The arrays of many words lie end to end in NumPy vectors, so
one sweep advances thousands of words.  Words met before come from a bounded
cache.

Cases: null text counts as empty; an empty text has no tokens, the digests of
empty strings; a special token's string inside a text becomes that token; very
long words take the same path; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from effectlens.llm import common

_NONE = np.int32(2**31 - 1)
#: Bits of the open-addressing table that maps a pair of token ids to its rank.
_BITS = 20


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RankArrayBPE:
    """Encoder and decoder over the JSON file of a byte-level BPE tokenizer."""

    def __init__(self, raw: bytes):
        import regex

        spec = json.loads(raw)
        kind = spec["pre_tokenizer"]
        if spec.get("normalizer") or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("only plain byte-level tokenizers are supported")
        vocab = spec["model"]["vocab"]
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.uint32)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = [b""] * (1 + max(*vocab.values(), *self.special.values(), 0))
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.names = [str(i) for i in range(len(self.bytes_of))]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("pairs of ids are kept in 32 bits: a vocabulary has at most 65,536 entries")
        left = np.array([vocab[a] for a, _ in merges], np.uint32)
        right = np.array([vocab[b] for _, b in merges], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.uint32)
        self._table((left << np.uint32(16)) | right)
        self.byte_rank = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _table(self, keys: np.ndarray) -> None:
        size = 1 << _BITS
        self.keys, self.ranks, self.probes = np.full(size + 64, 0xFFFFFFFF, np.uint32), np.full(size + 64, _NONE, np.int32), 1
        slots = self._slot(keys)
        for rank, (key, at) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            probe = 1
            while self.keys[at] != 0xFFFFFFFF and self.keys[at] != key:
                at, probe = at + 1, probe + 1
            if self.keys[at] != key:
                self.keys[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, probe)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint32(2654435769)) >> np.uint32(32 - _BITS)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NONE where they don't merge."""
        keys = (a << np.uint32(16)) | b
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        left = np.flatnonzero(self.keys[at] != keys)
        for probe in range(1, self.probes):
            if not len(left):
                break
            near = at[left] + probe
            hit = self.keys[near] == keys[left]
            found[left[hit]] = self.ranks[near[hit]]
            left = left[~hit & (self.keys[near] != 0xFFFFFFFF)]
        return found

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte_ids[flat]
        word = np.repeat(np.arange(n, dtype=np.int32), size)
        rank = np.full(len(ids), _NONE, np.int32)
        if len(ids):
            rank[:-1] = self.byte_rank[(flat[:-1].astype(np.int32) << 8) | flat[1:]]
            rank[np.cumsum(size) - 1] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            spans = np.diff(np.r_[first, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, first), spans)
            over = least == _NONE
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, least = ids[~over], word[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            # boundaries to delete: every leftmost, non-overlapping pair of the least rank
            cut = np.flatnonzero(rank == least)
            fresh = np.r_[True, cut[1:] != cut[:-1] + 1]
            start = np.maximum.accumulate(np.where(fresh, cut, -1))
            cut = cut[((cut - start) & 1) == 0]
            ids[cut] = self.merged[rank[cut]]
            keep = np.ones(len(ids), bool)
            keep[cut + 1] = False
            at = cut - np.arange(len(cut))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            last = len(ids) - 1
            # only the ranks beside a deleted boundary change
            for side in (at, at[at > 0] - 1):
                rank[side] = _NONE
                side = side[side < last]
                side = side[word[side] == word[side + 1]]
                rank[side] = self._rank(ids[side], ids[side + 1])
        count = np.zeros(n, np.int64)
        for w, _ in done:
            count += np.bincount(w, minlength=n)
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for w, x in done:
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            inside = np.arange(len(w)) - np.repeat(new, np.diff(np.r_[new, len(w)]))
            out[offset[w] + inside] = x
        return out, count

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: Classes of code points: letters, numbers, anything else, white space, end of a text.
_L, _N, _O, _S, _END = range(5)
#: White space as byte-level tokenizers know it (a fixed value).
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    import unicodedata

    major = {"L": _L, "N": _N}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], _O) for c in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = _S
    return out


class CachedEncoder:
    """Ids of many texts at once.

    Pre-token boundaries are found on arrays of code points; each distinct
    pre-token of a slice is encoded once, and those met before come from a
    bounded cache: sorted hashes beside a pool of ids.
    """

    #: Pre-tokens that the cache holds at most; beyond it the cache starts again.
    MOST = 1_500_000

    def __init__(self, bpe: RankArrayBPE):
        self.bpe, self.cls = bpe, _classes()
        self._grow(1 << 16)
        self._forget()

    def _grow(self, n: int) -> None:
        self.power, self.inverse = common._powers(common._BASE, n), common._powers(common._INVERSE, n)

    def _forget(self) -> None:
        self.known, self.begin, self.count, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _starts(self, ch: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``cls`` ends with _END."""
        start = np.empty(len(cls), bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        # the last of a run of white space before other text stands apart, and a space joins that text
        j = np.flatnonzero((cls[:-1] == _S) & (cls[1:] < _S))
        start[j] = True
        start[j[ch[j] == 32] + 1] = False
        # contractions: an apostrophe that begins a pre-token, and one or two letters
        p = np.flatnonzero((ch == 39) & start)
        p = p[p + 1 < len(cls)]
        one = np.isin(ch[p + 1], [ord(c) for c in "stmd"])
        q = p[p + 2 < len(cls)]
        a, b = ch[q + 1], ch[q + 2]
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        two &= (cls[q + 1] == _L) & (cls[q + 2] == _L)
        for at, size in ((p[one & (cls[p + 1] == _L)], 1), (q[two], 2)):
            start[at + 1] = False
            start[at + 1 + size] = True
        return start

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[str] = []  # texts without special tokens
        plan: list[list[tuple[int, int]]] = []  # (part, -1) or (-1, special id)
        for t in texts:
            if self.bpe.special_split is not None and any(s in t for s in self.bpe.special):
                here = []
                for x in filter(None, self.bpe.special_split.split(t)):
                    if x in self.bpe.special:
                        here.append((-1, self.bpe.special[x]))
                    else:
                        here.append((len(parts), -1))
                        parts.append(x)
                plan.append(here)
            else:
                plan.append([(len(parts), -1)])
                parts.append(t)
        ids, ends = self._encode(parts)
        begin = [0, *ends]
        return [ids[begin[h[0][0]] : ends[h[0][0]]] if len(h) == 1 and h[0][0] >= 0 else np.concatenate([ids[begin[k] : ends[k]] if k >= 0 else np.array([s], np.uint32) for k, s in h]) for h in plan]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all parts end to end, and where each part's ids end."""
        big = "\n".join([*parts, ""])
        ch = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(ch) == 0:
            return np.empty(0, np.uint32), []
        cls = self.cls[ch]
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        cls[stops] = _END
        start = np.flatnonzero(self._starts(ch, cls) | (cls == _END))
        end = np.r_[start[1:], len(ch)]
        real = cls[start] != _END
        start, end = start[real], end[real]
        if len(ch) > len(self.power):
            self._grow(2 * len(ch))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(ch) + 1, np.uint64)
            np.cumsum(common.mix(ch.astype(np.uint64) + np.uint64(1)) * self.power[: len(ch)], out=sums[1:])
            h = common.mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, kinds)
        hit = np.zeros(len(kinds), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == kinds[inside]
        begin, count = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        begin[hit], count[hit] = self.begin[at[hit]], self.count[at[hit]]
        new = np.flatnonzero(~hit)
        pool = self.pool
        if len(new):
            lo, hi = start[first[new]].tolist(), end[first[new]].tolist()
            ids, size = self.bpe.encode_words([big[a:b].encode("utf-8", "surrogatepass") for a, b in zip(lo, hi, strict=True)])
            begin[new], count[new] = len(pool) + np.cumsum(size) - size, size
            pool = np.concatenate([pool, ids])
            if len(self.known) + len(new) > self.MOST:
                self._forget()
            else:
                self.pool = pool
                self.known = np.insert(self.known, at[new], kinds[new])
                self.begin = np.insert(self.begin, at[new], begin[new])
                self.count = np.insert(self.count, at[new], count[new])
        size = count[which]
        total = np.cumsum(size)
        flat = pool[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin[which] - (total - size), size)]
        # the ids of a part end where those of its last pre-token do
        upto = np.r_[0, total][np.searchsorted(start, stops)]
        return flat, upto.tolist()


_LOADED: dict[int, CachedEncoder] = {}


def cached_encoder(raw: bytes) -> CachedEncoder:
    """One encoder a worker process, kept between tasks."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED[key] = CachedEncoder(RankArrayBPE(raw))
    return _LOADED[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = cached_encoder(raw.value)
        name = encoder.bpe.names.__getitem__
        n, ids_sha, text_sha = [], [], []
        for ids in encoder.encode(common.texts(part, text)):
            x = ids.tolist()
            n.append(len(x))
            ids_sha.append(hashlib.sha256(",".join(map(name, x)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(encoder.bpe.decode(x).encode()).hexdigest())
        return pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.keyed_texts(docs, text).mapInArrow(common.per_slice(digest, text), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded."""
    return encode_decode(common.table(spark, sf_dir, "documents"), common.tokenizer_file())
