"""Operator 1: personal data by patterns and a semi-Markov conditional random field.

Base spans come from fixed patterns.  A semi-Markov CRF then looks at the
places that hold many digits or spelled-out addresses and that no base span
covers: whole-span features (shape, digits, checksums, markers, the words and
characters beside it) score every candidate segment of at most LONGEST tokens
and every kind, and dynamic programming chooses boundaries and kinds together.
What it finds beside base spans is added; base spans always stay.

The model is trained on sentences that this module makes from a fixed seed:
written forms of the four kinds, and look-alikes that are none of them.

Cases: null text counts as empty and has no spans; texts of any length are
searched whole; spans of different kinds may overlap as the patterns allow, an
added span overlaps no other; digits are those of ASCII, others are marks; long
tables of numbers are decoded place by place; repeated ids each have a row; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from effectlens.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, digits of a number at most, characters of a token at most, characters of context beside a trigger.
LONGEST, MOST_DIGITS, LONGEST_TOKEN, CONTEXT = 16, 19, 4096, 48
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


_DOUBLED = {str(d): 2 * d - 9 if d > 4 else 2 * d for d in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(_DOUBLED.__getitem__, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern spans, by kind as listed, then start."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the model

#: Words beside a span that hint at its kind, and last labels of host names (fixed values).
_CUES = {
    "phone": "phone", "call": "phone", "tel": "phone", "telephone": "phone", "mobile": "phone", "cell": "phone", "fax": "phone", "dial": "phone", "telefon": "phone",
    "mail": "email", "email": "email", "contact": "email", "write": "email", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "pay": "card",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "ping": "ip", "order": "no", "invoice": "no", "isbn": "no", "version": "no", "id": "no", "token": "no", "page": "no", "date": "no",
}
_ENDS = frozenset("com org net edu gov io co de fr es uk eu info example".split())
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Digit groups with up to four marks or spaces between them; they trigger with seven digits, or from four groups on.
_DIGITS = re.compile(r"[0-9]++(?:[\W_]{1,4}+[0-9]++)*+")
_SPELLED = re.compile(r"(?i)\bdot\b|[\[({]\s?(?:at|dot|\.|@)\s?[\])}]|\s@\s")
_GROUP = re.compile(r"[0-9]+")
_LABELS = ("none", *KINDS)


class _Tokens:
    """Tokens with what the features need of each; ``push`` adds the next one, ``forget`` drops early ones.

    Digits are ASCII digits; other characters that Python calls digits, such as a superscript two, are marks.
    """

    def __init__(self, text: str):
        self.text = text
        self.token: list[str] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.shape: list[str] = []
        self.number: list[bool] = []
        self.cue: list[str] = []  # beside each token: the nearest hint of the four before it
        self.left: list[str] = []
        self.right: list[str] = []
        self._hints: list[str | None] = []

    def push(self, t: str, s: int, e: int) -> None:
        low, gap = t.lower(), "_" if self.stop and s > self.stop[-1] else ""
        number = "0" <= t[0] <= "9"
        if number:
            n = len(t)
            x = "d" if n <= 3 else "q" if n == 4 else "m" if n <= 12 else "L" if n <= 19 else "X"
        elif t[0].isalpha():
            x = "@w" if low == "at" else ".w" if low == "dot" else "t" if low in _ENDS else "a"
        else:
            x = t
        before, after = self.text[s - 1 : s], self.text[e : e + 1]
        self.cue.append(next((c for c in reversed(self._hints[-4:]) if c), "-"))
        self.left.append("word" if before.isalnum() else before if before in "=\"'/.-_#$:" else "-")
        self.right.append("word" if after.isalnum() else "join" if after in "-/_@%" and after else "-")
        self._hints.append(_CUES.get(low))
        self.token.append(t)
        self.start.append(s)
        self.stop.append(e)
        self.shape.append(gap + x)
        self.number.append(number)

    def forget(self, n: int) -> None:
        for x in (self.token, self.start, self.stop, self.shape, self.number, self.cue, self.left, self.right, self._hints):
            del x[:n]

    def segments(self, j: int) -> Iterator[tuple[int, tuple]]:
        """(i, traits) of each feasible segment i..j-1, from the shortest on: what could be an entity of some kind, and all that its features depend on.

        An e-mail address has a sign or word for "at" and a dot after it; the
        other kinds hold 4 to 19 digits and no words but "dot".
        """
        token, shapes, number = self.token, self.shape, self.number
        last = token[j - 1]
        if not last[-1].isalnum():
            return
        least = max(0, j - LONGEST)
        at = any("@" in x for x in shapes[least:j])
        shape, host, n, ats, plain = "", "", 0, 0, True
        numbers: list[str] = []
        for i in range(j - 1, least - 1, -1):
            t = token[i]
            shape = shapes[i] + shape
            if number[i]:
                n += len(t)
                numbers.insert(0, t)
            elif t[0].isalpha() and t.lower() != "dot":
                plain = False
            if "@" in shapes[i]:
                ats += 1
                host = shape.split("@", 1)[1]
            elif not at and (not plain or n > MOST_DIGITS):
                return
            if j - i < 2 and len(t) < 7 or not (t[0].isalnum() or t in "(+"):
                continue
            if not (t[0].isalnum() and "." in host if ats else plain and 4 <= n <= MOST_DIGITS):
                continue
            own = shape.lstrip("_")
            yield i, (
                own, n, self.cue[i], self.left[i], self.right[j - 1], tuple(map(len, numbers)),
                luhn("".join(numbers)) if 13 <= n <= 19 and "a" not in own else None,
                all(len(x) <= 3 and int(x) <= 255 for x in numbers) if len(numbers) == 4 else None,
            )


def features(traits: tuple) -> list[str]:
    shape, n, cue, left, right, lengths, sum_fits, octets = traits
    out = [
        "bias", "shape " + (re.sub(r"(\d|[a-zA-Z])\1+", r"\1", shape) if len(shape) <= 40 else "long"),
        f"digits {n if n < 20 else 20}", "marks " + "".join(sorted({x for x in shape if not x.isalnum()})), f"cue {cue}", f"left {left}", f"right {right}",
        f"ends {shape[0]} {shape[-1]}", f"ats {min(2, shape.count('@'))} dots {min(3, shape.count('.'))}", f"groups {min(7, len(lengths))}",
    ]
    if sum_fits is not None:
        out.append(f"luhn {sum_fits}")
    if octets is not None:
        out.append(f"octets {octets}")
    if lengths:
        out.append("lengths " + "-".join(str(min(9, x)) for x in lengths[:6]))
    return out


def _tokens(text: str, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Tokens of a stretch; very long ones in pieces, which are no parts of entities."""
    for m in _TOKEN.finditer(text, begin, end):
        for s in range(m.start(), m.end(), LONGEST_TOKEN):
            e = min(m.end(), s + LONGEST_TOKEN)
            yield text[s:e], s, e


def _scores(weights: dict[str, np.ndarray], features: list[str]) -> np.ndarray:
    out = np.zeros(len(_LABELS))
    for f in features:
        w = weights.get(f)
        if w is not None:
            out += w
    return out


class Scorer:
    """Scores of segments by their traits; those of MEMORY traits are kept."""

    MEMORY = 100_000

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.step: list[list[float]] = weights["transitions"].tolist()
        self._known: dict[tuple, tuple[float, ...]] = {}

    def __call__(self, traits: tuple) -> tuple[float, ...]:
        s = self._known.get(traits)
        if s is None:
            if len(self._known) >= self.MEMORY:
                self._known.clear()
            s = self._known[traits] = tuple(_scores(self.weights, features(traits)).tolist()[1:])
        return s


def decode(text: str, begin: int, end: int, score: Scorer) -> list[Span]:
    """The best segmentation of text[begin:end]: segments of one token without a kind, or feasible spans with one.

    A segment has at most LONGEST tokens, so only so many places are held at one
    time; of earlier ones the length and the previous label of the best segment
    that ends there stay, and where the tokens stand: 26 bytes a token.
    """
    kinds, step = range(1, len(_LABELS)), score.step
    low = float("-inf")
    best = [0.0, *[low] * len(KINDS)]
    tokens = _Tokens(text)
    starts, stops, lengths, labels = array("q"), array("q"), array("b"), array("b")

    def entered(best: list[float]) -> list[tuple[float, int]]:
        """For each label the best score of a path to here that goes on with it, and the path's last label."""
        return [max(((b + row[k], -y) for y, (b, row) in enumerate(zip(best, step, strict=True))), key=lambda x: x) for k in range(len(_LABELS))]

    reach = [entered(best)]
    for t, s, e in _tokens(text, begin, end):
        if len(tokens.token) >= 64 * LONGEST:
            gone = len(tokens.token) - LONGEST - 4
            tokens.forget(gone)
            del reach[:gone]
        tokens.push(t, s, e)
        j = len(tokens.token)
        value, label = reach[j - 1][0]
        now, size, came = [value, *[low] * len(KINDS)], [1] * len(_LABELS), [-label, *[0] * len(KINDS)]
        for i, traits in tokens.segments(j):
            here, own = reach[i], score(traits)
            for k in kinds:
                value = here[k][0] + own[k - 1]
                if value >= now[k] and value > low:  # ties: the longer segment
                    now[k], size[k], came[k] = value, j - i, -here[k][1]
        reach.append(entered(now))
        starts.append(s)
        stops.append(e)
        lengths.extend(size)
        labels.extend(came)
        best = now
    out, j, n = [], len(starts), len(_LABELS)
    y = best.index(max(best))
    while j > 0:
        at = (j - 1) * n + y
        i = j - lengths[at]
        if y:
            out.append((_LABELS[y], starts[i], stops[j - 1]))
        j, y = i, labels[at]
    return out[::-1]


def _learn_one(tokens: _Tokens, gold: set[tuple[int, int, int]], weights: dict[str, np.ndarray], squares: dict[str, np.ndarray], rate: float) -> None:
    """One AdaGrad step on the likelihood of a sentence, by forward and backward sums over segments."""
    n, labels = len(tokens.token), len(_LABELS)
    step = weights["transitions"]
    parts = sorted(((i, j, features(x)) for j in range(1, n + 1) for i, x in tokens.segments(j)), key=lambda x: x[:2])
    scored = [(i, j, f, _scores(weights, f)) for i, j, f in parts]
    by_end: dict[int, list] = {}
    by_begin: dict[int, list] = {}
    for x in scored:
        by_end.setdefault(x[1], []).append(x)
        by_begin.setdefault(x[0], []).append(x)
    fore, aft = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
    fore[0, 0], aft[n] = 0.0, 0.0
    add = lambda m, axis: np.logaddexp.reduce(m, axis=axis)
    for j in range(1, n + 1):
        fore[j, 0] = add(fore[j - 1] + step[:, 0], 0)
        for i, _, _, s in by_end.get(j, ()):
            fore[j, 1:] = np.logaddexp(fore[j, 1:], add(fore[i][:, None] + step[:, 1:], 0) + s[1:])
    for i in range(n - 1, -1, -1):
        aft[i] = step[:, 0] + aft[i + 1, 0]
        for _, j, _, s in by_begin.get(i, ()):
            aft[i] = np.logaddexp(aft[i], add(step[:, 1:] + (s[1:] + aft[j, 1:])[None, :], 1))
    z = add(fore[n], 0)
    grad: dict[str, np.ndarray] = {"transitions": np.zeros((labels, labels))}
    for j in range(1, n + 1):
        grad["transitions"][:, 0] -= np.exp(fore[j - 1] + step[:, 0] + aft[j, 0] - z)
    for i, j, f, s in scored:
        p = np.exp(fore[i][:, None] + step[:, 1:] + (s[1:] + aft[j, 1:])[None, :] - z)
        grad["transitions"][:, 1:] -= p
        g = np.r_[0.0, -p.sum(axis=0)]
        for y in range(1, labels):
            g[y] += (i, j, y) in gold
        for x in f:
            grad[x] = grad[x] + g if x in grad else g
    y, covered = 0, {i: (j, k) for i, j, k in gold}
    i = 0
    while i < n:
        j, k = covered.get(i, (i + 1, 0))
        grad["transitions"][y, k] += 1
        i, y = j, k
    for x, g in grad.items():
        if x not in weights:
            weights[x], squares[x] = np.zeros(labels), np.zeros(labels)
        squares[x] = squares[x] + g * g
        weights[x] = weights[x] + rate * (g / (np.sqrt(squares[x]) + 1e-6)) - 1e-3 * rate * weights[x]


def _card(rng: random.Random) -> str:
    d = rng.choice(["4", "51", "37", "6011"]) + "".join(rng.choice("0123456789") for _ in range(11))
    d = d[:15]
    return next(d + c for c in "0123456789" if luhn(d + c))


def _sentences(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences with their spans: written forms of each kind, and look-alikes."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    octets = lambda sep: sep.join(str(rng.randint(0, 255)) for _ in range(4))
    group = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    end = lambda: rng.choice(["com", "org", "net", "io", "de", "fr"])

    def email() -> str:
        user, host = rng.choice([word(), f"{word()} dot {word()}", word() + num(2)]), word() + rng.choice(["", num(1)])
        at = rng.choice([" at ", " [at] ", " (at) ", "[at]", "(at)", " @ "])
        dot = rng.choice([" dot ", " [dot] ", " (dot) ", "[dot]", "(dot)", "."]) if at != " at " else " dot "
        return (user if "at " in at or "dot" not in user else word()) + at + host + dot + end()

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        if rng.random() < 0.3:  # plain forms that the patterns miss beside other digits
            return f"+{rng.choice(['1', '44', '49', '33'])} ({a}) {b}-{c}"
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"1 ({a}) {b}-{c}", f"00{num(2)} {num(3)} {num(7)}", f"0{num(3)} {num(6)}", f"0{num(2)} {num(rng.choice([7, 8]))}", f"0{num(4)} {num(5)}"])

    def card() -> str:
        return group(_card(rng), rng.choice([".", "  ", " - ", "/", " ", "-"])) if rng.random() < 0.6 else _card(rng)

    def address() -> str:
        return octets(rng.choice(["[.]", "(.)", " . ", "[dot]", " dot ", ".", "."]))

    def failing() -> str:
        return next(x for x in iter(lambda: num(16), None) if not luhn(x))

    def other() -> str:
        return rng.choice([
            f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(1)},{num(3)},{num(3)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(10)}", f"{num(12)}", failing(), failing(), f'token = "{hexes(40)}"', f"{num(3)} {num(3)}",
            f"the dot {word()}", f"{word()} at {word()} {word()}", f"{num(4)} {num(4)}", f"{num(2)}:{num(2)}:{num(2)}", f"order {num(9)}", f"isbn {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(5)}-{num(4)}", f"({num(4)}) {num(4)}", f"polka dot {word()}", f"{num(4)} - {num(4)}", f"page {num(3)}.{num(3)}.{num(4)}.{num(3)}.{num(3)}", f"{num(6)}.{num(6)}", f"{octets('.')}.{num(2)}", group(failing(), " "), f"{num(22)}",
        ])

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        beside = rng.random() < 0.35  # entities next to one another
        for _ in range(rng.choice([2, 3]) if beside else rng.choice([1, 1, 2])):
            kind, make = rng.choice([("email", email), ("phone", phone), ("card", card), ("ip", address), (None, other), (None, other), (None, other)])
            if kind and rng.random() < 0.4:
                text += " " + rng.choice([c for c, k in _CUES.items() if k == kind]) + rng.choice([" ", ": "])
            elif text and not text.endswith(" "):
                text += " "
            begin = len(text)
            text += make()
            if kind:
                spans.append((kind, begin, len(text)))
            text += " " if beside else rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(0, 4)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 700, epochs: int = 4) -> dict[str, np.ndarray]:
    """Weights of the model; the same at every call."""
    weights: dict[str, np.ndarray] = {"transitions": np.zeros((len(_LABELS), len(_LABELS)))}
    squares = {"transitions": np.zeros_like(weights["transitions"])}
    data = []
    for text, spans in _sentences(n):
        t = _Tokens(text)
        for x in _tokens(text, 0, len(text)):
            t.push(*x)
        begins, ends = {s: i for i, s in enumerate(t.start)}, {e: i + 1 for i, e in enumerate(t.stop)}
        data.append((t, {(begins[s], ends[e], _LABELS.index(k)) for k, s, e in spans}))
    for epoch in range(epochs):
        for t, gold in data:
            _learn_one(t, gold, weights, squares, 0.5 / (1 + epoch))
    return weights


@lru_cache(maxsize=1)
def _scorer(held: Broadcast) -> Scorer:
    """The scorer of a worker."""
    return Scorer(held.value)


def added_spans(text: str, base: list[Span], score: Scorer) -> list[Span]:
    """What the model finds where no base span is."""
    triggers = [m.span() for m in _DIGITS.finditer(text) if sum(map(str.isdigit, m[0])) >= 7 or len(_GROUP.findall(m[0])) >= 4]
    triggers += [m.span() for m in _SPELLED.finditer(text)]
    if not triggers:
        return []
    taken = sorted((s, e) for _, s, e in base)
    begins, furthest = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    regions: list[list[int]] = []
    for s, e in sorted(triggers):
        if furthest[bisect_right(begins, s)] >= e or regions and e + CONTEXT <= regions[-1][1]:
            continue
        s, e = max(0, s - CONTEXT), min(len(text), e + CONTEXT)
        least = regions[-1][1] if regions else 0
        while s > least and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if regions and s <= least:
            regions[-1][1] = max(e, least)
        else:
            regions.append([s, e])
    out = []
    for s, e in regions:
        out += [x for x in decode(text, s, e, score) if furthest[bisect_left(begins, x[2])] <= x[1]]
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, the counts and digest of base spans, and all spans."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(weights or trained())  # a model of fixed size

    def search(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in common.texts(part):
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added_spans(text, base, _scorer(held)))))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.record_batch([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return common.keyed_texts(docs).mapInArrow(common.per_slice(search), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; other columns stay."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(weights or trained())

    def mask(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in part.column("text").to_pylist():
            if text:
                base = base_spans(text)
                done, pieces = 0, []
                for k, s, e in sorted(base + added_spans(text, base, _scorer(held)), key=lambda x: (x[1], -x[2])):
                    if e > done:  # overlapping spans go together
                        if s >= done:
                            pieces += [text[done:s], f"<{k}>"]
                        done = e
                text = "".join([*pieces, text[done:]])
            out.append(text)
        return pa.record_batch([pa.array(out, pa.string()) if c == "text" else part.column(c) for c in part.schema.names], part.schema.names)

    return docs.mapInArrow(common.per_slice(mask), docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return find(common.table(spark, sf_dir, "documents"))
