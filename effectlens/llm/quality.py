"""Operator 7: quality rules as a learned decision list.

Counts of every whole text are made once; a list of rules over them is learned
by sequential covering: a rule grows a conjunction of thresholds by information
gain on two thirds of what is left and is pruned on the last third; it competes
with the widest precise single thresholds, the best of them joins the list, and
the rows it covers leave.  The list is an ordered ``when`` chain over columns.

The rules are fitted on at most FIT_ROWS labelled documents, chosen by hash of
their id; everything else covers all documents.

Cases: null text counts as empty (no words, base_failed); rows without a usable
label are not fitted on; without labels or without a rule precise enough the
list is empty and keeps what passes the base rules; repeated ids each have a
row; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm import common

#: Labelled documents that a list is fitted on at most.
FIT_ROWS = 20_000
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper_words", "n_exclaims")
#: Statistics that rules may use: a count in hundredths of words or lines.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "upper_share": ("n_upper_words", "n_words"), "exclaim_share": ("n_exclaims", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "words_per_line": ("n_words", "n_lines"),
}


def _repeat_words(words: list[str]) -> int:
    """Words covered by runs of WINDOW words that the text has twice or more."""
    h = common.window_hashes(common.word_hashes(words), WINDOW)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _counts(text: str) -> tuple[int, ...]:
    words = common.words_of(text)
    lines = [x for x in text.split("\n") if x and common.words_of(x)] if "\n" in text else ([text] if words else [])
    return (
        len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), _repeat_words(words),
        len(lines), len(set(words)), sum(map(str.isupper, words)), text.count("!"),
    )


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and COUNTS (long) of every text."""
    common.ship(docs.sparkSession)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*map(_counts, common.texts(part)), strict=True)) or [()] * len(COUNTS)
        return pa.record_batch([*(part.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in rows)], [*keep, *COUNTS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} bigint" for c in COUNTS)])
    return docs.select(*keep, "text").mapInArrow(common.per_slice(count), schema)


@dataclass(frozen=True)
class Rule:
    """Every (statistic, is an upper bound, threshold) must hold for a document to be refused."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, upper, t in self.tests:
            out &= (x[name] <= t) if upper else (x[name] > t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, upper, t in self.tests:
            a, b = RATIOS[name]
            ratio = F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
            out = out & ((ratio <= t) if upper else (ratio > t))
        return out


def _information(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 3) -> Rule:
    tests: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (0.0, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            up, un = np.cumsum(y)[cuts], np.cumsum(~y)[cuts]
            for upper, p, n in ((True, up, un), (False, p0 - up, n0 - un)):
                gain = p * (_information(p, n) - _information(p0, n0))
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (name, upper, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(tests))


def _single(x: dict[str, np.ndarray], bad: np.ndarray, precision: float) -> list[Rule]:
    """For each statistic and side the widest precise threshold."""
    out = []
    for name, v in x.items():
        for upper in (True, False):
            order = np.argsort(v if upper else -v, kind="stable")
            p, n = np.cumsum(bad[order]), np.cumsum(~bad[order])
            s = v[order]
            cuts = np.flatnonzero(s[1:] != s[:-1])
            fine = cuts[p[cuts] >= precision * (p[cuts] + n[cuts])]
            if len(fine):
                i = fine[np.argmax(p[fine])]
                out.append(Rule(((name, upper, float((s[i] + s[i + 1]) / 2)),)))
    return out


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = rule.covers(x)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, support: int = 3, most: int = 16) -> list[Rule]:
    """Ordered rules that refuse; ``bad`` marks the rows to refuse."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and bad[left].sum() >= support:
        at = np.flatnonzero(left)
        prune = np.arange(len(at)) % 3 == 2
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        grown, held = _grow(*part(at[~prune])), part(at[prune])
        while len(grown.tests) > 1 and _worth(Rule(grown.tests[:-1]), *held) >= _worth(grown, *held):
            grown = Rule(grown.tests[:-1])
        best, rule = support - 1, None
        for candidate in [grown, *_single(*part(at[~prune]), precision)]:
            inside = candidate.covers(x) & left
            p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
            if candidate.tests and p > best and p >= precision * (p + n):
                best, rule = p, candidate
        if rule is None:
            break
        inside = rule.covers(x) & left
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from at most ``rows`` labelled documents."""
    some = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``rows`` pairs of numbers
    stats = statistics(drawn, ("doc_id", "quality")).drop("doc_id")
    # ids that repeat bring more texts than labels: ``rows`` of them are enough
    got = stats.orderBy(F.xxhash64(*stats.columns), *stats.columns).limit(rows).toPandas()
    if got.empty:
        return []
    got = got.sort_values(list(got.columns)).sample(frac=1.0, random_state=0)
    x = {k: np.divide(got[a].to_numpy(float), got[b].to_numpy(float), out=np.zeros(len(got)), where=got[b].to_numpy() > 0) for k, (a, b) in RATIOS.items()}
    return learn(x, got["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false where a rule refuses."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, the rules fitted on the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    return judge(statistics(docs), rules).select("doc_id", *COUNTS[:5], "base_failed", "kept")
