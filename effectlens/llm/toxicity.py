"""Operator 8: toxicity as cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector, shared by ordered
thresholds, over sparse text features (words, and the first five letters of
longer words, both lower-cased and stripped of punctuation; the value is the
count over the root of the text's length, which chance alone keeps small in
texts of any length).  The expected severity is the sum of these probabilities.

Labels say only toxic or not, so grades are 0 for what isn't, and 1 or 2 for
what is: 2 in the upper half of the share of words typical of toxic documents.
The model is fitted on at most FIT_ROWS different labelled texts of either kind,
chosen by hash, and on their FEATURES most telling features: a bounded sample of
labelled rows and a model of bounded size.  Every document is scored over its
whole text.

Cases: null text counts as empty and has the severity of no features; rows
without a usable label are not fitted on; without labels of both kinds nothing
is rejected (severity 0); repeated ids each have a row, and each different text
of a labelled id takes part in the fit; extra columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm import common

#: Labelled documents of either kind, and features, that the model is fitted on at most.
FIT_ROWS, FEATURES = 10_000, 4096
#: Documents, and share of the toxic ones, that a feature must be found in, and times as often among toxic ones.
SUPPORT, SHARE, LIFT = 3, 0.015, 8.0
STEM, REJECT = 5, 0.5
_EDGE = ".,;:!?\"'`()[]{}<>*#$%&|-_/\\+=~^"


def _features(text: str) -> Counter:
    """Counts of words, and of ``stem*`` for longer words."""
    out = Counter([w.strip(_EDGE) for w in common.words_of(text.lower())])
    out.pop("", None)
    stems: Counter = Counter()
    for w, n in out.items():
        if len(w) > STEM:
            stems[w[:STEM] + "*"] += n
    out.update(stems)
    return out


def _scale(n_words: int | np.ndarray) -> float | np.ndarray:
    return 10.0 / np.sqrt(n_words + 50.0)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, text: str) -> float:
        if not self.thresholds:
            return 0.0
        words, stems = self.weights, {}
        z: dict[str, int] = {}
        n = 0
        for w in common.words_of(text.lower()):
            n += 1
            w = w.strip(_EDGE)
            if w in words:
                z[w] = z.get(w, 0) + 1
            if len(w) > STEM:
                s = w[:STEM]
                stems[s] = stems.get(s, 0) + 1
        for s, times in stems.items():
            if s + "*" in words:
                z[s + "*"] = times
        score = sum(words[k] * z[k] for k in sorted(z)) * _scale(n)
        return float(sum(1 / (1 + np.exp(-np.clip(score - t, -60, 60))) for t in self.thresholds))


def likelihood(w: np.ndarray, gaps: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with its penalty; its slopes by ``w`` and by ``gaps`` (theta_0 and log gaps)."""
    n, top = len(grade), len(gaps)
    theta = gaps[0] + np.r_[0.0, np.cumsum(np.exp(gaps[1:]))]
    z = np.bincount(rows, w[cols] * values, n)
    s = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -60, 60)))  # P(grade > k)
    above = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
    slope = above * (1 - above)
    lo, hi = slope[at, grade], slope[at, grade + 1]
    dz = -(lo - hi) / p / n
    gw = np.bincount(cols, dz[rows] * values, len(w)) + l2 * w
    gt = np.array([np.sum(np.where(grade == k + 1, lo, 0) / p - np.where(grade == k, hi, 0) / p) / n for k in range(top)])
    gg = np.r_[gt.sum(), [gt[k:].sum() * np.exp(gaps[k]) for k in range(1, top)]]
    return float(-np.log(p).mean() + l2 / 2 * (w @ w)), gw, gg


def _fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, top: int = 2, steps: int = 600, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the largest penalised likelihood, by Adam."""
    w, gaps = np.zeros(n_features), np.array([2.0] + [1.0] * (top - 1))
    state = [(np.zeros(n_features), np.zeros(n_features)), (np.zeros(top), np.zeros(top))]
    for step in range(1, steps + 1):
        _, gw, gg = likelihood(w, gaps, rows, cols, values, grade, l2)
        for x, g, (m, v), rate in ((w, gw, state[0], 0.1), (gaps, gg, state[1], 0.05)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(w, 0.0, out=w)  # features are picked as typical of toxic texts
    return w, gaps[0] + np.r_[0.0, np.cumsum(np.exp(gaps[1:]))]


def drawn_rows(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """row (a key), toxic, text: at most ``rows`` different labelled texts of either kind, by hash; and how many."""
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    draw = lambda kind: clean.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = draw(1).unionByName(draw(0))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 2 x ``rows`` pairs of numbers
    # a copied text would make its rare words look typical
    found = found.select("toxic", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text", "toxic"]).select(F.xxhash64("text", "toxic").alias("row"), "toxic", "text")
    totals = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    for kind, n in totals.items():  # ids that repeat bring more texts than labels
        if n > rows:
            last = found.filter(F.col("toxic") == kind).select("row").orderBy("row").limit(rows).agg(F.max("row")).first()[0]
            found = found.filter((F.col("toxic") != kind) | (F.col("row") <= last))
            totals[kind] = rows
    return found, totals


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most ``rows`` labelled documents of either kind."""
    spark = docs.sparkSession
    common.ship(spark)
    drawn, totals = drawn_rows(docs, labels, rows)
    if not totals.get(0) or not totals.get(1):
        return Model({}, ())

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        toxic, name, n, size = [], [], [], []
        for y, t in zip(part.column("toxic").to_pylist(), common.texts(part), strict=True):
            f = _features(t)
            toxic += [y] * len(f)
            name += list(f)
            n += list(f.values())
            size += [len(common.words_of(t))] * len(f)
        return pa.record_batch([pa.array(toxic, pa.int32()), pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["toxic", "feature", "n", "size"])

    rows_of = drawn.select("toxic", "text").mapInArrow(common.per_slice(found), "toxic int, feature string, n bigint, size bigint")
    x = F.col("n") * 10.0 / F.sqrt(F.col("size") + 50.0)
    df = rows_of.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(x * F.col("toxic")).alias("in_bad"), F.sum(x * (1 - F.col("toxic"))).alias("in_good"))
    lift = ((F.col("in_bad") + 0.1) / totals[1]) / ((F.col("in_good") + 0.1) / totals[0])
    picked = df.filter(F.col("bad") >= max(SUPPORT, SHARE * totals[1])).withColumn("lift", lift).filter(F.col("lift") >= LIFT)
    names = [r["feature"] for r in picked.orderBy(F.desc(F.round(F.col("in_bad") * F.log("lift"), 6)), "feature").limit(features).collect()]
    if not names:
        return Model({}, ())
    index = spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})  # at most ``features``

    def hits(part: pa.RecordBatch) -> pa.RecordBatch:
        cols, n, size = [], [], []
        for t in common.texts(part):
            mine = [(index.value[w], k) for w, k in _features(t).items() if w in index.value]
            cols.append(np.array([i for i, _ in mine], np.int32).tobytes())
            n.append(np.array([k for _, k in mine], np.int32).tobytes())
            size.append(len(common.words_of(t)))
        return pa.record_batch([part.column("row"), part.column("toxic"), pa.array(cols, pa.binary()), pa.array(n, pa.binary()), pa.array(size, pa.int64())], ["row", "toxic", "cols", "n", "size"])

    # 2 x ``rows`` rows at most, of at most ``features`` pairs of numbers
    got = drawn.mapInArrow(common.per_slice(hits), "row bigint, toxic int, cols binary, n binary, size bigint").toPandas().sort_values(["toxic", "row"])
    cols = [np.frombuffer(c, np.int32) for c in got["cols"]]
    r = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    c, n = np.concatenate(cols).astype(np.int64), np.frombuffer(b"".join(got["n"]), np.int32).astype(float)
    size, bad = got["size"].to_numpy(float), got["toxic"].to_numpy() == 1
    share = np.bincount(r, n / np.maximum(size[r], 1), len(got))
    # toxic documents without any picked feature get grade 1
    grade = np.zeros(len(got), np.int64)
    typical = bad & (share > 0)
    grade[bad] = 1
    if typical.any():
        grade[typical] += share[typical] > np.median(share[typical])
    w, theta = _fit(r, c, n * _scale(size[r]), grade, len(names))
    return Model({x: float(w[i]) for i, x in enumerate(names) if abs(w[i]) > 1e-6}, tuple(map(float, theta)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, severity, and rejected (severity of REJECT or more)."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(model)  # at most FEATURES weights
    read = list(dict.fromkeys([*keep, "text"]))

    def rate(part: pa.RecordBatch) -> pa.RecordBatch:
        s = [held.value.severity(t) for t in common.texts(part)]
        return pa.record_batch([*(part.column(c) for c in keep), pa.array(s, pa.float64()), pa.array([x >= REJECT for x in s], pa.bool_())], [*keep, "severity", "rejected"])

    kinds = dict(docs.dtypes)
    return docs.select(*read).mapInArrow(common.per_slice(rate), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", severity double, rejected boolean")


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't reject."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(model)  # at most FEATURES weights

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array([held.value.severity(t) < REJECT for t in common.texts(part)], pa.bool_()))

    return docs.mapInArrow(common.per_slice(keep), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and verdict of every document, the model fitted on the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "rejected")
