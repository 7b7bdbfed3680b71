"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are lower-cased words and word beginnings of 5, 6 and 7 bytes, as hashes. From a
bounded sample of labelled documents (``SAMPLE``, chosen by a seeded hash of the id) those
that toxic documents hold significantly more often are selected (``MOST_FEATURES``
at most); their value is 1 + log(count).
A word counts as itself if it is selected, else as its longest selected beginning.

Severity has the grades 0 to 3. Labels only say toxic or not, so the grade of a toxic document
is taken from its amount of evidence: the sum of its features, cut at the
terciles of the toxic documents; a clean label is grade 0. The model is the proportional-odds
one, P(grade <= k) = logistic(theta_k - w.x): one weight vector shared by the ordered thresholds
theta_0 < theta_1 < theta_2, fitted by Adam on the penalised likelihood. The score is the expected
severity, the sum over k of P(grade > k).

A document is rejected from a cutoff of expected severity on. The cutoff is set on the part of
the sample that the fit hasn't seen: the best F1 among cutoffs that reject at most ``FALSE_SHARE`` of
its clean documents.

Scoring runs over all documents and whole texts; the model is a few thousand numbers.

Defined results: null or empty text has no features and the severity of the thresholds alone;
labels with a null id or value are ignored, repeated ones count once (the highest); repeated rows
are scored alike; without labels of both kinds nothing is rejected; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import words as W
from casegrain.llm.tables import arrow

SAMPLE = 20_000
MOST_FEATURES = 4_096
LEAST_Z = 3.0
LEAST_DOCS = 4
BEGINNINGS = (7, 6, 5)
HELD_OUT = 0.3
FALSE_SHARE = 0.005
SEED = 17
GRADES = 4
_BITS = 20


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))   # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 20.0))
    cutoff: float = float(GRADES)

    def severity(self, linear: np.ndarray) -> np.ndarray:
        return sum(_logistic(linear - t) for t in self.thresholds)

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        below = np.stack([_logistic(t - linear) for t in self.thresholds] + [np.ones(len(linear))], axis=1)
        return np.diff(np.concatenate((np.zeros((len(linear), 1)), below), axis=1), axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The row of each word, and (words, hashes) of each kind of feature: whole words, then longer beginnings first."""
    starts, ends, first = W.spans(data, offs, W.ALNUM)
    kinds = [(np.arange(len(starts)), W.hashes(data, starts, ends))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > k)
        kinds.append((longer, W.hashes(data, starts[longer], ends[longer], first=k) ^ np.uint64(k)))
    return np.repeat(np.arange(len(offs) - 1), np.diff(first)), kinds


def _known_counts(data: np.ndarray, offs: np.ndarray, features: np.ndarray,
                  filter_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature index, count); a word counts for the first kind of feature that is known."""
    if not len(features):
        return (np.zeros(0, np.int64),) * 3
    row, kinds = word_features(data, offs)
    chosen = np.full(len(row), -1, np.int64)
    for word, h in kinds:
        maybe = np.flatnonzero(filter_bits[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)] & (chosen[word] < 0))
        at = np.minimum(np.searchsorted(features, h[maybe]), len(features) - 1)
        ok = features[at] == h[maybe]
        chosen[word[maybe[ok]]] = at[ok]
    has = chosen >= 0
    pair, n = np.unique(row[has] * len(features) + chosen[has], return_counts=True)
    return pair // len(features), pair % len(features), n


def _filter(features: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[(features & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return bits


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, toxic, held, text) of at most ``size`` labelled ids."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg((F.max("toxic") > 0).alias("toxic")))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = known.withColumn("held", F.pmod(order, F.lit(1000)) < int(HELD_OUT * 1000)).orderBy(order, "doc_id").limit(size)
    # At most ``size`` narrow rows: a bounded broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """Documents of each kind that hold a feature: feature, toxic, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = W.column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool)
            data, offs = W.column_bytes(W.column(batch, "text"))
            for lo, hi in W.slices(offs):
                word_row, kinds = word_features(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                h = np.concatenate([x for _, x in kinds])
                row = np.concatenate([word_row[word] for word, _ in kinds])
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[:len(h)]
                for kind in (False, True):
                    f, n = np.unique(h[once & (toxic[lo:hi][row] == kind)], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.view(np.int64)), pa.array(np.full(len(f), kind)), pa.array(n.astype(np.int64))],
                        names=["feature", "toxic", "n"])
    return arrow(sample.select("doc_id", "toxic", "text"), run, "feature long, toxic boolean, n long")


def _select(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the features that toxic documents hold significantly more often."""
    kinds = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = kinds.get(True, 0), kinds.get(False, 0)
    if not t or not c:
        return np.zeros(0, np.uint64)
    both = _feature_counts(sample).groupBy("feature").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("b"))
    # Smoothed log odds ratio over its standard error.
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    z = (F.log(a / (F.lit(t + 1.0) - a)) - F.log(b / (F.lit(c + 1.0) - b))) / F.sqrt(1 / a + 1 / b)
    rows = (both.where(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
            .orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).select("feature").collect())
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _vectors(sample: DataFrame, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sample on the driver: row, feature and count arrays, toxic and held flags."""
    bits = _filter(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.column_bytes(W.column(batch, "text"))
            for lo, hi in W.slices(offs):
                row, f, n = _known_counts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], features, bits)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [W.column(part, "doc_id"), W.column(part, "toxic"), W.column(part, "held"), lists(f), lists(n)],
                    names=["doc_id", "toxic", "held", "f", "n"])
    rows = arrow(sample.select("doc_id", "toxic", "held", "text"), run,
                 "doc_id long, toxic boolean, held boolean, f array<int>, n array<int>")
    got = rows.orderBy("doc_id", "f", "n").collect()
    sizes = [len(r["f"]) for r in got]
    flat = lambda name: np.array([x for r in got for x in r[name]], np.int64)
    flag = lambda name: np.array([r[name] for r in got], bool)
    return np.repeat(np.arange(len(got)), sizes), flat("f"), flat("n"), flag("toxic"), flag("held")


def fit_ordinal(row: np.ndarray, f: np.ndarray, x: np.ndarray, grade: np.ndarray, n_features: int,
                l2: float = 0.5, steps: int = 1500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of the proportional-odds model (Adam, full batch)."""
    k = GRADES - 1
    share = np.clip([(grade <= j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    # theta_0, then logarithms of the steps: the thresholds stay in order.
    p = np.concatenate((np.zeros(n_features), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(grade)
    for step in range(1, steps + 1):
        w = p[:n_features]
        steps_up = np.exp(p[n_features + 1:])
        theta = p[n_features] + np.concatenate(([0], np.cumsum(steps_up)))
        lin = np.bincount(row, x * w[f], minlength=n)
        upper = np.concatenate((theta, [np.inf]))[grade] - lin
        lower = np.concatenate(([-np.inf], theta))[grade] - lin
        su, sl = _logistic(upper), _logistic(lower)
        prob = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / prob, sl * (1 - sl) / prob     # d log prob / d upper, -d / d lower
        g_lin = du - dl                                          # minus d log prob / d lin
        g_theta = np.array([-(du[grade == j].sum()) + dl[grade == j + 1].sum() for j in range(k)])
        g = np.concatenate((np.bincount(f, x * g_lin[row], minlength=n_features) + l2 * w,
                            [g_theta.sum()], [g_theta[j:].sum() * steps_up[j - 1] for j in range(1, k)])) / n
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate(([0], np.cumsum(np.exp(p[n_features + 1:]))))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    sample = _sample(docs, labels, size)
    features = _select(sample.where("NOT held"))
    if not len(features):
        return Model()
    row, f, n, toxic, held = _vectors(sample, features)
    x = 1 + np.log(n)
    evidence = np.bincount(row, x, minlength=len(toxic))
    shown = evidence[toxic & ~held]
    if not len(shown):
        return Model()
    cuts = np.quantile(shown, [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (evidence[:, None] > cuts).sum(axis=1), 0)
    train = ~held
    place = np.cumsum(train) - 1
    keep = train[row]
    weights, thresholds = fit_ordinal(place[row[keep]], f[keep], x[keep], grade[train], len(features))
    model = Model(features, weights, thresholds)
    severity = model.severity(np.bincount(row, x * weights[f], minlength=len(toxic)))
    part = held if (held & toxic).any() and (held & ~toxic).any() else train
    model.cutoff = _cutoff(severity[part], toxic[part])
    return model


def _cutoff(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The cutoff of best F1 with at most ``FALSE_SHARE`` of the clean rejected, midway to the next lower score."""
    order = np.argsort(-severity, kind="stable")
    s, t = severity[order], toxic[order]
    hit, false = np.cumsum(t), np.cumsum(~t)
    ends = np.append(s[1:] < s[:-1], False)    # a cutoff falls between two different scores
    ok = ends & (false <= FALSE_SHARE * (~t).sum())
    if not ok.any():
        return float(GRADES)
    f1 = np.where(ok, 2 * hit / (hit + false + t.sum()), -1)
    best = int(np.argmax(f1))
    return float((s[best] + s[best + 1]) / 2)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` plus expected_severity, grade (most likely) and rejected, for every row of ``docs`` (text)."""
    sent = docs.sparkSession.sparkContext.broadcast((model, _filter(model.features)))
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()),
        T.StructField("rejected", T.BooleanType())])

    # The text goes over once, whether it is kept or not.
    columns = keep if "text" in keep else [*keep, "text"]
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bits = sent.value
        for batch in batches:
            data, offs = W.column_bytes(batch.column(text_at))
            for lo, hi in W.slices(offs):
                row, f, n = _known_counts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], m.features, bits)
                lin = np.bincount(row, (1 + np.log(n)) * m.weights[f], minlength=hi - lo)
                severity = m.severity(lin)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(severity), pa.array(m.probabilities(lin).argmax(axis=1).astype(np.int32)),
                       pa.array(severity >= m.cutoff)],
                    names=[*keep, "expected_severity", "grade", "rejected"])
    return arrow(docs.select(*columns), run, schema)


def judge(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, expected_severity, grade and rejected of every document, by a model fitted on ``labels``."""
    return score(docs, fit(docs, labels, size), ["doc_id"])
