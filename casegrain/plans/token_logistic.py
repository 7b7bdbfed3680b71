"""Logistic regression of tokens on packed rows: the optimiser of Spark ML's ``LogisticRegression``, with one path for all candidates.

A token has five hashed features (buckets of ``HashingTF``), so a text is packed as five 16-bit buckets a token instead of a vector a token;
a feature that falls into the bucket of an earlier one of its token is left out, since ``HashingTF`` is binary there. Each evaluation is one
Spark job over the packed rows in Arrow batches, and Spark sums the parts by bucket; the driver holds the weights and nothing of the data.

The objective is Spark's: weighted log-loss over the sum of weights, an L2 penalty on the coefficients of features scaled to unit deviation and centred, and a
free intercept. ``lbfgs`` takes Breeze's steps (memory 10, strong Wolfe line search, its tests of convergence), so the state after k iterations
is the model that a fit with ``maxIter`` = k ends with. Candidates that differ in ``maxIter`` only are therefore states of one path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.batches import WordRows, over_batches, token_bounds, token_texts
from casegrain.functions.text import WINDOW_TOKENS

# ---- fixed values -----------------------------------------------------------
KINDS = 5                       # features of a token: itself, its neighbours, its length, its place in the window
AT_ONCE = 1 << 13               # tokens that are scored together
MEMORY, LINE_STEPS = 10, 10     # Breeze's LBFGS as Spark ML sets it up
ENOUGH, CURVED = 1e-4, 0.9      # its line search
VALUES_KEPT = 20                # values that its test of convergence looks back on
# -----------------------------------------------------------------------------


def hashing_tf_buckets(names: list[str], n_features: int) -> np.ndarray:
    """The indices that ``HashingTF`` gives terms: 32-bit murmur3 of their UTF-8 bytes, seed 42, as a signed number, mod ``n_features``."""
    data = [x.encode("utf-8", "replace") for x in names]
    size = np.array([len(x) for x in data], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    held = -(-size // 4)
    blocks = np.frombuffer(b"".join([data[i].ljust(k * 4, b"\0") for i, k in zip(order.tolist(), held.tolist())]), "<u4")
    first, whole = np.cumsum(held) - held, size // 4

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
    h = np.full(len(data), 42, np.uint32)
    more = len(data)
    for i in range(int(whole.max(initial=0))):
        more = int(np.searchsorted(-whole[:more], -i, "left"))         # the names with more whole blocks than i stand first
        x = h[:more] ^ mixed(blocks[first[:more] + i])
        h[:more] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = np.flatnonzero(size % 4)
    h[rest] ^= mixed(blocks[first[rest] + whole[rest]])
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    out = np.empty(len(data), np.int32)
    out[order] = h.view(np.int32).astype(np.int64) % n_features
    return out


class TokenBuckets(WordRows):
    """Word → the buckets of the word, of it as a left and as a right neighbour, and of its length.

    ``hashed`` gives buckets of names; ``once`` leaves out a bucket that came before in its token.
    """

    def __init__(self, n_features: int, hashed: Callable[[list[str], int], np.ndarray] = hashing_tf_buckets, once: bool = True):
        self.n, self.once = n_features, once
        self.tenths = hashed([f"d={i}" for i in range(10)], n_features)
        self.edges = hashed(["p=<s>", "n=</s>"], n_features)
        lengths = hashed([f"l={i}" for i in range(13)], n_features)
        super().__init__(lambda words: np.stack([*(hashed([kind + w for w in words], n_features) for kind in ("t=", "p=", "n=")),
                                                 lengths[np.array([min(len(w), 12) for w in words], np.int64)]], axis=1))

    def of(self, texts: list[np.ndarray]) -> np.ndarray:
        """Buckets (tokens × ``KINDS``: itself, left and right neighbour, length, tenth of the window) of all tokens of texts given as ``rows``; ``n`` if left out."""
        size = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(size)
        some = size > 0
        own = self.whole()[np.concatenate(texts)] if texts else np.empty((0, 4), np.int32)
        out = np.empty((len(own), KINDS), np.int32)
        out[:, 0], out[:, 3] = own[:, 0], own[:, 3]
        out[1:, 1], out[:-1, 2] = own[:-1, 1], own[1:, 2]
        out[(ends - size)[some], 1], out[ends[some] - 1, 2] = self.edges
        out[:, 4] = self.tenths[(np.arange(len(own)) - np.repeat(ends - size, size)) % WINDOW_TOKENS * 10 // WINDOW_TOKENS]
        if not self.once:
            return out
        again = [(k, np.logical_or.reduce([out[:, j] == out[:, k] for j in range(k)])) for k in range(1, KINDS)]
        for k, seen in again:
            out[seen, k] = self.n
        return out


PACKED = "part string, features binary, label binary, w array<double>"


def packed_rows(docs: DataFrame, weights: tuple[float, float], n_features: int, text: str = "text", labels: str = "labels", part: str = "part") -> DataFrame:
    """``PACKED`` rows, one for each text with tokens: five 16-bit buckets and a label (a byte) for each token of the whole text, and the weights of labels 0 and 1."""
    if n_features >= 1 << 16:
        raise ValueError("packed buckets have 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = TokenBuckets(n_features)
        for batch in batches:
            found, parts, ys = [], [], []
            marks = batch.column("_y")
            held.bounded()
            for i, (p, t) in enumerate(zip(batch.column("_p").to_pylist(), batch.column("_t").to_pylist())):
                words = token_texts(t or "", *token_bounds(t or ""))
                if not words:
                    continue
                y = marks[i].values.to_numpy(zero_copy_only=False)[:len(words)]
                if len(y) < len(words):
                    raise ValueError("a text has more tokens than labels")
                found.append(held.rows(words))
                parts.append(p)
                ys.append((y == 1).astype(np.uint8))
            ends = np.cumsum([0, *map(len, found)])
            packed = pa.py_buffer(held.of(found).astype("<u2").tobytes())
            bits = pa.py_buffer(np.concatenate(ys).tobytes() if ys else b"")
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.string()),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 2 * KINDS).astype(np.int32).tobytes()), packed]),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), bits]),
                 pa.array([list(weights)] * n, pa.list_(pa.float64()))],
                names=["part", "features", "label", "w"])
    return over_batches(docs.select(F.col(part).alias("_p"), F.col(text).alias("_t"), F.col(labels).alias("_y")), run, PACKED)


def bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, one after the other, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if len(column) and data is not None else np.zeros(0, np.uint8)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Buckets by kind, labels and weights of tokens, ``AT_ONCE`` at a time, which stay in the processor's cache."""
    for batch in batches:
        x, y = bytes_of(batch.column("features")).view("<u2").reshape(-1, KINDS), bytes_of(batch.column("label"))
        w = batch.column("w").flatten().to_numpy()[:2]      # the same in all rows
        for lo in range(0, len(y), AT_ONCE):
            own = y[lo:lo + AT_ONCE]
            yield list(np.ascontiguousarray(x[lo:lo + AT_ONCE].T).astype(np.intp)), own, w[own]


def margins(idx: list[np.ndarray], coefficients: np.ndarray, offset: float) -> np.ndarray:
    """Scores of tokens; ``coefficients`` has a last one, zero, for buckets that are left out."""
    z = coefficients[idx[0]]
    for k in idx[1:]:
        z += coefficients[k]
    z += offset
    return z


def _summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], dict[int, float]]) -> dict[int, float]:
    """Each task's numbers by key, summed by Spark: at most a row per bucket and a few more reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = part(batches)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], names=["key", "value"])
    got = over_batches(rows.select("features", "label", "w"), run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value"))
    return {r["key"]: r["value"] for r in got.collect()}


class Objective:
    """Spark's weighted, centred and scaled logistic loss over packed rows, and its gradient."""

    def __init__(self, rows: DataFrame, n_features: int, penalty: float):
        self.rows, self.n, self.penalty, self.last = rows, n_features, penalty, None
        n = n_features

        def count(batches):
            mass, other = np.zeros(n + 1), np.zeros(3)
            for idx, y, w in _unpacked(batches):
                for k in idx:
                    mass += np.bincount(k, w, n + 1)
                other += w.sum(), (w ** 2).sum(), w[y == 1].sum()
            some = np.flatnonzero(mass[:n])
            return [*some.tolist(), -1, -2, -3], [*mass[some].tolist(), *other.tolist()]
        got = _summed(rows, count)
        self.mass, square, ones = (got.pop(-k, 0.0) for k in (1, 2, 3))
        if not self.mass:
            raise ValueError("no token to train on")
        self.odds = ones, self.mass - ones
        active = np.zeros(n)
        active[list(got)] = list(got.values())
        free = self.mass - square / self.mass
        spread = np.sqrt(np.maximum(active * (self.mass - active) / self.mass / free, 0.0)) if free > 0 else np.zeros(n)
        self.inverse = np.divide(1.0, spread, out=np.zeros(n), where=spread > 0)
        self.centre = self.inverse * active / self.mass

    def start(self) -> np.ndarray:
        """No coefficients, and the log of the odds."""
        return np.append(np.zeros(self.n), math.log(self.odds[0] / self.odds[1]))

    def model(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients of the features as they are, and the intercept."""
        return x[:-1] * self.inverse, float(x[-1] - x[:-1] @ self.centre)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        if self.last is not None and np.array_equal(self.last[0], x):
            return self.last[1:]
        n, (coefficients, offset) = self.n, self.model(x)
        sent = self.rows.sparkSession.sparkContext.broadcast((np.append(coefficients, 0.0), offset))

        def part(batches):
            total, loss, miss = np.zeros(n + 1), 0.0, 0.0
            for idx, y, w in _unpacked(batches):
                z = margins(idx, *sent.value)
                small = np.exp(-np.abs(z))
                loss += float(w @ (np.log1p(small) + np.where(y == 1, np.maximum(-z, 0.0), np.maximum(z, 0.0))))
                m = w * (np.where(z >= 0, 1.0, small) / (1.0 + small) - y)
                for k in idx:
                    total += np.bincount(k, m, n + 1)
                miss += float(m.sum())
            some = np.flatnonzero(total[:n])
            return [*some.tolist(), -1, -2], [*total[some].tolist(), loss, miss]
        got = _summed(self.rows, part)
        sent.unpersist()
        loss, miss = got.pop(-1, 0.0), got.pop(-2, 0.0)
        gradient = np.zeros(n + 1)
        gradient[list(got)] = list(got.values())
        gradient[:n] = (gradient[:n] * self.inverse - self.centre * miss) / self.mass + self.penalty * x[:n]
        gradient[n] = miss / self.mass
        self.last = x.copy(), loss / self.mass + 0.5 * self.penalty * float(x[:n] @ x[:n]), gradient
        return self.last[1:]


class SearchFailed(Exception):
    """No step can be found in a direction."""


def _between(low: tuple, high: tuple) -> float:
    """Minimum of the cubic through two (place, value, slope), kept off both ends."""
    (a, fa, da), (b, fb, db) = low, high
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = math.sqrt(x) if (x := d1 * d1 - da * db) >= 0 else math.nan
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2) if db - da + 2 * d2 else math.nan
    least, most = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return least if t < least else most if t > most else t


def _line_search(f: Callable[[float], tuple[float, float]], t: float) -> float:
    """A step that meets the strong Wolfe conditions; ``f`` gives value and slope."""
    low = first = (0.0, *f(0.0))
    _, value, slope = first
    if slope > 0:
        raise SearchFailed("not a direction of descent")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(LINE_STEPS):
            t = _between(high, low) if low[0] > high[0] else _between(low, high)
            c = (t, *f(t))
            if c[1] > value + ENOUGH * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= CURVED * abs(slope):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")
    for i in range(LINE_STEPS):
        c = (t, *f(t))
        if not math.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + ENOUGH * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= CURVED * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise SearchFailed("line search")


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The negative gradient times the approximate inverse Hessian; ``history`` has steps and changes of the gradient, newest first."""
    out, scale = gradient.copy(), 1.0
    if history:
        step, change = history[0]
        sy = step @ change
        if not sy >= 0:
            raise SearchFailed("history")
        scale = sy / (change @ change)
    kept = []
    for step, change in history:
        rho = step @ change
        a = (step @ out) / rho
        if math.isnan(a):
            raise SearchFailed("history")
        out -= a * change
        kept.append((rho, a))
    out *= scale
    for (step, change), (rho, a) in zip(reversed(history), reversed(kept)):
        out += (a - (change @ out) / rho) * step
    return -out


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tolerance: float = 1e-6) -> list[np.ndarray]:
    """The points after 0, 1, 2, … iterations, at most ``most``; fewer if it converges or no step is found twice in a row."""
    value, gradient = f(x)
    path, values, scale, history, failed = [x], [math.inf], abs(value), [], False
    while len(path) <= most:
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * scale:
            break
        if np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        try:
            with np.errstate(all="ignore"):
                ahead = _direction(gradient, history)

                def along(t: float) -> tuple[float, float]:
                    v, g = f(x + t * ahead)
                    return v, float(g @ ahead)
                step = _line_search(along, 1.0 / float(np.linalg.norm(ahead)) if len(path) == 1 else 1.0)
                if step * np.linalg.norm(gradient) < 1e-10:
                    raise SearchFailed("step too small")
        except SearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        new = x + step * ahead
        value, after = f(new)
        history = [(new - x, after - gradient), *history][:MEMORY]
        x, gradient, failed = new, after, False
        values = [*values, value][-VALUES_KEPT:]
        path.append(x)
    return path


def fit_path(rows: DataFrame, iterations: tuple[int, ...], n_features: int, penalty: float, tolerance: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of a fit with each number of iterations."""
    objective = Objective(rows, n_features, penalty)
    if min(objective.odds) <= 0:            # one label only: Spark's answer is that label always
        only = np.zeros(n_features), math.inf if objective.odds[0] > 0 else -math.inf
        return [only for _ in iterations]
    path = lbfgs(objective, objective.start(), max(iterations), tolerance)
    return [objective.model(path[min(k, len(path) - 1)]) for k in iterations]


def as_model(layer: LogisticRegression, coefficients: np.ndarray, intercept: float) -> LogisticRegressionModel:
    """The Spark ML model that ``layer`` would have been fitted to."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(layer.uid, _py2java(sc, Vectors.dense(coefficients)), float(intercept))
    return layer._copyValues(LogisticRegressionModel(java))


def confusion(rows: DataFrame, models: list[tuple[np.ndarray, float]], part: str) -> DataFrame:
    """(epoch from 1, pred, label, rows): how many tokens of a part each model and the label put where; one pass for all models."""
    sent = rows.sparkSession.sparkContext.broadcast([(np.append(c, 0.0), b) for c, b in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(sent.value), 4), np.int64)
        for idx, y, _ in _unpacked(batches):
            for e, model in enumerate(sent.value):
                seen[e] += np.bincount(2 * (margins(idx, *model) > 0) + y, minlength=4)
        e, cell = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(e + 1, pa.int64()), pa.array(cell // 2, pa.int32()), pa.array(cell % 2, pa.int32()), pa.array(seen[e, cell])],
                                         names=["epoch", "pred", "label", "rows"])
    return over_batches(rows.filter(F.col("part") == part).select("features", "label", "w"), run, "epoch long, pred int, label int, rows long")


def with_marks(df: DataFrame, tokens: str, model: tuple[np.ndarray, float], out: str) -> DataFrame:
    """``df`` plus ``out``: 0 or 1 for each of the row's (lower-cased) tokens, as the model (coefficients, intercept) has it; null tokens have none."""
    sent = df.sparkSession.sparkContext.broadcast((np.append(model[0], 0.0), model[1]))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, intercept = sent.value
        held = TokenBuckets(len(coefficients) - 1)
        for batch in batches:
            own = batch.column(tokens)
            size = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
            ends = np.cumsum([0, *size.tolist()])
            all_rows = held.bounded().rows(own.flatten().to_pylist())
            idx = held.of([all_rows[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
            marks = margins(list(idx.T), coefficients, intercept) > 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(marks.astype(np.int32)))],
                                             names=schema.names)
    return over_batches(df, run, schema)
