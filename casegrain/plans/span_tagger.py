"""Rationales as spans: a linear-chain model over the tokens of a window, decoded by Viterbi.

A window of 510 tokens is a sequence of hidden labels (rationale or not). A token's hashed features (itself, its
neighbours, its length, its place in the window) give its own score for being part of a rationale, and each pair of neighbouring
labels has a score, so marks come in runs instead of token by token. Training maximises the likelihood of the
masks: the gradient is the observed less the expected features, from the forward and backward passes of all windows
of an Arrow batch at once, summed by Spark; epochs go on from each other (``epochs.State``). Decoding takes the best
label sequence of each window in the row; spans are its runs of ones, with their place in the text.

Results: a text without tokens has one window without labels and no spans; windows are decoded on their own, so a span over a
window's border is two; rows that repeat an id are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.batches import over_batches, token_bounds, token_texts
from casegrain.functions.text import WINDOW_TOKENS
from casegrain.operators import annotations as A
from casegrain.operators import metrics as M
from casegrain.operators.sampling import train_val_split
from casegrain.plans.epochs import State
from casegrain.plans.token_logistic import KINDS, TokenBuckets, bytes_of, margins
from casegrain.session import materialize

FEATURES = 1 << 14
PAIRS = 4               # label pairs, row by row: 00, 01, 10, 11
EPOCHS, STEPS = 4, 6
RATE, DECAY = 0.1, 1e-5
HELD_WINDOWS = 1 << 10  # windows decoded at once, and the last text's
BOUNDED = 300.0         # scores whose exponentials stay in range, with room for products
WINDOWS = "doc_id long, window_no long, idx binary, labels binary"      # 16-bit buckets (tokens × KINDS), a byte a label
SPANS = "doc_id long, start long, end long, first_token long, n_tokens long"


def _buckets(names: list[str], n_features: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) % n_features for x in names), np.int32, len(names))


def word_buckets() -> TokenBuckets:
    """The buckets of a task's words."""
    return TokenBuckets(FEATURES, _buckets, once=False)


def token_features(words: list[str], held: dict) -> np.ndarray:
    """Buckets (tokens × ``KINDS``) of a text's tokens; neighbours cross window borders. ``held`` may be the task's ``word_buckets``."""
    held = held if isinstance(held, TokenBuckets) else word_buckets()
    return held.of([held.rows(words)])


def window_features(docs: DataFrame, text: str = "text", id_col: str = "doc_id", chosen: str | None = None, keep=()) -> DataFrame:
    """``WINDOWS`` rows of every text, and the string columns ``keep``; labels from the occurrences of the sentences in ``chosen``, if given."""
    keep = list(keep)
    cols = [*keep, F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_t"),
            (F.col(chosen) if chosen else F.lit(None).cast("array<string>")).alias("_s")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = word_buckets()
        for batch in batches:
            held.bounded()
            words, marks = [], []
            for t, s in zip(batch.column("_t").to_pylist(), batch.column("_s").to_pylist()):
                starts, ends, mark = A.marked_tokens(t, s)
                words.append(held.rows(token_texts(t or "", starts, ends)))
                marks.append(mark)
            row, no, inside = A.window_rows([len(m) for m in marks])
            edges = np.concatenate(([0], np.cumsum(inside)))
            labels = np.concatenate(marks).astype(np.uint8) if marks else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(no), _binary(edges * 2 * KINDS, held.of(words).astype("<u2")),
                 _binary(edges, labels), *[batch.column(c).take(pa.array(row)) for c in keep]],
                names=["doc_id", "window_no", "idx", "labels", *keep])
    return over_batches(docs.select(cols), run, ", ".join([WINDOWS, *[f"{c} string" for c in keep]]))


def _binary(edges: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of ``values``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, buckets (entries × ``KINDS``), labels, and the (window, place) of every entry."""
    size = pc.binary_length(batch.column("labels")).to_numpy().astype(np.int64)
    idx = bytes_of(batch.column("idx")).view("<u2").reshape(-1, KINDS)
    labels = bytes_of(batch.column("labels"))
    row = np.repeat(np.arange(len(size)), size)
    return size, idx, labels, np.stack([row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)])


def _emissions(size, idx, at, weights) -> np.ndarray:
    """Score of label 1 at every place of every window (windows × longest); 0 after the end. In memory the windows lie side by side, place after place."""
    out = np.zeros((max(1, int(size.max(initial=0))), len(size)))
    out[at[1], at[0]] = margins([idx[:, k] for k in range(KINDS)], weights, weights[FEATURES])
    return out.T


def _ranked(size: np.ndarray, length: int) -> tuple[np.ndarray, list[int]]:
    """Windows by length, longest first, and how many are longer than each place: the ones to work on there."""
    order = np.argsort(-size, kind="stable")
    return order, (len(size) - np.searchsorted(np.sort(size), np.arange(length + 1), "right")).tolist()


def marginals(emit: np.ndarray, size: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: probability of label 1 at each place, expected counts of the label pairs, log of the normaliser.

    Forward and backward weights are kept as shares of their sums, so a place costs a few products instead of logarithms.
    """
    if max(np.abs(emit).max(initial=0.0), np.abs(pair).max()) > BOUNDED:
        return marginals_in_logs(emit, size, pair)
    n, length = emit.shape
    order, many = _ranked(size, length)
    x = np.ascontiguousarray(emit.T[:, order])
    small = np.exp(-np.abs(x))
    p1 = np.where(x >= 0, 1.0, small) / (1.0 + small)
    p0 = np.where(x >= 0, small, 1.0) / (1.0 + small)
    top = pair.max()
    (w00, w01), (w10, w11) = np.exp(pair - top)
    a0, a1, total = np.zeros((length, n)), np.zeros((length, n)), np.ones((length, n))
    a0[0], a1[0] = p0[0], p1[0]
    for i in range(1, length):
        m = many[i]
        b0, b1 = a0[i - 1, :m], a1[i - 1, :m]
        c0, c1 = (b0 * w00 + b1 * w10) * p0[i, :m], (b0 * w01 + b1 * w11) * p1[i, :m]
        s = total[i, :m] = c0 + c1
        a0[i, :m], a1[i, :m] = c0 / s, c1 / s
    one, pairs = np.zeros((length, n)), np.zeros((2, 2, n))
    b0, b1 = np.ones(n), np.ones(n)
    for i in range(length - 1, -1, -1):
        m, here = many[i + 1], many[i]
        if m:
            s = total[i + 1, :m]
            u0, u1 = p0[i + 1, :m] * b0[:m] / s, p1[i + 1, :m] * b1[:m] / s
            v00, v01, v10, v11 = w00 * u0, w01 * u1, w10 * u0, w11 * u1
            f0, f1 = a0[i, :m], a1[i, :m]
            pairs[0, 0, :m] += f0 * v00
            pairs[0, 1, :m] += f0 * v01
            pairs[1, 0, :m] += f1 * v10
            pairs[1, 1, :m] += f1 * v11
            b0[:m], b1[:m] = v00 + v01, v10 + v11
        one[i, :here] = a1[i, :here] * b1[:here]
    inside = np.arange(length)[:, None] < np.maximum(size[order], 1)
    z = (np.log(total) + np.where(inside, np.maximum(x, 0.0) + np.log1p(small), 0.0)).sum(axis=0) + np.maximum(size[order] - 1, 0) * top
    back = np.argsort(order, kind="stable")
    return one[:, back].T, pairs[:, :, back].transpose(2, 0, 1), z[back]


def marginals_in_logs(emit: np.ndarray, size: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``marginals`` by logarithms throughout, for scores of any size."""
    n, length = emit.shape
    fore = np.zeros((n, length, 2))
    fore[:, 0, 1] = emit[:, 0]
    for i in range(1, length):
        step = fore[:, i - 1, :, None] + pair
        fore[:, i] = np.logaddexp(step[:, 0], step[:, 1])
        fore[:, i, 1] += emit[:, i]
    last = np.maximum(size - 1, 0)
    z = np.logaddexp(*fore[np.arange(n), last].T)
    back = np.zeros((n, length, 2))
    pairs = np.zeros((n, 2, 2))
    for i in range(length - 2, -1, -1):
        more = (i + 1 < size)[:, None]
        after = back[:, i + 1].copy()
        after[:, 1] += emit[:, i + 1]
        step = pair + after[:, None, :]
        back[:, i] = np.where(more, np.logaddexp(step[:, :, 0], step[:, :, 1]), 0.0)
        both = np.exp(np.minimum(fore[:, i, :, None] + step - z[:, None, None], 0.0))
        pairs += np.where(more[:, :, None], both, 0.0)
    one = np.exp(np.minimum(fore[:, :, 1] + back[:, :, 1] - z[:, None], 0.0))
    return one, pairs, z


def viterbi(emit: np.ndarray, size: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The best label sequence of each window; ties take label 0."""
    n, length = emit.shape
    order, many = _ranked(size, length)
    x = np.ascontiguousarray(emit.T[:, order])
    best0, best1 = np.zeros(n), x[0].copy()
    came0, came1 = np.zeros((length, n), bool), np.zeros((length, n), bool)
    for i in range(1, length):
        m = many[i]
        for0, for1 = best0[:m] + pair[0, 0], best0[:m] + pair[0, 1]
        one0, one1 = best1[:m] + pair[1, 0], best1[:m] + pair[1, 1]
        came0[i, :m], came1[i, :m] = one0 > for0, one1 > for1
        best0[:m], best1[:m] = np.maximum(for0, one0), np.maximum(for1, one1) + x[i, :m]
    # The best scores of a window stay as they were at its last place.
    out, now = np.zeros((length, n), np.int8), best1 > best0
    for i in range(length - 1, -1, -1):
        m = many[i]
        out[i, :m] = now[:m]
        now[:m] = np.where(now[:m], came1[i, :m], came0[i, :m])
    return out[:, np.argsort(order, kind="stable")].T


def gradient_parts(rows: DataFrame, weights: np.ndarray, chain: bool) -> DataFrame:
    """(key, value): the summed gradient by weight, and under key -1 the loss, -2 the tokens."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, loss, tokens = sent.value, np.zeros(len(sent.value)), 0.0, 0
        pair = w[FEATURES + 1:].reshape(2, 2)
        for batch in batches:
            size, idx, y, at = _matrix(batch)
            if not len(y):
                continue
            emit = _emissions(size, idx, at, w)
            one, pairs, z = marginals(emit, size, pair)
            miss = one[at[0], at[1]] - y
            for k in range(KINDS):
                total[:FEATURES] += np.bincount(idx[:, k], miss, FEATURES)
            total[FEATURES] += miss.sum()
            inner = at[1][1:] > 0                                  # an entry that follows one of its window
            seen = np.bincount(2 * y[:-1][inner] + y[1:][inner], minlength=PAIRS).astype(float)
            if chain:
                total[FEATURES + 1:] += pairs.sum(axis=0).ravel() - seen
            loss += z[size > 0].sum() - (emit[at[0], at[1]] * y).sum() - (pair.ravel() * seen).sum()
            tokens += len(y)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2]), pa.array([*total[some].tolist(), float(loss), float(tokens)])],
                                         names=["key", "value"])
    return over_batches(rows.select("idx", "labels"), run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value"))


def train(rows: DataFrame, epochs: int = EPOCHS, steps: int = STEPS, chain: bool = True, seed: int = 42) -> list[tuple[State, float]]:
    """The state after every epoch and its mean loss a token; ``chain`` false leaves the pairs at zero (independent tokens)."""
    z = np.zeros(FEATURES + 1 + PAIRS)
    state, out = State(z, z, z, 0), []
    for epoch in range(1, epochs + 1):
        share = F.pmod(F.xxhash64(F.lit(f"{seed}:{epoch}"), "doc_id", "window_no"), F.lit(steps))
        loss = tokens = 0.0
        for s in range(steps):
            # At most a row per weight reaches the driver.
            got = {r["key"]: r["value"] for r in gradient_parts(rows.where(share == s), state.weights, chain).collect()}
            n = got.pop(-2, 0.0)
            loss, tokens = loss + got.pop(-1, 0.0), tokens + n
            if n:
                gradient = np.zeros(len(z))
                gradient[list(got)] = list(got.values())
                state = state.stepped(gradient / n + DECAY * state.weights, RATE)
        out.append((state, loss / max(tokens, 1.0)))
    return out


def decode(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` (``WINDOWS``) with ``pred``, the best label sequence of each window."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            size, idx, y, at = _matrix(batch)
            best = viterbi(_emissions(size, idx, at, w), size, w[FEATURES + 1:].reshape(2, 2)) if batch.num_rows else np.zeros((0, 1))
            edges = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            pred, labels = (pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32))) for v in (best[at[0], at[1]], y))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("window_no"), labels, pred],
                                             names=["doc_id", "window_no", "labels", "pred"])
    return over_batches(rows.select("doc_id", "window_no", "idx", "labels"), run,
                        "doc_id long, window_no long, labels array<int>, pred array<int>")


def scored(decoded: DataFrame, run: str, epoch: int) -> DataFrame:
    """Token metrics of decoded windows: one pass of conditional sums."""
    pair = decoded.select(F.explode(F.arrays_zip("pred", "labels")).alias("x"))
    return M.binary_metrics(pair.select(F.lit(run).alias("run"), F.lit(epoch).cast("bigint").alias("epoch"),
                                        F.col("x.pred").alias("pred"), F.col("x.labels").alias("label")))


def confusion(rows: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(epoch from 1, pred, label, rows): how many tokens each epoch's weights and the label put where; one pass, and nothing per token leaves a batch."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(sent.value), 4), np.int64)
        for batch in batches:
            size, idx, y, at = _matrix(batch)
            if not len(y):
                continue
            for e, w in enumerate(sent.value):
                best = viterbi(_emissions(size, idx, at, w), size, w[FEATURES + 1:].reshape(2, 2))
                seen[e] += np.bincount(2 * best[at[0], at[1]] + y, minlength=4)
        e, cell = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(e + 1, pa.int64()), pa.array(cell // 2, pa.int32()), pa.array(cell % 2, pa.int32()), pa.array(seen[e, cell])],
                                         names=["epoch", "pred", "label", "rows"])
    return over_batches(rows.select("idx", "labels"), run, "epoch long, pred int, label int, rows long")


def train_spans(experts: DataFrame, epochs: int = EPOCHS, chain: bool = True) -> tuple[DataFrame, np.ndarray]:
    """Per-epoch loss and validation metrics (documents split by seed), and the weights of the best epoch."""
    df = A.with_matched_sentences(A.with_rationale_sentences(experts)).select("doc_id", "text", "matched_sentences")
    parts = materialize(train_val_split(experts.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()).select("doc_id", "part"),
                        "span-parts")
    # The part joins the text, not the features, which are several times as large.
    df = df.withColumn("doc_id", F.col("doc_id").cast("long")).join(parts, "doc_id")
    both = materialize(window_features(df, chosen="matched_sentences", keep=("part",)), "span-rows")
    states = train(both.where("part = 'train'"), epochs, chain=chain)
    seen = confusion(both.where("part = 'validation'"), [state.weights for state, _ in states])
    losses = F.array(*[F.lit(float(loss)) for _, loss in states])
    met = M.binary_metrics(seen.withColumn("run", F.lit("chain" if chain else "independent")), count="rows")
    met = materialize(met.withColumn("train_loss", F.round(F.element_at(losses, F.col("epoch").cast("int")), 6)), "span-metrics")
    best = int(M.best_epoch(met).first()["best_epoch"]) if met.count() else epochs
    return met.withColumn("selected", F.col("epoch") == best), states[best - 1][0].weights


def rationale_spans(docs: DataFrame, weights: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``SPANS`` rows: the runs of marked tokens of every text, as [start, end) of its characters."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def marked(keys: list, bounds: list, feats: list, held: TokenBuckets) -> pa.RecordBatch:
        """Spans of some texts (``feats``: the rows of their words), none without tokens: all their windows are decoded at once."""
        w = sent.value
        n = [len(f) for f in feats]
        _, _, size = A.window_rows(n)
        if not keys:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=["doc_id", "start", "end", "first_token", "n_tokens"])
        place = np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
        at = np.stack([np.repeat(np.arange(len(size)), size), place % WINDOW_TOKENS])
        label = viterbi(_emissions(size, held.of(feats), at, w), size, w[FEATURES + 1:].reshape(2, 2))[at[0], at[1]]
        opens = at[1] == 0                              # so the entry before it ends its window
        first = np.flatnonzero((label == 1) & ((np.concatenate(([0], label[:-1])) == 0) | opens))
        last = np.flatnonzero((label == 1) & ((np.concatenate((label[1:], [0])) == 0) | np.concatenate((opens[1:], [True]))))
        starts, ends = (np.concatenate([b[i] for b in bounds]).astype(np.int64) for i in (0, 1))
        owner = np.repeat(np.arange(len(n)), n)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()).take(pa.array(owner[first])), pa.array(starts[first]), pa.array(ends[last]),
             pa.array(place[first]), pa.array(last - first + 1)], names=["doc_id", "start", "end", "first_token", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = word_buckets()
        keys, bounds, feats, windows = [], [], [], 0
        for batch in batches:
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("_t").to_pylist()):
                found = token_bounds(t or "")
                if not len(found[0]):
                    continue
                keys.append(key)
                bounds.append(found)
                feats.append(held.rows(token_texts(t, *found)))
                windows += -(-len(found[0]) // WINDOW_TOKENS)
                if windows >= HELD_WINDOWS:
                    yield marked(keys, bounds, feats, held)
                    keys, bounds, feats, windows = [], [], [], 0
                    held.bounded()
        yield marked(keys, bounds, feats, held)
    return over_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_t")), run, SPANS)
