"""Training in true epochs: a distributed mini-batch optimiser that each epoch continues.

Rows are sparse hashed token counts. An epoch shuffles them by seed into mini-batches and accumulation
steps (``sampling.minibatch_assign``); a step is one Spark job: every partition sums its gradient over Arrow batches,
Spark sums the parts by feature, and the driver, which holds ``n_features`` weights and nothing of the data, takes an Adam
step. Weights and moments live on from epoch to epoch, and from a saved model to the next. The loss of every
mini-batch, at the weights it was trained on, comes from the same job.

The number of steps in an epoch is bounded (``MAX_STEPS``): the batch grows with the data, so an epoch is always that many
passes over its share of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions.batches import over_batches, token_bounds, token_texts
from casegrain.operators import losses as L
from casegrain.operators import metrics as M
from casegrain.operators.sampling import ACCUMULATION_STEPS, BATCH_SIZE, minibatch_assign
from casegrain.session import materialize

MAX_STEPS = 8
EPOCHS = 3
RATE, DECAY = 0.05, 1e-4
BETA = (0.9, 0.999)
TEACHER_FEATURES, STUDENT_FEATURES, GROUPS = 1 << 14, 1 << 10, 16
SPARSE = "doc_id long, idx array<int>, val array<double>, y double, w double"
_FIELDS = ["doc_id", "idx", "val", "y", "w"]


class State(NamedTuple):
    """Weights (the last one is the bias), Adam's moments and the number of steps taken."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int

    @classmethod
    def zero(cls, n_features: int) -> State:
        z = np.zeros(n_features + 1)
        return cls(z, z, z, 0)

    def stepped(self, gradient: np.ndarray, rate: float = RATE) -> State:
        first = BETA[0] * self.first + (1 - BETA[0]) * gradient
        second = BETA[1] * self.second + (1 - BETA[1]) * gradient ** 2
        n = self.steps + 1
        move = (first / (1 - BETA[0] ** n)) / (np.sqrt(second / (1 - BETA[1] ** n)) + 1e-8)
        return State(self.weights - rate * move, first, second, n)


def save_state(spark: SparkSession, state: State, path: str) -> None:
    spark.createDataFrame([(state.steps, state.weights.tolist(), state.first.tolist(), state.second.tolist())],
                          "steps long, weights array<double>, first array<double>, second array<double>").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> State:
    r = spark.read.parquet(path).first()
    return State(np.array(r["weights"]), np.array(r["first"]), np.array(r["second"]), int(r["steps"]))


def hashed_tokens(text: str | None, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's tokens and the share of the tokens in each (square root, unit length)."""
    t = text or ""
    count = Counter(token_texts(t, *token_bounds(t)))
    if not count:
        return np.zeros(0, np.int64), np.zeros(0)
    bucket = np.array([xxhash.xxh64_intdigest(x) % n_features for x in count])
    idx, place = np.unique(bucket, return_inverse=True)
    val = np.sqrt(np.bincount(place, list(count.values())))
    return idx, val / np.linalg.norm(val)


def sparse_rows(df: DataFrame, n_features: int, text: str = "text", target: str = "label", weight: str | None = None,
                id_col: str = "doc_id") -> DataFrame:
    """``SPARSE`` rows of texts; ``target`` is in [0, 1], and rows without one are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed_tokens(t, n_features) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column("y"), batch.column("w")], names=_FIELDS)
    rows = df.where(F.col(target).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_t"), F.col(target).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return over_batches(rows, run, SPARSE)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every entry of the sparse rows."""
    sizes = np.array([len(x) for x in batch.column("idx")], np.int64)
    return (np.repeat(np.arange(len(sizes)), sizes), batch.column("idx").flatten().to_numpy().astype(np.int64),
            batch.column("val").flatten().to_numpy())


def scores(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    row, idx, val = _flat(batch)
    return np.bincount(row, weights[idx] * val, batch.num_rows) + weights[-1]


def gradient_parts(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(kind, key, value, n): per feature the sum of gradients ('g'; the bias is the last, with the sum of row weights in
    ``n``), per mini-batch the sum of losses and rows ('l'), each partition's share summed by Spark."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, mass, loss = sent.value, np.zeros(len(sent.value)), 0.0, {}
        for batch in batches:
            y, own = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            z = scores(batch, w)
            miss = own * (1 / (1 + np.exp(-z)) - y)
            row, idx, val = _flat(batch)
            total[:-1] += np.bincount(idx, miss[row] * val, len(w) - 1)
            total[-1] += miss.sum()
            mass += own.sum()
            each = own * (np.logaddexp(0, z) - y * z)
            for b, x in zip(batch.column("batch").to_pylist(), each.tolist()):
                s, n = loss.get(b, (0.0, 0))
                loss[b] = s + x, n + 1
        some = np.flatnonzero(total)
        out = [("g", int(i), float(total[i]), 0.0) for i in some if i < len(w) - 1] + [("g", len(w) - 1, float(total[-1]), float(mass))]
        out += [("l", int(b), s, float(n)) for b, (s, n) in loss.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["kind", "key", "value", "n"])
    parts = over_batches(rows.select(*_FIELDS, "batch"), run, "kind string, key long, value double, n double")
    return parts.groupBy("kind", "key").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def train_epoch(rows: DataFrame, state: State, epoch: int, seed=42, max_steps: int = MAX_STEPS,
                batch_size: int | None = None) -> tuple[State, list[tuple[int, float, int]]]:
    """One epoch over ``SPARSE`` rows from ``state``: the new state, and (batch, mean loss, rows) of each mini-batch."""
    n = rows.count()
    size = batch_size or max(BATCH_SIZE, -(-n // (ACCUMULATION_STEPS * max_steps)))
    order = minibatch_assign(rows.select("doc_id"), "doc_id", size, seed=f"{seed}:{epoch}").select("doc_id", "batch", "step")
    dealt = materialize(rows.join(order.dropDuplicates(["doc_id"]), "doc_id").repartitionByRange("step", F.xxhash64("doc_id")), "epoch")
    losses = []
    for step in range(-(-max(n, 0) // (size * ACCUMULATION_STEPS))):
        # At most a row per feature and per mini-batch of the step reaches the driver.
        got = gradient_parts(dealt.where(F.col("step") == step), state.weights).collect()
        gradient, mass = np.zeros(len(state.weights)), 0.0
        for r in got:
            if r["kind"] == "g":
                gradient[r["key"]], mass = r["value"], mass + r["n"]
            else:
                losses.append((r["key"], r["value"] / r["n"], int(r["n"])))
        decay = np.append(DECAY * state.weights[:-1], 0.0)
        state = state.stepped(gradient / max(mass, 1e-12) + decay)
    return state, sorted(losses)


def with_scores(rows: DataFrame, weights: np.ndarray, groups: int = GROUPS) -> DataFrame:
    """``rows`` (doc_id, idx, val, …) as (doc_id, z, hidden): the score, and its parts by group of buckets."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, val = _flat(batch)
            w = sent.value
            hidden = np.bincount(row * groups + idx % groups, w[idx] * val, batch.num_rows * groups).reshape(-1, groups)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch, w)), pa.array(list(hidden), pa.list_(pa.float64()))],
                                             names=["doc_id", "z", "hidden"])
    return over_batches(rows.select(*_FIELDS), run, "doc_id long, z double, hidden array<double>")


def distill(corpus: DataFrame, epochs: int = EPOCHS, seed: int = 42, max_steps: int = MAX_STEPS) -> dict:
    """A wide teacher on the labels, then a narrow student on teacher and labels, both in true epochs.

    The student's target is the mixture that the loss weights give (half the softened teacher, 0.4 the label). Returns the
    states of every epoch, ``losses`` (epoch, batch, … of the student's real outputs on train, with the running mean of the
    combined loss) and ``metrics`` (run, epoch, … on dev, with the selected epoch).
    """
    spark = corpus.sparkSession
    parts = materialize(corpus.where(F.col("split").isin("train", "dev")).select("split", "doc_id", "text", "label"), "epoch-corpus")
    wide = materialize(sparse_rows(parts.where("split = 'train'"), TEACHER_FEATURES), "epoch-rows")
    narrow = materialize(sparse_rows(parts.where("split = 'train'"), STUDENT_FEATURES), "epoch-rows")
    dev = {n: sparse_rows(parts.where("split = 'dev'"), n) for n in (TEACHER_FEATURES, STUDENT_FEATURES)}
    states: dict = {"teacher": [State.zero(TEACHER_FEATURES)], "student": [State.zero(STUDENT_FEATURES)]}
    trained: dict = {"teacher": [], "student": []}

    def run(name, rows):
        for epoch in range(1, epochs + 1):
            state, batches = train_epoch(rows, states[name][-1], epoch, f"{name}:{seed}", max_steps)
            states[name].append(state)
            trained[name].append(batches)
    run("teacher", wide)
    teacher = materialize(with_scores(wide, states["teacher"][-1].weights), "teacher-scores")
    a, b, _ = L.LOSS_WEIGHTS
    soft = 1 / (1 + F.exp(-F.col("z") / L.TEACHER_TEMPERATURE))
    mixed = narrow.join(teacher.select("doc_id", soft.alias("p")), "doc_id").withColumn(
        "y", (a * F.col("p") + b * F.col("y")) / (a + b)).select(*_FIELDS)
    run("student", materialize(mixed, "student-rows"))

    size = max(BATCH_SIZE, -(-narrow.count() // (ACCUMULATION_STEPS * max_steps)))
    losses = None
    for epoch, state in enumerate(states["student"][1:], 1):
        student = with_scores(narrow, state.weights)
        order = minibatch_assign(narrow.select("doc_id"), "doc_id", size, seed=f"student:{seed}:{epoch}").select("doc_id", "batch")
        pairs = (student.withColumnsRenamed({"z": "zs", "hidden": "student_hidden"})
                 .join(teacher.withColumnsRenamed({"z": "zt", "hidden": "teacher_hidden"}), "doc_id")
                 .join(narrow.select("doc_id", F.col("y").cast("int").alias("gold")), "doc_id").join(order, "doc_id"))
        pairs = pairs.select("batch", F.array(F.lit(0.0), "zs").alias("student"), F.array(F.lit(0.0), "zt").alias("teacher"),
                             "student_hidden", "teacher_hidden", "gold")
        own = materialize(L.batch_losses(pairs, masked=None), "batch-losses")
        mean = M.running_mean(own, "combined_loss").select("batch", "running_mean")
        own = own.join(mean, "batch").select(F.lit(epoch).cast("bigint").alias("epoch"), "batch", F.col("n_rows").cast("bigint").alias("n_rows"),
                                             "kl_loss", F.col("mlm_loss").alias("label_loss"), "cosine_loss", "combined_loss", "running_mean")
        losses = own if losses is None else losses.unionByName(own)
    scored = None
    for name, n in (("teacher", TEACHER_FEATURES), ("student", STUDENT_FEATURES)):
        for epoch, state in enumerate(states[name][1:], 1):
            pred = with_scores(dev[n], state.weights).join(dev[n].select("doc_id", F.col("y").cast("int").alias("label")), "doc_id").select(
                F.lit(name).alias("run"), F.lit(epoch).cast("bigint").alias("epoch"), (F.col("z") > 0).cast("int").alias("pred"), "label")
            scored = pred if scored is None else scored.unionByName(pred)
    metrics = materialize(M.binary_metrics(scored), "epoch-metrics")
    best = M.best_epoch(metrics).select("run", "best_epoch")
    metrics = metrics.join(best, "run").withColumn("selected", F.col("epoch") == F.col("best_epoch")).drop("best_epoch")
    train = spark.createDataFrame([(name, e, b, x, k) for name, per in trained.items() for e, own in enumerate(per, 1) for b, x, k in own],
                                  "run string, epoch long, batch long, loss double, n_rows long")
    return {"states": states, "losses": losses, "metrics": metrics, "train": train}
