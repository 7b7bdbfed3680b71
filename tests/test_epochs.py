"""True epochs: distributed steps equal a plain loop, epochs continue, losses fall, models beat the majority."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain.functions.text import hex8
from casegrain.operators.sampling import minibatch_assign
from casegrain.plans import catalog as C
from casegrain.plans import epochs as EP

WORDS = ["guilty", "appeal", "dismissed", "bail", "granted", "allowed", "court", "the"]


def _docs(spark, n=90):
    r = random.Random(6)
    rows = []
    for i in range(n):
        y = i % 3 == 0
        rows.append((i, " ".join(r.choices(WORDS[:3] if y else WORDS[3:6], k=4) + r.choices(WORDS[6:], k=5)), int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def plain_epoch(rows, order, state):
    """The same epoch in one process."""
    out = []
    for step in sorted({s for _, s in order.values()}):
        g, mass, loss = np.zeros(len(state.weights)), 0.0, {}
        for i, (idx, val, y, w) in rows.items():
            b, s = order[i]
            if s == step:
                z = float((state.weights[idx] * val).sum() + state.weights[-1])
                miss = w * (1 / (1 + np.exp(-z)) - y)
                g[idx] += miss * val
                g[-1] += miss
                mass += w
                loss.setdefault(b, []).append(w * (np.log1p(np.exp(z)) - y * z))
        out += [(b, float(np.mean(x)), len(x)) for b, x in loss.items()]
        state = state.stepped(g / mass + np.append(EP.DECAY * state.weights[:-1], 0.0))
    return state, sorted(out)


def test_distributed_epochs_equal_a_plain_loop(spark):
    rows = EP.sparse_rows(_docs(spark).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)), 64, weight="w").cache()
    local = {r.doc_id: (np.array(r.idx), np.array(r.val), r.y, r.w) for r in rows.collect()}
    state = plain = EP.State.zero(64)
    means = []
    for epoch in (1, 2, 3):
        order = {r.doc_id: (r.batch, r.step) for r in minibatch_assign(rows.select("doc_id"), "doc_id", 8, seed=f"s:{epoch}").collect()}
        state, losses = EP.train_epoch(rows.repartition(5), state, epoch, "s", batch_size=8)
        plain, want = plain_epoch(local, order, plain)
        assert np.allclose(state.weights, plain.weights, atol=1e-9) and state.steps == plain.steps == 6 * epoch
        assert [(b, n) for b, _, n in losses] == [(b, n) for b, _, n in want]
        assert np.allclose([x for _, x, _ in losses], [x for _, x, _ in want])
        assert len(losses) == 12 and losses[-1][2] == 2         # the last batch is short
        means.append(np.mean([x for _, x, _ in losses]))
    assert means[0] > means[1] > means[2]


def test_saved_state_is_continued(spark, tmp_path):
    rows = EP.sparse_rows(_docs(spark), 32).cache()
    one, _ = EP.train_epoch(rows, EP.State.zero(32), 1)
    EP.save_state(spark, one, str(tmp_path / "s"))
    again = EP.load_state(spark, str(tmp_path / "s"))
    a, la = EP.train_epoch(rows, one, 2)
    b, lb = EP.train_epoch(rows, again, 2)
    assert np.allclose(a.weights, b.weights) and a.steps == b.steps > one.steps and np.allclose([x[1] for x in la], [x[1] for x in lb])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "a", None)], "doc_id long, text string, label int")
    rows = EP.sparse_rows(df, 16)
    assert sorted((r.doc_id, r.idx) for r in rows.collect()) == [(1, []), (2, [])]
    state, losses = EP.train_epoch(rows, EP.State.zero(16), 1)
    assert len(losses) == 1 and losses[0][1] == pytest.approx(np.log(2)) and not state.weights[:-1].any()
    none, losses = EP.train_epoch(rows.limit(0), EP.State.zero(16), 1)
    assert losses == [] and none.steps == 0


def test_distillation_in_epochs(spark):
    docs = _docs(spark, 400)
    corpus = docs.withColumn("split", F.when(hex8(F.col("doc_id").cast("string")) % 4 == 0, "dev").otherwise("train"))
    out = EP.distill(corpus, epochs=3)
    met = {(r.run, r.epoch): r for r in out["metrics"].collect()}
    dev = corpus.where("split = 'dev'").agg(F.avg(1 - F.col("label"))).first()[0]
    assert all(met[run, 3].accuracy > dev + 0.1 for run in ("teacher", "student"))       # better than the majority
    assert {sum(r.selected for r in met.values() if r.run == x) for x in ("teacher", "student")} == {1}
    losses = sorted(out["losses"].collect(), key=lambda r: (r.epoch, r.batch))
    mean = lambda e: np.mean([r.combined_loss for r in losses if r.epoch == e])
    assert mean(1) > mean(2) > mean(3)
    for e in (1, 2, 3):
        own = [r for r in losses if r.epoch == e]
        assert [r.running_mean for r in own] == pytest.approx([np.mean([x.combined_loss for x in own[:i + 1]]) for i in range(len(own))])
        assert all(r.combined_loss == pytest.approx(0.5 * r.kl_loss + 0.4 * r.label_loss + 0.1 * r.cosine_loss) for r in own)
    train = {}
    for r in out["train"].collect():
        train.setdefault((r.run, r.epoch), []).append(r.loss)
    assert np.mean(train["teacher", 1]) > np.mean(train["teacher", 2]) > np.mean(train["teacher", 3])


def test_registered_epochs(spark):
    rows = C.q_epoch_training(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 6 and all(r.n_batches > 0 for r in rows)
