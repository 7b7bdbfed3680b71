"""The linear chain against all label sequences, its gradient, and its held-out score beside independent tokens."""

import itertools
import random

import numpy as np
import pytest

from casegrain.functions.batches import token_bounds, token_texts
from casegrain.plans import catalog as C
from casegrain.plans import span_tagger as ST


def brute(emit, pair):
    scores = {}
    for y in itertools.product((0, 1), repeat=len(emit)):
        scores[y] = sum(e for e, v in zip(emit, y) if v) + sum(pair[a, b] for a, b in zip(y, y[1:]))
    z = np.logaddexp.reduce(list(scores.values()))
    p = {y: np.exp(s - z) for y, s in scores.items()}
    return scores, z, p


def test_marginals_and_viterbi_equal_all_sequences():
    rng = np.random.default_rng(3)
    size = np.array([1, 2, 5, 8, 3])
    emit = rng.normal(size=(5, 8)) * 2
    emit[np.arange(8) >= size[:, None]] = 0
    pair = rng.normal(size=(2, 2))
    one, pairs, z = ST.marginals(emit, size, pair)
    best = ST.viterbi(emit, size, pair)
    for k, n in enumerate(size):
        scores, norm, p = brute(emit[k, :n], pair)
        assert z[k] == pytest.approx(norm)
        assert tuple(best[k, :n]) == max(scores, key=scores.get)
        for i in range(n):
            assert one[k, i] == pytest.approx(sum(v for y, v in p.items() if y[i]))
        for a, b in itertools.product((0, 1), repeat=2):
            assert pairs[k, a, b] == pytest.approx(sum(v * sum((x, w) == (a, b) for x, w in zip(y, y[1:])) for y, v in p.items()))


def _docs(spark, n=60):
    r = random.Random(1)
    rows = []
    for i in range(n):
        sents = [" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=6)) + "." for _ in range(6)]
        marked = [" ".join(["held"] * 0 + r.choices(["guilty", "beta", "gamma", "court"], k=6)) + "." for _ in range(2)]
        rows.append((i, " ".join(sents[:3] + marked + sents[3:]), marked))
    return spark.createDataFrame(rows, "doc_id long, text string, m array<string>")


def test_gradient_is_that_of_the_loss(spark):
    rows = ST.window_features(_docs(spark, 5), chosen="m").cache()
    w = np.random.default_rng(2).normal(size=ST.FEATURES + 1 + ST.PAIRS) * .3
    value = lambda x: {r.key: r.value for r in ST.gradient_parts(rows.repartition(3), x, True).collect()}
    got = value(w)
    used = max((k for k in got if 0 <= k < ST.FEATURES), key=lambda k: abs(got[k]))
    for k in (used, ST.FEATURES, ST.FEATURES + 2, ST.FEATURES + 4):
        up, down = w.copy(), w.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert got.get(k, 0.0) == pytest.approx((value(up)[-1] - value(down)[-1]) / 2e-4, rel=1e-3, abs=1e-4)


def test_losses_fall_and_runs_come_back(spark):
    docs = _docs(spark)
    rows = ST.window_features(docs, chosen="m").cache()
    states = ST.train(rows, epochs=3, steps=3)
    losses = [x for _, x in states]
    assert losses[0] > losses[1] > losses[2]
    weights = states[-1][0].weights
    f1 = ST.scored(ST.decode(rows, weights), "chain", 3).first()["f1"]
    assert f1 > 0.85
    spans = {(r.doc_id): r for r in ST.rationale_spans(docs, weights).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(spans) > 50 and all("court" in texts[d][r.start:r.end] or "guilty" in texts[d][r.start:r.end] for d, r in spans.items())


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (3, "one"), (4, "w " * 1500)], "doc_id long, text string")
    rows = ST.window_features(df)
    assert sorted((r.doc_id, r.window_no, len(r.labels)) for r in rows.collect()) == [
        (1, 0, 0), (2, 0, 0), (3, 0, 1), (3, 0, 1), (4, 0, 510), (4, 1, 510), (4, 2, 480)]
    w = np.zeros(ST.FEATURES + 1 + ST.PAIRS)
    w[ST.FEATURES] = 1.0
    got = sorted((r.doc_id, r.start, r.end, r.n_tokens) for r in ST.rationale_spans(df, w).collect())
    assert got == [(3, 0, 3, 1), (3, 0, 3, 1), (4, 0, 1019, 510), (4, 1020, 2039, 510), (4, 2040, 2999, 480)]
    assert ST.decode(rows, w).count() == 7 and ST.decode(rows.limit(0), w).count() == 0


def test_chain_beats_independent_tokens_on_held_out_documents(spark):
    """Cue words stand in a third of the places of a marked sentence; the rest is common to all."""
    r = random.Random(7)
    rows = []
    for i in range(150):
        plain = [" ".join(r.choices(["beta", "gamma", "delta", "eta"], k=12)) + "." for _ in range(5)]
        marked = [" ".join(r.choices(["beta", "gamma", "delta", "eta", "guilty", "court"], k=12)) + "." for _ in range(2)]
        rows.append((i, " ".join(plain[:2] + marked[:1] + plain[2:4] + marked[1:] + plain[4:]), marked))
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    feats = ST.window_features(docs, chosen="m").cache()
    train, held = feats.where("doc_id % 3 > 0"), feats.where("doc_id % 3 = 0")
    f1 = {}
    for chain in (True, False):
        weights = ST.train(train, epochs=10, steps=4, chain=chain)[-1][0].weights
        f1[chain] = ST.scored(ST.decode(held, weights), "x", 1).first()["f1"]
    assert f1[True] > f1[False] + 0.05 and f1[True] > 0.7, f1


def test_registered_spans(spark):
    rows = C.q_span_training(spark, "/root/testdata/sf0.001").collect()
    assert {(x.run, x.epoch) for x in rows} == {("chain", e) for e in range(1, 5)}
    assert sum(x.selected for x in rows) == 1 and rows[0].train_loss > 0


def test_spans_of_many_texts_are_decoded_together(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "!"]) for _ in range(rng.choice([0, 1, 5, 509, 510, 511, 1300]))) for _ in range(40)]
    w = np.random.default_rng(5).normal(0, 1.5, ST.FEATURES + 1 + ST.PAIRS)
    pair, want = w[ST.FEATURES + 1:].reshape(2, 2), []
    for key, t in enumerate(texts):
        starts, ends = token_bounds(t)
        idx = ST.token_features(token_texts(t, starts, ends), {})
        for lo in range(0, len(starts), 510):
            emit = (w[idx[lo:lo + 510]].sum(axis=1) + w[ST.FEATURES])[None, :]
            label = [0, *ST.viterbi(emit, np.array([emit.shape[1]]), pair)[0], 0]
            first = [i for i in range(1, len(label)) if label[i] and not label[i - 1]]
            last = [i for i in range(1, len(label) - 1) if label[i] and not label[i + 1]]
            want += [(key, int(starts[lo + a - 1]), int(ends[lo + b - 1]), lo + a - 1, b - a + 1) for a, b in zip(first, last)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in ST.rationale_spans(docs, w).collect()) == sorted(want) and want
    # 40 texts in one task: one call of the decoder for all of them.
    calls = spark.sparkContext.accumulator(0)
    plain = ST.viterbi
    monkeypatch.setattr(ST, "viterbi", lambda *a: (calls.add(1), plain(*a))[1])
    ST.rationale_spans(docs, w).collect()
    assert calls.value == 1
