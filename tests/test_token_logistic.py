"""The packed token regression against Spark ML's fits, its buckets against HashingTF, and one path for all candidates."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from casegrain.operators import metrics as M
from casegrain.plans import models as MD
from casegrain.plans import token_logistic as TL

TEXTS = ["", "One", "Ünïcode straße ΣΑΣ ΟΔΟΣ. x", "a, b; a a a", "w " * 1100, "日本 語! 𝒳 abcdefghijklmnop", " ".join(f"many{i}" for i in range(1500))]


def _labelled(spark, n=80, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(["alpha", "beta", "gamma", "delta", "guilty", "court", "of", ",", f"w{r.randrange(200)}"]) for _ in range(r.choice([0, 1, 7, 30, 600]))]
        rows.append((i, " ".join(words), [int(w in ("guilty", "court") and r.random() < .8 or r.random() < .1) for w in words], "train" if i % 4 else "validation"))
    return spark.createDataFrame(rows, "doc_id long, text string, labels array<int>, part string")


def _ml_rows(docs, weights):
    """What the tagger was trained on before: a vector for each token."""
    hashed = MD.tagger_stages(1)[0].transform(MD.token_rows(docs, labels="labels", keep=("part",)))
    return hashed.withColumn("w", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]))


def test_buckets_are_those_of_hashing_tf(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {(r.doc_id, r.pos): sorted(int(i) for i in r.features.indices)
            for r in MD.tagger_stages(1)[0].transform(MD.token_rows(docs)).collect()}
    for n in (MD.TAGGER_FEATURES, 7):       # seven buckets: features of a token collide
        if n == 7:
            few = HashingTF(inputCol="feats", outputCol="features", numFeatures=7, binary=True)
            want = {(r.doc_id, r.pos): sorted(int(i) for i in r.features.indices) for r in few.transform(MD.token_rows(docs)).collect()}
        held, got = TL.TokenBuckets(n), {}
        for key, t in enumerate(TEXTS):
            idx = held.of([held.rows([]), held.rows(TL.token_texts(t, *TL.token_bounds(t)))])
            got |= {(key, pos): sorted(x for x in row if x < n) for pos, row in enumerate(idx.tolist())}
        assert got == want


def test_every_candidate_is_the_fit_of_spark(spark):
    docs, weights = _labelled(spark), (0.6, 2.5)
    rows = TL.packed_rows(docs, weights, MD.TAGGER_FEATURES).cache()
    vectors = _ml_rows(docs, weights).cache()
    iterations = (1, 5, 10, 20)
    fitted = TL.fit_path(rows.filter("part = 'train'"), iterations, MD.TAGGER_FEATURES, 0.001)
    seen = {(r.epoch, r.pred, r.label): r.rows for r in TL.confusion(rows, fitted, "validation").groupBy("epoch", "pred", "label").agg(
        F.sum("rows").alias("rows")).collect()}
    for epoch, (k, (coefficients, intercept)) in enumerate(zip(iterations, fitted), 1):
        layer = MD.tagger_stages(k)[1]
        want = layer.fit(vectors.filter("part = 'train'"))
        assert np.allclose(want.coefficients.toArray(), coefficients, rtol=1e-6, atol=1e-8)
        assert intercept == pytest.approx(want.intercept, rel=1e-6)
        pairs = want.transform(vectors.filter("part = 'validation'")).groupBy("prediction", "label").count().collect()
        assert {(epoch, int(r.prediction), int(r.label)): r["count"] for r in pairs} == {x: n for x, n in seen.items() if x[0] == epoch}
        own = TL.as_model(layer, coefficients, intercept)
        assert own.intercept == intercept and own.getMaxIter() == k and own.transform(vectors.limit(3)).count() == 3


def test_one_pass_over_the_rows_an_iteration(spark, monkeypatch):
    """The fits of 5, 10 and 20 iterations took 35 and more passes; as one path they take at most 20 and the searches."""
    passes, plain = [], TL._summed
    monkeypatch.setattr(TL, "_summed", lambda *a: (passes.append(1), plain(*a))[1])
    docs = _labelled(spark, 24)
    rows = TL.packed_rows(docs, (1.0, 1.0), MD.TAGGER_FEATURES).cache()
    fitted = TL.fit_path(rows, MD.EPOCH_ITERATIONS, MD.TAGGER_FEATURES, 0.001)
    assert len(fitted) == 3 and 8 < len(passes) <= 30


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b", [1, 1, 0], "train"), (2, None, [], "train"), (3, "c", [1], "train")],
                                 "doc_id long, text string, labels array<int>, part string")
    rows = TL.packed_rows(docs, (0.5, 2.0), 64)
    assert sorted((len(r.features), list(r.label), list(r.w)) for r in rows.collect()) == [(10, [1], [.5, 2.0]), (20, [1, 1], [.5, 2.0])]
    assert [b for _, b in TL.fit_path(rows, (1, 2), 64, 0.001)] == [np.inf, np.inf]
    none = docs.withColumn("labels", F.transform("labels", lambda x: x * 0))
    assert [b for _, b in TL.fit_path(TL.packed_rows(none, (1.0, 1.0), 64), (3,), 64, 0.001)] == [-np.inf]
    with pytest.raises(ValueError):
        TL.fit_path(rows.limit(0), (1,), 64, 0.001)
    with pytest.raises(Exception, match="more tokens than labels"):
        TL.packed_rows(docs.withColumn("labels", F.slice("labels", 1, 1)), (1.0, 1.0), 64).collect()


def test_counted_pairs_have_the_same_metrics(spark):
    pairs = spark.createDataFrame([(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)], "pred int, label int").select(
        F.lit("x").alias("run"), F.lit(1).alias("epoch"), "pred", "label")
    counted = pairs.groupBy("run", "epoch", "pred", "label").agg(F.count("*").alias("k"))
    assert M.binary_metrics(pairs).collect() == M.binary_metrics(counted, count="k").collect()


def test_windows_in_shares_equal_windows_in_logs():
    """Products of shares instead of logarithms, place by place for the windows that are long enough: the same marginals and labels."""
    from casegrain.plans import span_tagger as ST
    rng = np.random.default_rng(8)
    size = np.array([0, 1, 510, 7, 510, 2, 300, 0])
    emit = rng.normal(size=(8, 510)) * 3
    emit[np.arange(510) >= size[:, None]] = 0
    for pair in (np.zeros((2, 2)), rng.normal(size=(2, 2)) * 4, np.array([[40.0, -40], [-60, 9]])):
        got, want = ST.marginals(emit, size, pair), ST.marginals_in_logs(emit, size, pair)
        some = np.arange(510) < size[:, None]
        assert np.allclose(got[0][some], want[0][some], atol=1e-9) and np.allclose(got[1], want[1], rtol=1e-7, atol=1e-7)
        assert np.allclose(got[2][size > 0], want[2][size > 0])
        best = ST.viterbi(emit, size, pair)
        for k in range(8):
            alone = ST.viterbi(emit[k:k + 1, :max(1, size[k])], size[k:k + 1], pair)[0]
            assert np.array_equal(best[k, :size[k]], alone[:size[k]]) and not best[k, size[k]:].any()
    huge = emit * 1000
    assert np.isfinite(ST.marginals(huge, size, np.ones((2, 2)))[2]).all()


def test_chain_buckets_are_names_hashed_one_by_one():
    import xxhash

    from casegrain.plans import span_tagger as ST
    for text in TEXTS:
        words = TL.token_texts(text, *TL.token_bounds(text))
        names = [[f"t={w}", f"p={([chr(60) + 's>'] + words)[i]}", f"n={(words + ['</s>'])[i + 1]}", f"l={min(len(w), 12)}", f"d={i % 510 * 10 // 510}"] for i, w in enumerate(words)]
        want = [[xxhash.xxh64_intdigest(x) % ST.FEATURES for x in row] for row in names]
        assert ST.token_features(words, {}).tolist() == want
