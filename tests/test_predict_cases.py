"""Prediction in the row, and outcome models whose texts are cut into tokens once."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from casegrain.plans import models as MD
from casegrain.plans import token_logistic as TL

TEXTS = ["guilty court, of a!", "", None, " \t", "Ünï ΟΔΟΣ w w w", "w " * 1100, "guilty court, of a!"]


def _corpus(spark, n=60):
    rows = [(("train", "train", "dev", "test")[i % 4], i, ("guilty appeal dismissed " if i % 3 else "bail granted appeal ") + f"w{i % 11} x{i % 7}", int(i % 3 == 0 or i % 10 == 0))
            for i in range(n)]
    return spark.createDataFrame(rows, "split string, doc_id long, text string, label int")


def test_marks_need_no_join_and_equal_the_tagger(spark):
    """A row's mask comes from its own tokens: what ``tagger.transform`` says of each, without a row per token, a join or a shuffle of tokens."""
    cases = spark.createDataFrame([(i % 5, t) for i, t in enumerate(TEXTS)], "case_id long, text string")
    hasher, layer = MD.tagger_stages(1)
    tagger = PipelineModel([hasher, TL.as_model(layer, np.random.default_rng(1).normal(size=MD.TAGGER_FEATURES), 0.1)])
    clf = MD.outcome_pipeline(5).fit(_corpus(spark))
    out = MD.predict_cases(cases, clf, tagger)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    rows = {i: t for i, t in enumerate(TEXTS) if t and t.strip()}
    want = {i: [] for i in rows}
    for r in tagger.transform(MD.token_rows(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))).orderBy("doc_id", "pos").collect():
        want[r.doc_id].append(f"[{r.token}]" if r.prediction else r.token)
    plain = lambda t: "".join(t.split())
    out = out.collect()
    assert sorted((r.case_id, plain(r.rationale_text)) for r in out if not r.blank) == sorted((i % 5, "".join(w)) for i, w in want.items())
    scored = clf.transform(cases.fillna("")).select("case_id", "text", "prediction", F.round(MD.vector_to_array("probability")[1], 6).alias("p"))
    assert sorted((r.case_id, r.p, r.outcome) for r in scored.withColumn("outcome", MD.decode_outcome("prediction")).collect() if r.text.strip()) == sorted(
        (r.case_id, r.p_allowed, r.outcome) for r in out if not r.blank)
    assert len(out) == len(TEXTS) and all(r.p_allowed is None and r.outcome is None and r.rationale_text is None for r in out if r.blank)


def test_outcome_models_equal_whole_pipelines_and_cut_texts_once(spark, monkeypatch):
    cuts, plain = [], MD.RegexTokenizer._transform
    monkeypatch.setattr(MD.RegexTokenizer, "_transform", lambda self, df: (cuts.append(1), plain(self, df))[1])
    corpus = _corpus(spark).cache()
    train = corpus.filter("split = 'train'")
    summary, _, teacher, student = MD.train_distilled(corpus)
    # It was once for each pass over the texts: features, deviations and blocks of each fit, and each score.
    assert len(cuts) == 1
    assert np.allclose(MD.outcome_pipeline(20, MD.TEACHER_FEATURES).fit(train).stages[-1].coefficients.toArray(), teacher.stages[-1].coefficients.toArray())
    soft = MD._scored(teacher, train)
    doubled = soft.select("text", F.lit(1.0).alias("soft_label"), F.col("p_allowed").alias("w")).union(
        soft.select("text", F.lit(0.0), 1 - F.col("p_allowed")))
    alone = MD.outcome_pipeline(20, MD.STUDENT_FEATURES, label="soft_label", weight="w").fit(doubled)
    assert np.allclose(alone.stages[-1].coefficients.toArray(), student.stages[-1].coefficients.toArray(), atol=1e-6)
    for start in (None, student):
        met, model, best = MD.train_classifier(corpus, start=start)
        iters = MD.EPOCH_ITERATIONS[best - 1]
        if start is None:
            want = MD.outcome_pipeline(iters).fit(train)
        else:
            want = PipelineModel([*start.stages[:-1], MD.outcome_pipeline(iters).getStages()[-1].fit(PipelineModel(start.stages[:-1]).transform(train))])
        assert np.allclose(want.stages[-1].coefficients.toArray(), model.stages[-1].coefficients.toArray())
        rows = {(r.split, r.epoch): r for r in met.collect()}
        assert set(rows) == {("dev", 1), ("dev", 2), ("dev", 3), ("test", best)}
        for split in ("dev", "test"):
            seen = MD._scored(want, corpus.filter(F.col("split") == split)).agg(F.count("*"), F.sum((F.col("pred") == F.col("label")).cast("int"))).first()
            got = rows[split, best]
            assert (got.n, got.tp + got.tn) == tuple(seen)
