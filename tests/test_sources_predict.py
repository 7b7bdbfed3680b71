"""Sources (optional split, intake), array helpers, and the no-tagger prediction path."""

from pyspark.sql import functions as F

from casegrain.functions.arrays import argmax
from casegrain.operators.tokens import pad_or_truncate
from casegrain.plans.models import outcome_pipeline, predict_cases
from casegrain.sources.corpus import case_intake, union_splits


def test_missing_split_flows_through(spark):
    train = spark.createDataFrame([(1, "a b", 1), (2, "c", 0)], "doc_id long, text string, label int")
    test = spark.createDataFrame([(3, "d", 1)], "doc_id long, text string, label int")
    u = union_splits(spark, {"train": train, "test": test, "expert": None})
    rows = {r.doc_id: (r.split, r.raw_text, None if r.rationale_mask is None else len(r.rationale_mask))
            for r in u.collect()}
    assert rows == {1: ("train", "a b", 512), 2: ("train", "c", 512), 3: ("test", "d", None)}


def test_case_intake_counts_blank(spark):
    cases = spark.createDataFrame([(1, "text"), (2, "   "), (3, None), (4, "\\t")], "case_id long, text string")
    live, blank = case_intake(cases)
    assert sorted(r.case_id for r in live.collect()) == [1, 4] and blank == 2


def test_argmax_ties_and_mask_alignment(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1, 0, 1])], "z array<double>, m array<int>")
    r = df.select(argmax("z").alias("a"), pad_or_truncate(F.col("m"), 5).alias("p"),
                  pad_or_truncate(F.col("m"), 2).alias("t")).first()
    assert r.a == 1 and r.p == [1, 0, 1, 0, 0] and r.t == [1, 0]


def test_prediction_without_tagger_uses_classifier_evidence(spark):
    rows = [(i, ("guilty appeal dismissed " if i % 2 else "bail granted appeal allowed ") * 3, i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    clf = outcome_pipeline(10).fit(train)
    cases = spark.createDataFrame([(1, "appeal allowed, bail granted."), (2, "  ")], "case_id long, text string")
    out = predict_cases(cases, clf, None).collect()
    one, blank = sorted(out, key=lambda r: r.case_id)
    assert one.outcome in ("ALLOWED", "DISMISSED") and not one.blank
    assert "[" in one.rationale_text and one.rationale_text.replace("[", "").replace("]", "").startswith("appeal")
    assert blank.blank and blank.outcome is None and blank.rationale_text is None


def test_evidence_reads_the_fitted_hashers_weights(spark):
    """The marked tokens are those whose own weight, by the classifier's vectors, is above the mean."""
    words = ["guilty", "appeal", "dismissed", "bail", "granted", "allowed", "ab", "x", "longerword"]
    rows = [(i, " ".join(words[(i + k) % 9] for k in range(5)), i % 2) for i in range(40)]
    clf = outcome_pipeline(10).fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    out = predict_cases(spark.createDataFrame([(1, " ".join(words))], "case_id long, text string"), clf, None).first()
    weights = {}
    for w in words:
        v = clf.stages[1].transform(spark.createDataFrame([([w],)], "words array<string>")).first()["tf"]
        weights[w] = abs(clf.stages[-1].coefficients[int(v.indices[0])])
    mean = sum(weights.values()) / len(weights)
    marked = {x[1:-1] for x in out.rationale_text.split() if x.startswith("[")}
    assert marked == {w for w in words if weights[w] > mean}


def test_prediction_without_classifier_and_with_odd_keys(spark, tmp_path):
    import pytest
    from casegrain.sources.model_store import load_first, save_model
    cases = spark.createDataFrame([(None, "some text"), (1, "some text"), (1, "other"), (2, "\t\n")], "case_id long, text string")
    with pytest.raises(ValueError):
        predict_cases(cases, None, None)
    with pytest.raises(FileNotFoundError):
        load_first(spark, [str(tmp_path / "a"), str(tmp_path / "b")], required=True)
    clf = outcome_pipeline(5).fit(spark.createDataFrame([(1, "a b", 1), (2, "c", 0)], "doc_id long, text string, label int"))
    save_model(clf, str(tmp_path / "b"))
    loaded = load_first(spark, [str(tmp_path / "a"), str(tmp_path / "b")], required=True)
    out = predict_cases(cases, loaded, None).collect()
    assert sorted((r.case_id is None, r.case_id, r.blank) for r in out if r.case_id is not None) == [
        (False, 1, False), (False, 1, False), (False, 2, True)] and len(out) == 4
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):       # there, but not a model: an error, not the next one
        load_first(spark, [str(tmp_path / "broken"), str(tmp_path / "b")])
