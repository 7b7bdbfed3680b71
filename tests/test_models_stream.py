"""Models and streaming on the smallest tables: quality floor, leakage, stream == batch."""

from pyspark.sql import functions as F

from casegrain.operators.sampling import train_val_split
from casegrain.plans import catalog as C
from casegrain.plans import models as MD
from casegrain.session import materialize

SF = "/root/testdata/sf0.001"


def test_split_has_no_leakage(spark):
    parts = train_val_split(C._docs(spark, SF).select("doc_id"))
    dup = parts.groupBy("doc_id").agg(F.countDistinct("part").alias("k")).filter("k > 1").count()
    assert dup == 0 and parts.count() == 200


def test_stream_equals_batch(spark):
    batch = C.q_predict_batch(spark, SF)
    stream = C.q_predict_stream(spark, SF).drop("batch_id")
    cols = ["conv_id", "turn", "outcome", "p_allowed", "rationale_text"]
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    s = sorted(tuple(r) for r in stream.select(*cols).collect())
    assert b == s and len(b) > 0
    assert {r[2] for r in b} <= {"ALLOWED", "DISMISSED"}
    assert all(0.0 <= r[3] <= 1.0 for r in b)


def test_classifier_metrics_in_range(spark):
    met = C.q_classifier_train(spark, SF).collect()
    assert any(r.selected for r in met)
    for r in met:
        assert 0.0 <= r.accuracy <= 1.0 and 0.0 <= r.f1 <= 1.0


def test_tagger_rows_are_hashed_once(spark, monkeypatch):
    written = {}

    def kept(df, name):
        written[name] = materialize(df, name)
        return written[name]
    monkeypatch.setattr(MD, "materialize", kept)
    rows = [(i, f"alpha beta gamma{i % 7}. plain words stand here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = docs.select("doc_id", F.lit(0).cast("long").alias("window_no"), F.lit(10).cast("long").alias("n_active"),
                        F.lit(4).cast("long").alias("n_positive"), F.array(*[F.lit(int(0 < i < 5)) for i in range(512)]).alias("rationale_mask"))
    met, tagger, _ = MD.train_rationale(sizes, docs)
    assert {r.epoch for r in met.collect()} == {1, 2, 3} and max(r.f1 for r in met.collect()) > 0.9
    # Candidates read vectors, not the names of features; the saved chain still starts from names.
    assert written["tagger-rows"].columns == ["part", "features", "label", "w"]
    marked = tagger.transform(MD.token_rows(docs.limit(1))).orderBy("pos").select("prediction").collect()
    assert [int(r[0]) for r in marked] == [1, 1, 1, 1, 0, 0, 0, 0]
