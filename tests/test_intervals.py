"""Annotations in their own table: equal to the in-row masks, spread over bins."""

import random

from pyspark.sql import functions as F

from casegrain.functions import text as X
from casegrain.operators import annotations as A
from casegrain.operators import intervals as IV


def _case(spark, r, n):
    docs, notes = [], []
    for i in range(n):
        sents = [" ".join(r.choices(["aa", "b", "ccc", "don't", "é😀", "9"], k=r.randrange(1, 6))) + r.choice([".", "!", "..."]) for _ in range(r.randrange(12))]
        docs.append((i, r.choice([" ", "\n", "  "]).join(sents)))
        notes += [(i, s) for s in sents if r.random() < .3] + [(i, "never said.")] * (i % 2)
    docs += [(900, None), (901, ""), (902, "No. No. No. Yes.")]
    notes += [(902, "No."), (902, "No."), (902, None), (901, "x"), (999, "aa.")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(notes, "doc_id long, sentence string")


def test_equal_to_masks_in_the_row(spark):
    docs, notes = _case(spark, random.Random(5), 40)
    chosen = notes.where("sentence IS NOT NULL").groupBy("doc_id").agg(F.to_json(F.create_map(F.lit("rank1"), F.collect_list("sentence"))).alias("expert_1"))
    want = sorted(map(tuple, A.rationale_masks(docs.join(chosen, "doc_id", "left")).collect()), key=str)
    for size in (7, 4096):
        got = IV.interval_masks(docs, notes, size=size).select("doc_id", "window_no", "n_active", "n_positive", "rationale_mask")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(x[3] for x in want) > 50


def test_one_document_of_a_hundred_thousand_sentences(spark):
    """Its tokens are spread over bins: no key holds more than a bin's tokens."""
    sents = [f"Sentence number {i} is here." for i in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(sents))], "doc_id long, text string")
    notes = spark.createDataFrame([(1, s) for s in sents[::50]], "doc_id long, sentence string")
    tokens = IV.token_places(docs)
    most = IV._binned(tokens, IV.BIN).groupBy("doc_id", "bin").count().agg(F.max("count")).first()[0]
    assert most <= IV.BIN
    m = IV.interval_masks(docs, notes).agg(F.sum("n_positive"), F.sum(F.col("n_active") - 2), F.count(F.lit(1))).first()
    assert (m[0], m[1], m[2]) == (2000 * 6, 600_000, -(-600_000 // 510))


def _shuffled_rows(df):
    """Rows written to shuffles by the query, from the metrics of its plan (adaptive execution off)."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        written = node.metrics().get("shuffleRecordsWritten")
        rows += written.get().value() if written.isDefined() else 0
    return rows


def test_no_row_per_token_is_shuffled(spark):
    text = " ".join(f"w{i}" for i in range(20_000)) + ". One chosen sentence here. " + "x " * 20_000
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    notes = spark.createDataFrame([(i, "One chosen sentence here.") for i in range(3)], "doc_id long, sentence string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = IV.interval_masks(docs, notes)
        rows = got.collect()
        shuffled = _shuffled_rows(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n_active - 2 for r in rows) == 3 * 40_006 and sum(r.n_positive for r in rows) == 3 * 5
    assert 0 < shuffled < 5_000


def test_long_tokens_repeated_and_null_ids(spark):
    """Tokens over several bins count once; copies of an id add their tokens; a null id has its tokens, no marks and an empty window."""
    docs = spark.createDataFrame([(1, "a" * 30 + " b. cc."), (1, "a" * 30 + " b. cc."), (2, "x. " + "é" * 20 + "y."), (2, None), (3, None), (3, ""),
                                  (None, "b. c."), (None, "d"), (None, None)], "doc_id long, text string")
    notes = spark.createDataFrame([(1, "a" * 30 + " b."), (2, "é" * 20 + "y."), (2, "x."), (3, "x."), (None, "b.")], "doc_id long, sentence string")
    for size in (1, 7, 4096):
        got = IV.interval_masks(docs, notes, size=size).collect()
        assert sorted([(r.doc_id or 0, r.window_no, r.n_active, r.n_positive) for r in got]) == [
            (0, 0, 2, 0), (0, 0, 7, 0), (1, 0, 12, 3), (2, 0, 6, 4), (3, 0, 2, 0)]
        marks = {r.doc_id: [i for i, b in enumerate(r.rationale_mask) if b] for r in got}
        assert (marks[1], marks[2], marks[3], marks[None]) == ([1, 2, 3], [1, 2, 3, 4], [], [])
        assert all(len(r.rationale_mask) == 512 for r in got)
    assert sorted(map(tuple, IV.token_places(docs.where("doc_id = 2")).collect())) == [(2, 0, 0, 1), (2, 1, 1, 2), (2, 2, 3, 24), (2, 3, 24, 25)]


def test_abbreviations_in_one_pass(spark):
    """The dots that two passes of the SQL's pattern find, by one: both read every text to be split into sentences."""
    r = random.Random(11)
    pieces = ["v", "vs", "Mr", "Mrs", "Art", "No", "A", "B", "I", "xA", "é", "É", "7", "s", "😀", "", ".", ".", ".", ".", ".", " ", " ", "\n", "!", " ", "-"]
    rows = [("".join(r.choices(pieces, k=r.randrange(30))),) for _ in range(3000)] + [(None,), ("",), ("I.P.C. A.B.C.D. v. vs.",), ("xI.P.",)]
    texts = spark.createDataFrame(rows, "t string")
    two = F.col("t")
    for _ in range(2):
        two = F.regexp_replace(two, X.ABBREVIATION_PATTERN, f"$1$2{X.GUARD}")
    one = X.guard_abbreviations("t")
    assert texts.where(~one.eqNullSafe(two)).count() == 0
    assert texts.where(one.contains(X.GUARD)).count() > 1000
    assert str(one).count("regexp_replace") == 1
