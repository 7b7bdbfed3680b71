"""Expert annotations → masks: literal inputs, brute-force expected values."""

import random
import re
import time

import regex
from pyspark.sql import functions as F

from casegrain.functions.text import TOKEN_PATTERN
from casegrain.operators import annotations as A

TEXT = "Alpha beta. Gamma (delta)! Alpha beta. Costs $5 \\E here."
ANN = {
    "expert_1": '{"rank1": ["Alpha beta."], "rank2": "[\'Gamma (delta)!\']"}',
    "expert_2": "{'rank1': ['Costs $5 \\\\E here.', None]}",
    "expert_3": "('a', 'b')",
    "expert_4": "not parseable {",
    "expert_5": '{"rank9": ["Alpha beta."]}',
}


def _df(spark, text=TEXT, ann=ANN):
    cols = ["doc_id", "text"] + list(ann)
    return spark.createDataFrame([(1, text, *ann.values())], ",".join(
        ["doc_id long", "text string"] + [f"{c} string" for c in ann]))


def brute_mask(text, chosen, limit=510):
    """The reference algorithm: token offsets, all literal occurrences, overlap test."""
    toks = [(m.start(), m.end()) for m in regex.finditer(TOKEN_PATTERN, text)][:limit]
    offsets = [(0, 0)] + toks + [(0, 0)]
    mask = [0] * (limit + 2)
    sents = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", text)]
    for s in sents:
        if s and s in chosen:
            for m in re.finditer(re.escape(s), text):
                for i, (a, b) in enumerate(offsets):
                    if (a, b) != (0, 0) and not (b <= m.start() or a >= m.end()):
                        mask[i] = 1
    return mask


def test_parse_formats_and_rejects(spark):
    df = _df(spark)
    rows = {(r.expert, r.rank, r.sentence) for r in A.annotation_rows(df).collect()}
    assert rows == {(1, "rank1", "Alpha beta."), (1, "rank2", "Gamma (delta)!"),
                    (2, "rank1", "Costs $5 \\E here.")}
    assert A.annotation_rejects(df).first()[0] == 2
    got = set(A.with_rationale_sentences(df).first()["rationale_sentences"])
    assert got == {"Alpha beta.", "Gamma (delta)!", "Costs $5 \\E here."}


def test_spans_with_metacharacters(spark):
    df = A.with_spans(A.with_matched_sentences(A.with_rationale_sentences(_df(spark))))
    spans = sorted((s.sentence, s.start, s.end) for s in df.first()["spans"])
    expected = sorted((s, m.start(), m.end()) for s in ["Alpha beta.", "Gamma (delta)!", "Costs $5 \\E here."]
                      for m in re.finditer(re.escape(s), TEXT))
    assert spans == expected
    assert [x for x in spans if x[0] == "Alpha beta."] == [("Alpha beta.", 0, 11), ("Alpha beta.", 27, 38)]


def test_mask_matches_reference_algorithm(spark):
    m = A.rationale_masks(_df(spark)).first()
    chosen = {"Alpha beta.", "Gamma (delta)!", "Costs $5 \\E here."}
    assert m["rationale_mask"] == brute_mask(TEXT, chosen)
    assert len(m["rationale_mask"]) == 512
    assert m["n_positive"] == sum(m["rationale_mask"]) <= m["n_active"] - 2


def test_whole_text_in_windows(spark):
    """2,000 tokens marked at both ends and over a window border: every token is in one window."""
    filler = " ".join(f"w{i}" for i in range(500))
    text = "Start here. " + filler + ". Over the border it goes. " + " ".join(f"x{i}" for i in range(1500)) + ". Late sentence."
    ann = {"expert_1": '{"rank1": ["Start here.", "Late sentence.", "Over the border it goes."]}'}
    rows = A.rationale_masks(_df(spark, text, ann)).orderBy("window_no").collect()
    n = len(regex.findall(TOKEN_PATTERN, text))
    assert [r["window_no"] for r in rows] == list(range(-(-n // 510)))
    assert sum(r["n_active"] - 2 for r in rows) == n
    whole = [x for r in rows for x in r["rationale_mask"][1:r["n_active"] - 1]]
    assert whole == brute_mask(text, {"Start here.", "Late sentence.", "Over the border it goes."}, n)[1:-1]
    assert sum(whole) == sum(r["n_positive"] for r in rows) == 3 + 6 + 3
    assert rows[0]["n_positive"] > 3 and rows[-1]["rationale_mask"][rows[-1]["n_active"] - 2] == 1


def test_quoted_none_stays(spark):
    text = "None of the parties appeared. Nothing else."
    ann = {"expert_1": "{'rank1': ['None of the parties appeared.', None]}", "expert_2": '{"rank2": "[\'Nothing else.\', None]"}'}
    got = A.with_rationale_sentences(_df(spark, text, ann)).first()["rationale_sentences"]
    assert set(got) == {"None of the parties appeared.", "Nothing else."}


def test_foreign_sentences_do_not_match(spark):
    ann = {"expert_1": '{"rank1": ["Alpha beta.", "A sentence of another document."]}'}
    m = A.with_matched_sentences(A.with_rationale_sentences(_df(spark, ann=ann))).first()
    assert m["matched_sentences"] == ["Alpha beta."] and len(m["rationale_sentences"]) == 2


def test_abbreviations_end_no_sentence(spark):
    from casegrain.functions.text import sentences
    df = spark.createDataFrame([("State v. Sharma was cited. Under the I.P.C. it fails! Mr. Rao left.",)], "t string")
    assert df.select(sentences("t")).first()[0] == ["State v. Sharma was cited.", "Under the I.P.C. it fails!", "Mr. Rao left."]


def test_no_annotations_zero_mask(spark):
    m = A.rationale_masks(_df(spark, "Nothing chosen.", {"expert_1": None})).first()
    assert m["rationale_mask"] == [0] * 512 and m["n_active"] == 5  # 3 tokens + start + end


def test_class_weights_edge_cases(spark):
    none = spark.createDataFrame([(0, 10), (0, 12)], "n_positive long, n_active long")
    w = A.class_weights(none).first()
    assert (w["weight_negative"], w["weight_positive"]) == (1.0, 1.0)
    some = spark.createDataFrame([(256, 300)], "n_positive long, n_active long")
    w = A.class_weights(some).first()
    assert w["weight_positive"] == 1.0 and w["weight_negative"] == 1.0  # 512/(2*256)
    assert abs(w["weight_positive"] * 256 + w["weight_negative"] * 256 - 512) < 1e-9
    allpos = spark.createDataFrame([(512, 512)], "n_positive long, n_active long")
    w = A.class_weights(allpos).first()
    assert w["weight_negative"] == 1.0 and w["weight_positive"] == 0.5
    empty = spark.createDataFrame([], "n_positive long, n_active long")
    c = A.coverage(empty).first()
    assert c["coverage_padded"] == 0.0 and c["n_windows"] == 0


def test_occurrences_equal_find():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choices("ab .é😀", k=r.randrange(40)))
        sents = ["".join(r.choices("ab .é😀", k=r.randrange(1, 4))) for _ in range(4)]
        want = []
        for s in set(sents):
            at = text.find(s)
            while at >= 0:
                want.append((s, at, at + len(s)))
                at = text.find(s, at + len(s))
        assert sorted(A.occurrences(text, [*sents, ""])) == sorted(want)
    assert A.occurrences(None, ["a"]) == [] and A.occurrences("a", None) == []


def test_masks_stay_linear():
    """One text of 4,000 and one of 16,000 sentences, a third of them chosen: about four times the time."""
    took = []
    for n in (4_000, 16_000):
        sents = [f"Sentence number {i} of the text has some words." for i in range(n)]
        text = " ".join(sents)
        began = time.time()
        starts, ends, mark = A.marked_tokens(text, sents[::3])
        took.append(time.time() - began)
        assert len(mark) == 10 * n and mark.sum() == 10 * len(sents[::3])
    assert took[1] < 8 * max(took[0], 0.05)
