"""Summary metrics against brute force; the driver contract."""

import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from casegrain.operators import evaluation as EV
from casegrain.operators import summarize as SU


def lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_lcs_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        rows.append((str(k), a, b))
    df = spark.createDataFrame(rows, "pair string, cand array<string>, ref array<string>")
    got = {r.pair: r.lcs for r in EV.rouge_l(df, "pair", "cand", "ref").collect()}
    assert got == {k: lcs(a, b) for k, a, b in rows}


def test_rouge_n_and_bleu_literal(spark):
    df = spark.createDataFrame([("p", ["the", "cat", "the", "cat"], ["the", "cat", "sat"]), ("q", ["x"], [])],
                               "pair string, cand array<string>, ref array<string>")
    r = {(x.pair, x.n): x for x in EV.rouge_n(df, "pair", "cand", "ref").collect()}
    assert (r[("p", 1)].overlap, r[("p", 1)].cand_grams, r[("p", 1)].ref_grams) == (2, 4, 3)
    assert (r[("p", 2)].overlap, r[("p", 2)].cand_grams) == (1, 3)
    assert r[("q", 1)].f1 == 0.0 and r[("q", 2)].cand_grams == 0
    b = EV.corpus_bleu(df, "pair", "cand", "ref").first()
    assert b.bleu == 0.0  # no 3-gram overlap


def test_span_prf(spark):
    pred = spark.createDataFrame([(1, "A", 0, 3), (1, "B", 5, 6)], "doc_id long, type string, start long, end long")
    gold = spark.createDataFrame([(1, "A", 0, 3), (1, "A", 7, 9)], "doc_id long, type string, start long, end long")
    got = {r.type: (r.tp, r.fp, r.fn, r.f1) for r in EV.span_prf(pred, gold).collect()}
    assert got["ALL"] == (1, 1, 1, 0.5) and got["A"][:3] == (1, 0, 1) and got["B"][:3] == (0, 1, 0)


def test_entry_and_contract(spark):
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0].n_windows >= 200 and 0.0 <= r[0].coverage_padded <= r[0].coverage_active <= 1.0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_overlaps_are_counted_in_the_row_and_shared_keys_together(spark):
    rows = [("a", ["x", "y", "x"], ["x", "x", "z"]), ("b", ["p"], ["q"]), ("b", ["q"], ["p"]), (None, ["x"], ["x"]),
            ("c", None, ["x"]), ("d", ["x", None, "y"], ["x", None, "y"])]
    pairs = spark.createDataFrame(rows, "pair string, c array<string>, r array<string>")
    got = EV.clipped_overlap(pairs, "pair", "c", "r", (1, 2))
    found = sorted(((r["pair"] or "", r["n"], r["overlap"], r["cand_grams"], r["ref_grams"]) for r in got.collect()))
    want = sorted(((r["pair"] or "", r["n"], r["overlap"], r["cand_grams"], r["ref_grams"]) for r in _by_join(pairs).collect()))
    assert found == want
    assert ("a", 1, 2, 3, 3) in found and ("b", 1, 2, 1, 1) in found
    # No gram of a pair with a key of its own is exploded: the only generators are those of shared keys and of the sizes.
    own = EV._row_overlap(pairs.where("pair = 'a'"), "pair", "c", "r", (1, 2))
    assert "Generate" not in own._jdf.queryExecution().executedPlan().toString()


def _by_join(pairs):
    sizes = pairs.select("pair", F.explode(F.array(*[F.struct(
        F.lit(n).cast("bigint").alias("n"), F.greatest(F.size("c") - n + 1, F.lit(0)).cast("bigint").alias("cand_grams"),
        F.greatest(F.size("r") - n + 1, F.lit(0)).cast("bigint").alias("ref_grams")) for n in (1, 2)])).alias("s")).select("pair", "s.*")
    return sizes.join(EV._joined_overlap(pairs, "pair", "c", "r", (1, 2)), ["pair", "n"], "left").fillna(0, ["overlap"])


def test_sentence_scores_with_rare_tokens_joined_equal_those_with_all_held(spark):
    rows = [(1, "One two three. Two three four!"), (1, "Three ΣΑΣ five. İx two six"), (2, "two six six. ab"), (None, "two nine ten. two"),
            (None, "nine"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {tuple(r) for r in SU.sentence_scores(docs).collect()}
    assert held == {tuple(r) for r in SU.sentence_scores(docs, frequent=2).collect()}
    # df counts documents: both rows of id 1 are one, those without an id one.
    idf = lambda df: math.log((len(rows) + 1) / (df + 1))
    score = (idf(3) + 2 * (2 * idf(2)) + idf(3)) / 4
    assert (2, 0, "two six six.", 4, round(score, 9)) in held
    assert {r[0] for r in held} == {1, 2}
