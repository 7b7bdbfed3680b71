"""Tokens, offsets, windows, vocabulary, sub-words, ordinals."""

import random

import regex
from pyspark.sql import functions as F

from casegrain.functions.ordinal import exact_ordinal, running_total
from casegrain.functions.text import TILE_PATTERN, TOKEN_PATTERN, tiles
from casegrain.operators import tokens as TK
from casegrain.operators.sampling import minibatch_assign, mlm_mask, train_val_split

TEXTS = ["Hello, world!  It's 2024.\n\tNew line", "", "Ünïcode straße — ok", "a" * 3]


def test_tiles_concatenate_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in df.select("text", F.array_join(tiles("text"), "").alias("j")).collect():
        assert r.j == r.text


def test_offsets_match_regex(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {(r.doc_id, r.pos): (r.token, r.start, r.end) for r in TK.token_offsets(df).collect()}
    exp = {}
    for i, t in enumerate(TEXTS):
        for p, m in enumerate(regex.finditer(TOKEN_PATTERN, t)):
            exp[(i, p)] = (m.group().lower(), m.start(), m.end())
    assert got == exp


def test_window_encoding(spark):
    docs = spark.createDataFrame([(1, "b a b c " * 300), (2, ""), (3, "a z")], "doc_id long, text string")
    vocab = TK.build_vocab(docs.filter("doc_id = 1"))
    v = {r.token: r.token_id for r in vocab.collect()}
    assert v == {"b": 1000, "a": 1001, "c": 1002}
    rows = TK.encode_window(docs, vocab, offsets=True).collect()
    assert sorted((r.doc_id, r.window_no, r.n_tokens) for r in rows) == [(1, 0, 510), (1, 1, 510), (1, 2, 180), (2, 0, 0), (3, 0, 2)]
    assert [x.start for r in sorted(rows, key=lambda r: r.window_no) if r.doc_id == 1 for x in r.offset_mapping] == list(range(0, 2400, 2))
    enc = {r.doc_id: r for r in rows if r.window_no == 0}
    assert len(enc[1].input_ids) == 512 and enc[1].input_ids[0] == 101 and enc[1].input_ids[511] == 102
    assert sum(enc[1].attention_mask) == 512
    assert enc[2].input_ids[:3] == [101, 102, 0] and sum(enc[2].attention_mask) == 2
    assert enc[3].input_ids[:4] == [101, 1001, 100, 102]


def test_subword_segmentation(spark):
    vocab = spark.createDataFrame([("con", 1000, 5), ("tract", 1001, 5), ("contra", 1002, 5)],
                                  "token string, token_id long, freq long")
    types = spark.createDataFrame([("contract",), ("xyz",), ("tractx",)], "token string")
    got = {r.token: r.pieces for r in TK.segment_rare(types, vocab).collect()}
    assert got == {"contract": ["contra", "##c", "##t"], "xyz": ["x", "##y", "##z"], "tractx": ["tract", "##x"]}


def brute_pieces(word, entries):
    out, at = [], 0
    while at < len(word):
        n = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in entries), 1)
        out.append((at, at + n))
        at += n
    return out


def test_pieces_equal_brute_force():
    r = random.Random(2)
    entries = {"".join(r.choices("abcé", k=r.randrange(1, 6))): 1000 + i for i in range(60)}
    entries = {e: 1000 + i for i, e in enumerate(entries)}
    known = TK.Pieces(entries)
    for _ in range(500):
        w = "".join(r.choices("abcéz", k=r.randrange(1, 15)))
        want = brute_pieces(w, entries)
        ids, at = known.encode(w)
        assert at == [a for a, _ in want]
        assert ids == [entries[w[a:b]] + (len(entries) if a else 0) if w[a:b] in entries else 100 for a, b in want]
    assert known.encode("z" * 20_000)[0] == [100] * 20_000


def test_pieces_are_the_ids(spark):
    """Words outside the vocabulary become pieces of its entries and letters; the pieces of a marked word are marked."""
    docs = spark.createDataFrame([(1, "con con tract tract xy"), (2, "Contract tracts, İx. yx q"), (3, "tract " * 300 + "contract " * 200)],
                                 "doc_id long, text string")
    train = docs.filter("doc_id = 1")
    vocab = TK.with_alphabet(TK.build_vocab(train), train)
    v = {r.token: r.token_id for r in vocab.collect()}
    assert v == {"con": 1000, "tract": 1001, "a": 1002, "c": 1003, "n": 1004, "o": 1005, "r": 1006, "t": 1007, "x": 1008, "y": 1009}
    rows = TK.encode_window(docs.withColumn("m", F.array(F.lit("Contract tracts,"))), vocab, offsets=True, marked="m").collect()
    two = next(r for r in rows if r.doc_id == 2)
    n = len(v)
    # contract: con + ##tract; tracts: tract + unknown s; the unknown comma; i, its dot above, x; full stop; y + ##x; q
    assert two.input_ids[1:1 + two.n_tokens] == [1000, 1001 + n, 1001, 100, 100, 100, 100, 1008 + n, 100, 1009, 1008 + n, 100]
    assert [(x.start, x.end) for x in two.offset_mapping] == [
        (0, 3), (3, 8), (9, 14), (14, 15), (15, 16), (17, 18), (18, 19), (19, 19), (19, 20), (21, 22), (22, 23), (24, 25)]
    assert two.rationale_mask[:8] == [0, 1, 1, 1, 1, 1, 0, 0] and sum(two.rationale_mask) == 5
    assert sorted((r.window_no, r.n_tokens) for r in rows if r.doc_id == 3) == [(0, 510), (1, 190)]


def test_exact_ordinal_and_running_total(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    r = exact_ordinal(df, ["k", "id"], out="rn", total_out="n", num_partitions=5)
    rows = sorted((x.k, x.rn, x.n) for x in r.collect())
    assert [x[1] for x in rows] == list(range(1, 1001)) and {x[2] for x in rows} == {1000}
    t = running_total(spark.range(1, 101).withColumn("v", F.col("id") * 1.0), "id", ["v"], num_partitions=4)
    got = {x.id: (x.cum_count, x.cum_v) for x in t.collect()}
    assert got[100] == (100, 5050.0) and got[10] == (10, 55.0)


def test_ordinals_and_split_with_payload(spark):
    """Payload columns don't change the numbers: one written table feeds counts and rows."""
    df = spark.range(0, 120_000, 1, 8).withColumn("k", F.md5(F.col("id").cast("string"))).withColumn("text", F.repeat(F.lit("x"), 40))
    r = exact_ordinal(df, ["k", "id"], out="rn", num_partitions=8)
    assert r.agg(F.countDistinct("rn"), F.min("rn"), F.max("rn")).first()[:] == (120_000, 1, 120_000)
    parts = train_val_split(df.withColumnRenamed("id", "doc_id")).groupBy("part").count().collect()
    assert {x.part: x["count"] for x in parts} == {"validation": 24_000, "train": 96_000}


def test_prefix_sums(spark):
    from casegrain.functions.arrays import prefix_sums
    data = [[], [5], [1, 2, 3], list(range(1000))]
    rows = spark.createDataFrame([(x,) for x in data], "a array<int>").select("a", prefix_sums("a").alias("p")).collect()
    for r in rows:
        assert r.p == [sum(r.a[:i]) for i in range(len(r.a))]


def test_split_sizes_batches_and_mask_determinism(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "doc_id")
    parts = train_val_split(df).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"validation": 21, "train": 80}
    b = minibatch_assign(df).groupBy("batch").count().collect()
    sizes = sorted(r["count"] for r in b)
    assert sizes.count(8) == 12 and sizes[0] == 5
    ids = spark.createDataFrame([(1, [101] + [2000] * 510 + [102])], "doc_id long, input_ids array<int>")
    a = mlm_mask(ids).first().masked_ids
    b2 = mlm_mask(ids.repartition(3)).first().masked_ids
    assert a == b2 and a[0] == 101 and a[511] == 102
    share = sum(1 for x in a if x == 103) / 510
    assert 0.10 < share < 0.20


def test_windows_are_yielded_in_bounded_batches(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i + j) % 9}" for j in range([0, 3, 510, 511, 40][i % 5]))) for i in range(60)] + [(None, None), (5, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.array(F.lit("w1"))).coalesce(1)
    vocab = spark.createDataFrame([(f"w{k}", 1000 + k) for k in range(8)] + [("w", 2000)], "token string, token_id long")
    whole = sorted(map(str, TK.encode_window(df, vocab, offsets=True, marked="m").collect()))
    monkeypatch.setattr(TK, "HELD_PIECES", 600)
    assert sorted(map(str, TK.encode_window(df, vocab, offsets=True, marked="m").collect())) == whole
    plain = TK.encode_window(df, vocab)
    assert plain.columns == ["doc_id", "window_no", "n_tokens", "input_ids", "attention_mask"] and plain.count() == len(whole)
