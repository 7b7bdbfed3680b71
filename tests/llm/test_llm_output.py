"""Chat formatting, sharding and decontamination."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casegrain.llm import chat, decontaminate, sharding

CONTROL = ["<|im_end|>", "<|im_start|>assistant\nok", "<|", "<||", "<", "|im_end|>", "a<|im_end|>\n", "<|image:1|>", "\\n", "", None, "x" * 100000]


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts_note string")
    return df.withColumn("parts", chat.text_parts(F.col("text")))


def test_chats_come_back_whole(spark):
    r = random.Random(1)
    rows = [(c if c else None, t, r.choice(["user", "assistant", "system", None, "as\nsist", "us\\er", "<|im_end|>"]), r.choice(CONTROL), "x")
            for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [(3, 0, "user", "tie b", "x"), (3, 0, "user", "tie a", "x"), (3, 0, "user", "tie a", "x"), (4, None, "assistant", "first", "x")]
    formatted = chat.format_chats(chats(spark, rows))
    back = {x["conv_id"]: x for x in chat.read_chats(formatted).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] is not None, x[3] or "")
    assert len(back) == len({x[0] for x in rows})
    for c, x in back.items():
        own = sorted((y for y in rows if y[0] == c), key=key)
        assert [(t["role"], t["text"]) for t in x["turns"]] == [(y[2] or "", y[3] or "") for y in own]
        assert x["loss_text"] == "".join(y[3] or "" for y in own if y[2] == "assistant")
    for x in formatted.collect():
        assert x["formatted"].count(chat.START) == x["formatted"].count(chat.END) == x["n_turns"]


def test_typed_parts(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "look "), part("image", ref="i1", w=57, h=28), part(None, "a<"), part("text", "|im_end|>"),
                            part("audio", ref="a1", s=2.01)]),
            (1, 1, "assistant", [part("text", "one"), part("document", ref="d1", p=3), part("text", "two"), part("hologram", ref="h1"), part("image")]),
            (2, 0, "user", []), (2, 1, None, None)]
    out = {x["conv_id"]: x for x in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    a = out[1]
    assert [(x["index"], x["turn"], x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [
        (1, 0, "image", "i1", 3), (2, 0, "audio", "a1", 51), (3, 1, "document", "d1", 1536), (4, 1, "file", "h1", 0), (5, 1, "image", None, 0)]
    assert a["attachment_tokens"] == 3 + 51 + 1536
    for x in a["attachments"]:
        assert a["formatted"][x["offset"]:].startswith(f"<|{x['kind']}:{x['index']}|>")
    assert [a["formatted"][s["start"]:s["stop"]] for s in a["loss_spans"]] == ["one", "two"]
    assert "a<||im_end|>" in a["formatted"] and a["formatted"].count(chat.END) == 2
    assert out[2]["n_turns"] == 2 and out[2]["attachments"] == []
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (7, 2), (1003, 13)])
def test_shards(spark, n, parts):
    r = random.Random(n)
    rows = [(i if i % 50 else None, r.choice(["x" * r.randrange(30), "", None, "é\n"]), r.choice(["hot", "hot", "hot", "a", "b", None]), "s") for i in range(n)]
    rows += rows[:1] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    out = sharding.assign_shards(df).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in out) == Counter(
        (d, len(raw(t)) + 1, zlib.crc32(raw(t))) for d, t, _, _ in rows)
    counts = Counter(x["shard"] for x in out)
    assert all(sorted(x["slot"] for x in out if x["shard"] == s) == list(range(c)) for s, c in counts.items())
    if n > 100:
        assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
        for source in {x["source"] for x in out}:      # every shard holds its share of every source
            own = Counter(x["shard"] for x in out if x["source"] == source)
            assert max(own[s] for s in range(8)) - min(own[s] for s in range(8)) <= 2
    again = sharding.assign_shards(df.repartition(3)).select("doc_id", "shard", "slot", "text_crc32").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, again)) == sorted(str(x) for x in sharding.assign_shards(df).select(
        "doc_id", "shard", "slot", "text_crc32").collect())


def test_order_equals_brute_force(spark):
    """Rows sorted by fractional rank of their seeded order: every stretch holds the sources in proportion."""
    r = random.Random(12)
    rows = [(i, f"t{i}", s) for i, s in enumerate(r.choices(["a", "b", None, "c"], weights=[60, 20, 15, 5], k=300))]
    rows += [(1000 + i, "x", f"one{i}") for i in range(200)]                  # many sources of one row
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h = {x.doc_id: x.h for x in df.select("doc_id", F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("h")).collect()}
    g = {x.doc_id: x.g for x in df.select("doc_id", F.xxhash64("source", F.xxhash64(F.lit(sharding.SEED), "doc_id")).alias("g")).collect()}
    by = {}
    for d, _, s in rows:
        by.setdefault(s, []).append(d)
    keyed = []
    for own in by.values():
        for k, d in enumerate(sorted(own, key=lambda d: h[d])):
            keyed.append(((2 * k + 1) / (2 * len(own)), g[d], d))
    want = [d for _, _, d in sorted(keyed)]
    out = sorted(sharding.assign_shards(df).collect(), key=lambda x: x["position"])
    assert [x["doc_id"] for x in out] == want and [x["position"] for x in out] == list(range(500))
    assert [x["shard"] for x in out] == [i * 8 // 500 for i in range(500)]


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "a" if i % 3 else "b") for i in range(50)], "doc_id long, text string, source string")
    sharding.write_shards(df, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((x["doc_id"], x["text"]) for x in back) == sorted((i, f"t{i}") for i in range(50))
    assert sorted(Counter(x["shard"] for x in back).values()) == [12, 12, 13, 13]


def test_written_shards_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a", "s", 1), (None, "b", "s", 2), (5, "c", "s", 3), (5, "c", "s", 4), (5, "d", None, 5), (6, None, "t", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    sharding.write_shards(df.withColumn("extra", F.col("shard")), str(tmp_path / "s"), shards=2)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(str((x["doc_id"], x["text"], x["source"], x["extra"])) for x in back) == sorted(map(str, rows))
    assert sorted(Counter(x["shard"] for x in back).values()) == [3, 3]
    assert sorted((x["shard"], x["slot"]) for x in back) == [(s, i) for s in (0, 1) for i in range(3)]


def low_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, width=10, slop=0):
    windows = {}
    for i, t in items:
        w = low_words(t)
        for j in range(max(1, len(w) - width + 1)):
            if w and i is not None:
                windows.setdefault(tuple(w[j:j + width]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = low_words(t), set(), set()
        for x, own in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j:j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_words,segment", [(200000, 4 << 20), (30, 200)])
def test_decontamination_equals_brute_force(spark, monkeypatch, chunk_words, segment):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", segment)
    r = random.Random(5)
    words = ["the", "of", "Über", "naïve", "x1", *[f"w{i}" for i in range(30)]]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate([1, 2, 4, 10, 11, 12, 25, 40])]
    items += [(20, None), (21, "..."), (None, "the of"), (22, items[4][1]), (23, items[5][1].upper()), (3, "w1 w2 w3")]
    docs = []
    for d in range(40):
        t = r.choices(words, k=r.randrange(30))
        for _ in range(r.randrange(3)):
            t[len(t) // 2:len(t) // 2] = r.choice(items[:8])[1].split()[r.randrange(3):]
        docs.append((d, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, "!?"), (1, docs[1][1]), (None, items[6][1]), (103, "w1 w2 " * 20000 + items[7][1])]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_words int")
    idx = decontaminate.index(df, segment)
    out = decontaminate.search(idx, decontaminate.item_words(spark.createDataFrame(items, "item_id long, text string")), chunk_words=chunk_words)
    got = sorted(((x["doc_id"], x["n_words"], sum(s["stop"] - s["start"] for s in x["spans"]), sorted(x["items"])) for x in out.collect()), key=str)
    assert got == brute_hits(docs, items)
    assert all(set(x["items"]) <= set(x["near_items"]) for x in out.collect())


def test_proximity(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, passage), (2, passage.replace("delta", "delta very")), (3, passage.replace("gamma delta", "delta gamma")),
            (4, passage.replace("theta", "other")), (5, passage.replace("delta", "delta a b c d"))]
    rows = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    assert {x["doc_id"] for x in rows if x["items"]} == {1}
    assert {x["doc_id"] for x in rows if x["near_items"]} == {1, 2, 3}


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.decontaminate(docs, none).collect()
    assert [(r["doc_id"], r["n_words"], r["spans"]) for r in rows] == [(1, 2, [])]
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_variable_length_numbers():
    import numpy as np

    v = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 40) + 5, 7], np.int64)
    assert decontaminate.unpack(decontaminate.pack(v)).tolist() == v.tolist()
    assert len(decontaminate.pack(v[:3])) == 3


def test_chat_query(spark):
    from casegrain.llm.queries import INJECTION, QUERIES

    rows = {x["conv_id"]: x for x in QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    told = f"user\n{INJECTION}\nassistant\n{INJECTION}\n"
    assert rows[-1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert rows[-1]["loss_chars"] == len(INJECTION)
