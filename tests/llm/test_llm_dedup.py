"""N-gram Jaccard join, components and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain.llm import line_dedup, ngram_jaccard
from casegrain.llm.components import components


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(d, grams(t)) for d, t in docs]
    top = {d: d for d, _ in sets if d is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, z in sets[:i]:
            if a is not None and b is not None and s and z and 100 * len(s & z) >= 80 * len(s | z):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def near_corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    base = [r.choices(vocabulary, k=k) for k in (4, 5, 8, 9, 13, 30, 90, 300)]
    docs = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            k = r.randrange(len(w))
            w[k:k + r.choice([0, 1])] = r.choices(vocabulary, k=r.choice([0, 1]))
        if r.random() < 0.3:
            w = w + passage
        docs.append((r.randrange(10 ** 9), " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return docs


@pytest.mark.parametrize("seed,frequent", [(1, 64), (2, 3), (3, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_jaccard, "FREQUENT_LEAST", frequent)   # many frequent n-grams: other entries, same result
    docs = near_corpus(seed) + [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "One TWO"), (None, "one two")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component string")
    got = sorted((tuple(r) for r in ngram_jaccard.join(df).collect()), key=str)
    assert got == brute(docs)


def test_exact_boundary_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(12)]                     # 8 n-grams; one more word: 9, and 8 / 9 >= 0.8
    docs = [(1, " ".join(w)), (2, " ".join(w + ["z"])), (3, " ".join(w + ["z", "y"])), (4, " ".join(w[:4])),
            (1, " ".join(w)), (9, "other text of some words here"), (9, " ".join(w))]
    rows = ngram_jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["component_id"]) for r in rows}
    assert len(rows) == len(docs) and got == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 1)}


def test_every_text_of_a_repeated_smaller_id_is_compared(spark):
    docs = []
    for k in range(12):                                  # the matching text of the smaller id first, then last
        w = [f"w{k}x{i}" for i in range(12)]
        own = [(2 * k, " ".join(w)), (2 * k, " ".join(f"o{k}x{i}" for i in range(12)))]
        docs += own[::1 if k % 2 else -1] + [(2 * k + 1, " ".join(w + ["z"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(12)], "a long, b long")
    assert sorted(r["common"] for r in ngram_jaccard.verify(pairs, df).collect()) == [0] * 12 + [8] * 12
    got = {(r["doc_id"], r["component_id"]) for r in ngram_jaccard.join(df).collect()}
    assert got == {(2 * k + i, 2 * k) for k in range(12) for i in (0, 1)}


def test_join_of_nothing(spark):
    assert ngram_jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_is_complete():
    """Sets over the threshold share an entry, whatever is called frequent."""
    r = np.random.default_rng(7)
    seen = 0
    for _ in range(4000):
        n = int(r.choice([r.integers(1, 12), r.integers(4, 40), r.integers(20, 300)]))
        base = np.unique(r.integers(0, 2 ** 63, size=2 * n, dtype=np.uint64))
        a, d = base[:n], int(r.integers(0, max(1, n // 4) + 1))
        k = int(r.integers(0, d + 1))
        b = np.sort(np.concatenate((r.permutation(a)[:max(1, n - k)], base[n:n + d - k])))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        seen += 1
        often = np.sort(base[r.random(len(base)) < r.choice([0, 0.3, 0.6, 0.9, 1.0])])
        assert len(np.intersect1d(ngram_jaccard.index_entries(a, often), ngram_jaccard.index_entries(b, often)))
    assert seen > 1000


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (70, 70), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_automaton(spark, edits):
    from pyspark.sql import functions as F

    r = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("é😀x", "é😀")]
    for _ in range(300):
        a = "".join(r.choices("abé", k=r.randrange(14)))
        b = list(a)
        for _ in range(r.randrange(edits + 3)):
            k = r.randrange(len(b) + 1)
            b[k:k + r.choice([0, 1])] = r.choices("abé", k=r.choice([0, 1]))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.withColumn("ok", line_dedup.within_edits(F.col("a"), F.col("b"), edits)).collect():
        assert row["ok"] == (distance(row["a"], row["b"]) <= edits), row


def brute_lines(docs, edits=2, least=20, near=40):
    ws = " \t\n\x0b\x0c\r"
    rows = sorted({(d is not None, d or 0, i, x.strip(ws)) for d, t in docs if t is not None
                   for i, x in enumerate(t.split("\n")) if len(x.strip(ws)) >= least})
    first, gone = {}, set()
    for has, d, i, x in rows:
        if x in first:
            gone.add((d if has else None, i))
        else:
            first[x] = (has, d, i)
    lines = [(p, x) for x, p in first.items() if len(x) >= near]
    for p, x in lines:
        if any(q < p and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for q, y in lines):
            gone.add((p[1] if p[0] else None, p[2]))
    return gone


def line_corpus(seed):
    r = random.Random(seed)
    lines = ["".join(r.choices("abcd éß", k=k)) for k in (10, 25, 41, 42, 60, 61, 90, 200)] + ["", "   "]
    docs = []
    for i in range(40):
        own = []
        for _ in range(r.randrange(6)):
            x = list(r.choice(lines))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(x) + 1)
                x[k:k + r.choice([0, 1])] = r.choices("abcdé", k=r.choice([0, 1]))
            own.append(r.choice(["", " ", "\t"]) + "".join(x))
        docs.append((i if i else None, "\n".join(own)))
    return docs + [(50, None), (51, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    docs = line_corpus(seed)
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, near string")
    gone = brute_lines(docs)
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate(df).collect()}
    assert {(d, i) for d, r in rows.items() for i in r["dropped"]} == gone
    for d, t in docs:
        r = rows[d]
        assert r["near"] == "q" and r["n_exact"] + r["n_near"] == len(r["dropped"])
        if t is None:
            assert r["text"] is None and r["n_lines"] == 0 and not r["emptied"]
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        assert r["text"] == "\n".join(kept) and r["n_lines"] == len(t.split("\n"))
        assert r["emptied"] == (bool(r["dropped"]) and not "".join(kept).strip())


def test_lines_of_nothing_and_of_long_rows(spark):
    assert line_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    many = "\n".join(f"line number {i % 3000} of a rather long text" for i in range(9000))
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate(
        spark.createDataFrame([(1, many), (2, "x" * 300000)], "doc_id long, text string"), near_chars=10 ** 6).collect()}
    assert rows[1]["n_exact"] == 6000 and rows[2]["dropped"] == []


def test_native_plans(spark):
    """No Python in the plan of the line operator."""
    df = spark.createDataFrame([(1, "x" * 50), (2, "x" * 50)], "doc_id long, text string")
    plan = line_dedup.deduplicate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_deduplicate_replaces_columns_of_its_own_names(spark):
    long = "a line that is long enough to be kept once"
    df = spark.createDataFrame([(1, long, "x", 7), (2, long + "\nshort", "y", 8)], "doc_id long, text string, dropped string, n_exact int")
    df = df.withColumns({"n_near": F.lit("z"), "emptied": F.lit(1), "n_lines": F.lit("q")})
    out = {r["doc_id"]: r for r in line_dedup.deduplicate(df).collect()}
    assert out[1]["dropped"] == [] and out[2]["dropped"] == [0] and out[2]["n_exact"] == 1 and out[2]["text"] == "short"
    assert out[2]["n_lines"] == 2 and out[2]["emptied"] is False
