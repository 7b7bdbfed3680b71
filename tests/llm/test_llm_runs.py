"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from casegrain.llm import periodic_runs, queries


def brute_runs(w):
    found, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                s, length = i, j - i + q
                part = w[s:s + length]
                if length >= max(24, 3 * q) and all(any(part[x] != part[x + r] for x in range(length - r)) for r in range(1, q)):
                    found.append((s, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(r, n, alphabet, runs):
    w = r.choices(alphabet, k=n)
    for _ in range(runs):
        q = r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40])
        unit = r.choices(alphabet, k=q)
        length = r.randrange(max(1, 2 * q), max(30, 5 * q))
        at = r.randrange(len(w) + 1)
        w[at:at] = (unit * (length // q + 1))[:length]
    return w


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    w = planted(r, r.randrange(60), r.choice(["ab", "abc", "abcdefgh", [f"w{i}" for i in range(90)]]), r.randrange(6))
    got = periodic_runs.find_runs(np.array([hash(x) % 1009 for x in w], np.int64) if w else np.zeros(0, np.int64))
    assert got == brute_runs([hash(x) % 1009 for x in w])


def test_hard_sequences():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(300))
    for s in (fib[-1], thue, "a" * 300, "ab" * 90 + "a" + "ba" * 90, ("a" * 23 + "b") * 6, (thue[:50] * 2 + "c") * 4):
        assert periodic_runs.find_runs(np.array([ord(c) for c in s])) == brute_runs(s)


def test_one_word_a_million_times_stays_linear():
    assert periodic_runs.find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    unit = np.arange(100_000)
    assert periodic_runs.find_runs(np.concatenate([unit] * 4)[:-5]) == [(0, 399_995, 100_000)]


def plain(doc_id, text):
    """A row of the query, word for word by the contract."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_the_contract(spark, tmp_path):
    r = random.Random(3)
    seps = [" ", "  ", "\n", "\t ", "\x0b", "\r\n"]
    docs = []
    for d in range(120):
        w = planted(r, r.randrange(200), ["é", "b c", " ", "x", *[f"w{i}" for i in range(40)]], r.randrange(3))
        docs.append((d, "".join(x + r.choice(seps) for x in w)))
    docs += [(500, None), (501, ""), (502, " \n "), (7, docs[7][1]), (7, "other words"), (None, "a b " * 20), (503, "long " * 30000)]
    spark.createDataFrame([(*x, "e", 1, 2) for x in docs], "doc_id long, text string, runs string, n_words int, collapsed int").write.parquet(
        f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(x) for x in queries.op12_periodic_runs(spark, str(tmp_path)).select(cols).collect()]
    short = [x for x in docs if x[0] != 503]
    assert sorted((x for x in got if x[0] != 503), key=str) == sorted((plain(*x) for x in short), key=str)
    long = next(x for x in got if x[0] == 503)
    assert long[1:6] == (1, 0, 30000, 1, 30_000_000)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs if d is not None) > 5


def test_empty_table_and_small_limits(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(none, least=5)
