"""The prefix trie against plain prefixes, with partitions of few rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from casegrain.llm import prefix_trie, queries


def brute(seqs):
    """Rows of the query for {conv_id: list of (role, text)}; a conversation may be listed twice."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, w in seqs:
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
        ends[tuple(w)].append(c)
    rows = []
    for v, own in members.items():
        below = [u for u in members if u[:len(v)] == v]
        kids = [u for u in below if len(u) == len(v) + 1]
        leaves = [u for u in below if not any(x[:-1] == u and x for x in members)]
        rows.append((min(own), len(v), min(members[v[:-1]]) if v else None, len(own), len(kids), len(leaves),
                     sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u),
                     hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()))
    return sorted(rows, key=str)


def conversations(r, n, texts, longest):
    rows = []
    for c in range(n):
        rows += [(c, t, r.choice(["user", "assistant"]) if r.random() < .1 else ["user", "assistant"][t % 2], r.choice(texts))
                 for t in range(r.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("seed,n,texts,longest,parts", [
    (1, 60, ["a", "bb"], 6, 4), (2, 60, ["a"], 4, 9), (3, 80, ["a", "bé😀", ""], 9, 22), (4, 40, [f"t{i}" for i in range(99)], 5, 7)])
def test_trie_equals_brute_force(spark, seed, n, texts, longest, parts):
    rows = conversations(random.Random(seed), n, texts, longest)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*x, "other", 3) for x in rows], "conv_id long, turn long, role string, text string, members string, depth int")
        out = prefix_trie.members_digest(*prefix_trie.prefix_trie(prefix_trie.turn_sequences(df)))
        got = sorted((tuple(x) for x in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seqs = defaultdict(list)
    for c, _, role, text in rows:
        seqs[c].append((role, text))
    assert out.columns == [*prefix_trie.NODE, "ends_sha256"]
    assert got == brute(list(seqs.items()))


def test_one_conversation_copied_over_partitions_and_a_long_one(spark):
    """The node that ends the copies lies in several partitions; its list is read part by part."""
    w = [{"key": hashlib.md5(str(i).encode()).hexdigest(), "weight": i} for i in range(300)]
    rows = [(i, w[:3]) for i in range(500)] + [(500, w), (501, w[:2]), (502, []), (503, None), (None, w[:1]), (7, w[:3])]
    seqs = spark.createDataFrame(rows, "conv_id long, steps array<struct<key:string,weight:long>>")
    nodes, chunks = prefix_trie.prefix_trie(seqs)
    assert chunks.where("depth = 3").count() >= 3 and nodes.where("split").count() == 3
    got = {(x["conv_id"], x["depth"]): x for x in prefix_trie.members_digest(nodes, chunks).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[(0, 3)]["ends_sha256"] == sha(sorted([*range(500), 7])) and got[(0, 3)]["n_convs"] == 502
    assert got[(0, 2)]["ends_sha256"] == sha([501]) and got[(0, 0)]["ends_sha256"] == sha([502, 503])
    assert (got[(0, 0)]["n_convs"], got[(0, 0)]["n_leaves"], got[(0, 0)]["n_children"]) == (505, 1, 1)
    assert got[(0, 0)]["saved_tokens"] == 502 * 1 + 501 * 2 and len(got) == 301
    assert got[(500, 300)]["parent_conv_id"] == 500 and got[(500, 4)]["parent_conv_id"] == 0


def test_rebuilt_conversations_of_the_query(spark, tmp_path):
    r = random.Random(9)
    rows = [(c + 100 * b, t, "u", r.choice("ab")) for b in (0, 1, 3) for c in r.sample(range(1, 100), 20) + [0] for t in range(r.randrange(1, 8))]
    rows += [(250, None, None, "first"), (250, 0, "u", None), (250, 0, "u", None), (None, 1, "u", "x"), (-7, 1, "u", "x")]
    rows = [x for x in rows if x[0] != 300]
    spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, base int").write.parquet(f"{tmp_path}/conversations.parquet")
    seqs = defaultdict(list)
    for c, t, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        seqs[c].append((role or "", text or ""))
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    base = lambda c: c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
    rebuilt = [(c, seqs.get(base(c), [])[:h(c)] + w[h(c):]) for c, w in seqs.items()]
    got = sorted((tuple(x) for x in queries.op11_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rebuilt)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_prefix_trie(spark, str(tmp_path)).count() == 0


def test_forest_merges_deepest_first():
    f = prefix_trie.forest([b"a" * 16, b"a" * 16 + b"b" * 16, b"a" * 16 + b"c" * 32, b"d" * 16])
    assert f.depth == [1, 2, 3, 1, 0] and f.parent == [4, 0, 0, 4, -1] and f.root == 4
    g = prefix_trie.forest([b"", b"x" * 16])
    assert g.depth == [0, 1] and g.parent == [-1, 0] and g.root == 0
