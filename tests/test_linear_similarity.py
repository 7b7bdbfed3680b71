"""Text operators on one long row, statute keys, summaries, near-duplicate search."""

import random
import time

from pyspark.sql import functions as F

from casegrain.operators import cleaning as CL
from casegrain.operators import legal as LG
from casegrain.operators import evaluation as EV
from casegrain.operators import similarity as SIM
from casegrain.operators import vectors as VE
from casegrain.operators import summarize as SU
from casegrain.session import materialize


def test_long_rows_stay_linear(spark):
    """One row of 40,000 lines, one of 8,000 citations, one of 5,000 headings."""
    lines = "\n".join(f"line {i % 20000} of the text" for i in range(40000))
    cites = " ".join(f"Section {i} of the Indian Contract Act is cited." for i in range(1, 8001))
    heads = "\n".join(f"SECTION {i}.  TITLE\nbody {i}" for i in range(5000))
    df = spark.createDataFrame([(1, lines), (2, cites), (3, heads)], "doc_id long, text string")
    began = time.time()
    clean = df.filter("doc_id = 1").select(CL.clean_text("text").alias("c")).first()["c"].split("\n")
    assert clean == [f"line {i} of the text" for i in range(20000)]
    found = LG.extract_citations(df.filter("doc_id = 2"))
    assert found.count() == 8000
    r = found.orderBy(F.desc("start")).first()
    assert cites[r["start"]:r["end"]] == r["citation"] == "Section 8000 of the Indian Contract Act"
    assert CL.split_sections(df.filter("doc_id = 3")).count() == 5000
    assert time.time() - began < 40


def test_sections_carry_their_text(spark):
    text = "before\n\nARTICLE 1. SCOPE\none\n two  x\nDEFINITIONS\nSECTION 2) PAY\nend"
    rows = CL.split_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section_no").collect()
    assert [(r.section_no, r.heading_key, r.body) for r in rows] == [
        (0, None, "before\n"), (1, "scope", "one\ntwo x"), (2, "definitions", ""), (3, "pay", "end")]


def test_two_acts_of_equal_initials_and_aliases(spark):
    text = ("Section 5 of the Indian Contract Act and Section 5 of the Indian Companies Act. Section 482 of the Cr.P.C. "
            "and Section 482 of the Code of Criminal Procedure. Section 302 of the I.P.C. or Section 302 of the Indian Penal Code.")
    aliases = spark.createDataFrame(LG.CODE_ALIASES, "spelling string, code string")
    keys = LG.canonical_keys(LG.extract_citations(spark.createDataFrame([(1, text)], "doc_id long, text string")), aliases)
    assert sorted(r.canonical_key for r in keys.collect()) == [
        "statute:CrPC:482", "statute:CrPC:482", "statute:IPC:302", "statute:IPC:302",
        "statute:indian companies act:5", "statute:indian contract act:5"]


def test_uncited_cases_of_a_list(spark):
    docs = spark.createDataFrame([(i, "We hold that State v. Rao applies.") for i in range(3)], "doc_id long, text string")
    aliases = spark.createDataFrame(LG.CODE_ALIASES, "spelling string, code string")
    listed = spark.createDataFrame([("case:state v rao",), ("case:kumar v singh",)], "canonical_key string")
    rows = {r.canonical_key: r for r in LG.precedent_scores(docs, aliases, case_list=listed).collect()}
    assert rows["case:state v rao"].cited_by == 3 and rows["case:kumar v singh"].level == "uncited"


def test_summary_is_in_document_order(spark):
    text = "Alpha beta gamma delta. Common words here now. Omega sigma tau rho. Common words here now."
    docs = spark.createDataFrame([(1, text), (2, "Common words here now. Other common words here.")], "doc_id long, text string")
    top = SU.summaries(SU.top_sentences(SU.sentence_scores(docs), k=2))
    assert {r.doc_id: r.summary for r in top.collect()}[1].startswith("Alpha beta gamma delta. Omega sigma")


def brute_pairs(docs, size=5):
    sets = {}
    for d, t in docs:
        if t:
            sets[d] = {" ".join(t[i:i + size]) for i in range(max(1, len(t) - size + 1))}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                out.add((a, b))
    return sets, out


def test_near_duplicates_find_short_copies_and_the_threshold(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [r.choices(words, k=k) for k in (2, 3, 8, 12, 40)]
    docs = []
    for i in range(60):
        t = list(r.choice(base))
        if r.random() < 0.6:
            t[r.randrange(len(t))] = r.choice(words)
        docs.append((i, t))
    t = [f"x{i}" for i in range(12)]
    docs += [(100, t), (101, t + ["y", "z"]), (102, []), (103, ["a", "b"]), (104, ["a", "b"])]    # 8 of 10 shingles: exactly 0.8
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    for most in (64, 3):
        rows = SIM.near_duplicates(df, most=most).collect()
        sets, want = brute_pairs(docs)
        exact = {(x.id_a, x.id_b) for x in rows if x.kind == "exact"}
        rep = {b: a for a, b in exact}
        got = {(x.id_a, x.id_b) for x in rows if x.kind == "near"}
        assert all(sets[a] == sets[b] for a, b in exact) and (103, 104) in exact
        assert got == {(a, b) for a, b in want if a not in rep and b not in rep}
        assert (100, 101) in got


def test_top_k_in_query_chunks(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(30)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = base.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    whole = sorted(map(tuple, SIM.top_k_similar(base, queries, k=3).collect()))
    monkeypatch.setattr(SIM, "QUERY_CHUNK", 7)
    assert sorted(map(tuple, SIM.top_k_similar(base, queries, k=3).collect())) == whole and len(whole) == 90


def test_similarity_rows_searches_every_hundredth_row(spark):
    import __spark_entry__ as E
    d = "/root/testdata/sf0.01"
    due = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 100 = 0").select("vec_id").collect()}
    rows = E.queries()["similarity_rows"](spark, d).collect()
    assert {r.query_id for r in rows} == due and len(rows) == 5 * len(due) and all(r.vec_id != r.query_id for r in rows)


def test_min_hashes_find_pairs_in_crowded_buckets(spark):
    """Hundreds of near copies of one text: buckets are split again and again, and no pair at the threshold is lost."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(240):
        t = list(base)
        for _ in range(r.randrange(1, 3)):
            t[r.randrange(len(t))] = f"x{r.randrange(9)}"
        docs.append((i, t))
    sets, want = brute_pairs(docs)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    rows = SIM.near_duplicates(df, most=16).collect()
    rep = {x.id_b for x in rows if x.kind == "exact"}
    want = {(a, b) for a, b in want if a not in rep and b not in rep}
    got = {(x.id_a, x.id_b) for x in rows if x.kind == "near"}
    assert got <= want and len(got) >= 0.999 * len(want) > 500


def test_lcs_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        a, b = r.choices("abcd", k=r.randrange(15)), r.choices("abcd", k=r.randrange(15))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert EV.lcs_of(a, b) == d[-1][-1]


def test_best_of_breaks_ties_by_id():
    import numpy as np
    r = np.random.default_rng(3)
    score = r.integers(0, 4, (50, 40)) / 4
    score[0] = -np.inf
    ids = np.stack([r.permutation(40) for _ in range(50)])
    best, names = SIM.best_of(score, ids, 5)
    for i in range(1, 50):
        want = sorted(zip(-score[i], ids[i]))[:5]
        assert [(-s, n) for s, n in zip(best[i], names[i])] == want


def test_cells_find_nine_of_ten_neighbours(spark):
    import __spark_entry__ as E
    d, q = "/root/testdata/sf0.1", E.queries()
    exact = {(x.query_id, x.vec_id) for x in q["similarity_rows"](spark, d).collect()}
    rows = q["similarity_cells"](spark, d).collect()
    found = {(x.query_id, x.vec_id) for x in rows}
    assert len(found & exact) >= 0.9 * len(exact) and len(rows) == len(exact)


def test_cells_with_odd_rows_and_parts(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(900, None), (901, [0.0] * 6), (7, [1.0] * 6), (None, [1.0] * 6)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = base.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")).where("vec_id < 20 OR vec_id >= 900")
    index = VE.build_index(base, cells=VE.learn_cells(base, cells=4), chunk=10)
    got = VE.search(index, queries, k=4, probes=4, chunk=10).collect()       # all cells: exact
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    unit = [(i, norm(v)) for i, v in rows if v and any(v) and i is not None]
    seen = {}
    for x in got:
        seen.setdefault(x.query_id, []).append((x.cosine, x.vec_id))
    assert set(seen) == set(range(20))
    for i, v in unit[:20]:
        if i != 7:
            want = sorted(((-round(sum(a * b for a, b in zip(v, w)), 9), j) for j, w in unit if j != i))[:4]
            assert [(round(-s, 6), j) for s, j in want] == [(round(s, 6), j) for s, j in sorted(seen[i], reverse=True)]
    assert VE.search(VE.build_index(base.limit(0)), queries).count() == 0


def test_bucket_rows_carry_no_signatures(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.randint(0, 3) for _ in range(6)]) for i in range(40)]
    rows += [(3, [9] * 6), (4, [9] * 6), (5, rows[5][1]), (6, rows[6][1])]          # ids with two signatures, rows found twice
    signed = spark.createDataFrame(rows, "doc_id long, sig array<long>")
    written = {}

    def kept(df, name):
        written.setdefault(name, []).append(df.columns)
        return materialize(df, name)
    monkeypatch.setattr(SIM, "materialize", kept)
    for most in (2, 8, 64):
        got = {tuple(r) for r in SIM._bucket_pairs(signed, "doc_id", 6, most).collect()}
        assert got == _bucket_pairs_of(rows, most)
    assert all("sig" not in c for c in written["bucket-members"])


def _bucket_pairs_of(rows, most, rounds=3):
    found, held = set(), [(i, tuple(sig), b, (k,)) for i, sig in rows for b, k in enumerate(sig)]
    for turn in range(1, rounds + 1):
        buckets, after = {}, []
        for r in held:
            buckets.setdefault(r[2:], []).append(r)
        for own in buckets.values():
            if len(own) <= most or turn == rounds:
                found |= {(a[0], b[0]) for a in own for b in own if a[0] < b[0]}
            if len(own) > most:
                after += [(i, sig, band, (*key, b2, k2)) for i, sig, band, key in own for b2, k2 in enumerate(sig) if b2 != band]
        held = after
    return found
