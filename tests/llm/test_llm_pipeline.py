"""The pipeline stage by stage against plain versions, on a planted corpus."""

import random

import pytest

import corpus_pipeline as C
from casegrain.llm import pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(11)
    v = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "tu") for b in ("le", "sa", "ni") for c in ("x", "r", "n", "th")]
    text = lambda n: " ".join(r.choices(v, k=n))
    passage, boiler = text(30), "all rights reserved by the owners of this page of text"
    docs, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        t = "\n".join(text(25) for _ in range(4)) + ("\nyou utterly vilethug and grossfool " + text(6) if toxic else "")
        docs.append([i, t, "en", "s0"])
        labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 5]
    near = clean[3][1].replace("\n", " ")
    docs += [[300, near + " end", "en", "s1"], [301, near + " stop", "en", "s1"], [302, clean[4][1], "en", "s1"], [303, clean[4][1], "en", "s1"],
             [304, text(9) + " " + passage + " " + text(9), "en", "s1"], [305, text(40) + "\n" + boiler, "en", "s1"],
             [306, text(40) + "\n" + boiler, "en", "s1"], [307, "", None, None], [308, None, "en", None], [None, text(12), "en", "s"],
             [309, text(40), "en", "s1"], [309, None, "en", "s1"]]
    docs[-1][1] = docs[-2][1] + " again"
    docs.append([310, "é😀 " * 3000 + text(20), "fr", "s1"])
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(*d, len(d[1] or ""), "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, component_id string"
                          ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages(spark, planted):
    path, docs = planted
    now = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, f in C.STAGES:
        out = f(spark, now, path)
        if name != C.STAGES[-1][0]:
            assert out.columns == C.COLUMNS
        rows = [x.asDict() for x in out.collect()]
        kept[name] = rows
        now = spark.createDataFrame([tuple(x.values()) for x in rows], out.schema)
    ids = {k: {x["doc_id"] for x in v} for k, v in kept.items()}
    everyone = {d[0] for d in docs}
    assert everyone - ids["toxicity"] == {i for i in range(0, 200, 5)}
    lines = {x["doc_id"]: x["text"] for x in kept["line_dedup"]}
    assert ids["toxicity"] - ids["line_dedup"] == {302, 303}             # nothing left of the copies
    assert "rights" in lines[305] and "rights" not in lines[306] and lines[308] is None and lines[307] == ""
    assert all(x["n_chars"] == len(x["text"] or "") for x in kept["line_dedup"])
    assert ids["line_dedup"] - ids["near_duplicates"] == {300, 301}      # the words of an earlier one, in one line
    assert ids["near_duplicates"] - ids["decontamination"] == {304}
    last = {x["doc_id"]: x for x in kept["byte_bpe"]}
    assert set(last) == ids["decontamination"] and last[308]["n_tokens"] == 0
    from casegrain.llm import byte_bpe
    import public_tokenizers as P
    import numpy as np
    for x in kept["decontamination"]:
        raw = byte_bpe.decode_ids(np.array(last[x["doc_id"]]["ids"], np.int32), P.path("byte_bpe_50k.tiktoken")).tobytes()
        assert raw.decode() == (x["text"] or "") or x["doc_id"] == 309


def test_run_and_empty_table(spark, planted, tmp_path):
    path, _ = planted
    out = C.run(spark, path)
    assert out.count() > 150 and "n_tokens" in out.columns
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_exact_copies_with_short_lines_leave_no_stub(spark):
    """A copy goes whole, though lines under 20 characters stay in texts; the first document keeps its short lines."""
    long = [f"a long line of the document with number {c}{c}{c}{c}{c}{c}" for c in "qvz"]
    docs = [(1, f"Menu\n{long[0]}\n\nHome"), (2, f"Menu\n{long[0]}\n\nHome"), (3, f"Menu\n{long[0]}\nOnly here"),
            (4, f"Menu\n{long[1]}"), (5, "Menu"), (6, f"{long[1]}\nMenu\nMenu"), (7, f"{long[2]}\n é "), (8, f"{long[2]}\né"),
            (9, f"{long[2]}\nMenu"), (9, f"{long[2]}\nHome"), (10, f"{long[2]}\nMenu"), (10, f"{long[2]}\nnew one"),
            (11, f"{long[0]}\nTwice\nTwice"), (12, f"{long[0]}\nTwice"), (None, f"{long[0]}\nMenu"), (13, None), (14, "")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in pipeline.drop_lines(spark, df, "").collect()]
    assert sorted(out, key=str) == sorted([
        (1, "Menu\n\nHome"), (3, "Menu\nOnly here"), (4, f"Menu\n{long[1]}"), (5, "Menu"), (7, f"{long[2]}\n é "),
        (10, "Menu"), (10, "new one"), (11, "Twice\nTwice"), (None, f"{long[0]}\nMenu"), (13, None), (14, "")], key=str)
