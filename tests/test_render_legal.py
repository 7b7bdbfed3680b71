"""Rendering rules and legal extraction on literal templates."""

from pyspark.sql import functions as F

from casegrain.operators import cleaning as CL
from casegrain.operators import legal as LG
from casegrain.operators.render import render_highlight


def test_render_rules(spark):
    df = spark.createDataFrame([
        (1, ["##lead", "the", "con", "##tract", ",", "is", "void", "."], [0, 1, 1, 1, 0, 0, 0, 1, 1]),
        (2, [], [0]),
    ], "id long, toks array<string>, mask array<int>")
    got = {r.id: r.t for r in df.select("id", render_highlight("toks", "mask").alias("t")).collect()}
    assert got[1] == "[lead] [the] [con]tract, is [void] [.]"
    assert got[2] == ""


def test_entities_and_citations(spark):
    text = ("In State v. Sharma the court held that Section 302A of the Indian Penal Code applies. "
            "Pay Rs. 50,000 on 14 March 2019 or 2020-01-15 to Tata Motors Ltd. See (1998) 3 SCC 121 "
            "and Section 302A of the I.P.C. and Section 302A of the IPC.")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ents = {(r.type, r.text) for r in LG.extract_entities(df).collect()}
    assert {("PARTY", "State"), ("PARTY", "Sharma"), ("MONEY", "Rs. 50,000"), ("DATE", "14 March 2019"),
            ("DATE", "2020-01-15"), ("STATUTE", "Section 302A of the Indian Penal Code"),
            ("ORG", "Tata Motors Ltd")} <= ents
    for r in LG.extract_entities(df).collect():
        assert text[r.start:r.end] == r.text
    aliases = spark.createDataFrame(LG.CODE_ALIASES, "spelling string, code string")
    keys = LG.canonical_keys(LG.extract_citations(df), aliases)
    counts = {r.canonical_key: r.n for r in keys.groupBy("canonical_key").agg(F.count("*").alias("n")).collect()}
    assert counts["statute:IPC:302A"] == 3
    assert counts["case:state v sharma"] == 1 and counts["reporter:SCC:1998:3:121"] == 1


def test_clause_classes_and_cleaning(spark):
    df = spark.createDataFrame([(1, "The supplier shall indemnify the buyer. Keep it confidential and do not disclose. Hello.")],
                               "doc_id long, text string")
    got = [(r.sent_pos, r.clause_class) for r in LG.classify_sentences(df).orderBy("sent_pos").collect()]
    assert got == [(0, "indemnity"), (1, "confidentiality"), (2, "other")]
    raw = "“Quoted” text\x07 here\n\n\n\n%%%% $$$$ ####\nSame line\nSame line\n  spaced   out  "
    c = spark.createDataFrame([(raw,)], "t string").select(CL.clean_text("t").alias("c")).first().c
    assert c == "\"Quoted\" text here\n\nSame line\nspaced out"
    html = "<html><script>var t='</p>';</script><p>A &amp; B&lt;C</p>\n<style>p{}</style><b>x</b></html>"
    h = spark.createDataFrame([(html,)], "h string").select(CL.html_to_text("h").alias("t")).first().t
    assert h == "A & B<C x"
