"""Rule-based legal text jobs: entities, citations, canonical keys, clause
classes, risk, precedent level.

Extraction is in-row: ``regexp_extract_all`` gives the matches and
``split`` on the same pattern gives the text between them, so match
offsets are prefix sums inside the row (no explode before the output).
Small fixed lookup tables (lexicon, aliases) are map literals or
broadcast joins of a few rows; counts per key are ``groupBy`` with
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions.arrays import prefix_sums
from casegrain.functions.ordinal import exact_ordinal
from casegrain.functions.text import col_of, let, sentences, tokens
from casegrain.session import materialize

# ---- fixed values: patterns -------------------------------------------------
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ENTITY_PATTERNS = [
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("DATE", r"[0-9]{1,2} (" + MONTHS + r") [0-9]{4}"),
    ("MONEY", r"(Rs\.|USD|INR|EUR|\$|€|£) ?[0-9][0-9,]*(\.[0-9]+)?"),
    ("STATUTE", r"Section [0-9]+[A-Z]? of the ([A-Z][a-z]+ )+(Act|Code)"),
    ("ORG", r"([A-Z][a-z]+ )+(Ltd|Inc|Corp|Bank)"),
]
CASE_PATTERN = r"[A-Z][a-z]+( of [A-Z][a-z]+)? v\. [A-Z][a-z]+( of [A-Z][a-z]+)?"
CITATION_PATTERNS = [
    ("statute", r"Section [0-9]+[A-Z]? of the (Indian Penal Code|I\.P\.C\.|IPC|Code of Criminal Procedure|Cr\.P\.C\.|([A-Z][a-z]+ )+(Act|Code))"),
    ("case", CASE_PATTERN),
    ("reporter", r"\([0-9]{4}\) [0-9]+ [A-Z]{2,5} [0-9]+"),
]
# Statute code aliases: spelling → canonical code.
CODE_ALIASES = [
    ("Indian Penal Code", "IPC"), ("I.P.C.", "IPC"), ("IPC", "IPC"),
    ("Code of Criminal Procedure", "CrPC"), ("Cr.P.C.", "CrPC"),
]
# Clause lexicon: class → {term: weight}.
CLAUSE_LEXICON = {
    "confidentiality": {"confidential": 3, "confidentiality": 3, "disclose": 2, "information": 1},
    "indemnity": {"indemnify": 3, "indemnity": 3, "harmless": 2, "losses": 1, "liability": 1},
    "termination": {"terminate": 3, "terminated": 3, "termination": 3, "breach": 2, "notice": 1},
}
CLASS_RISK = {"indemnity": 3, "termination": 2, "confidentiality": 1, "other": 0}
RISK_LEVELS = (("HIGH", 20.0), ("MEDIUM", 5.0))
HOLDING_CUES = ["held that", "we hold", "it is settled"]
PRECEDENT_LEVELS = (("landmark", 0.99), ("leading", 0.90))
# -----------------------------------------------------------------------------


def regex_spans(text, pattern: str) -> Column:
    """All matches of ``pattern`` as array<struct<start, end, text>> (0-based, end exclusive)."""
    t = F.coalesce(col_of(text), F.lit(""))

    def build(pair):
        # Text before the i-th hit: the parts up to it and the hits before it.
        steps = F.transform(pair["hits"], lambda h, i: F.length(F.element_at(pair["parts"], i + 1)) + F.length(h))
        return F.zip_with(pair["hits"], prefix_sums(steps), lambda h, s: F.struct(h.alias("h"), s.alias("s")))

    def place(pair):
        return F.transform(build(pair), lambda z, i: let(
            z["s"] + F.length(F.element_at(pair["parts"], i + 1)), lambda st: F.struct(
                st.cast("int").alias("start"), (st + F.length(z["h"])).cast("int").alias("end"), z["h"].alias("text"))))

    pair = F.struct(F.split(t, pattern, -1).alias("parts"),
                    F.regexp_extract_all(t, F.lit(pattern), 0).alias("hits"))
    return let(pair, place)


def _tagger(field: str, value: str):
    return lambda s: F.struct(F.lit(value).alias(field), s.alias("s"))


def _weight_sum(m):
    return lambda a, t: a + F.coalesce(F.element_at(m, t), F.lit(0))


def extract_entities(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, type, start, end, text); parties of ``X v. Y`` give two PARTY rows."""
    typed = [F.transform(regex_spans(text, p), _tagger("type", ty)) for ty, p in ENTITY_PATTERNS]
    cases = regex_spans(text, CASE_PATTERN)
    parties = F.flatten(F.transform(cases, lambda s: let(F.split(s["text"], r" v\. ", 2), lambda pp: F.array(
        F.struct(F.lit("PARTY").alias("type"), F.struct(
            s["start"].alias("start"), (s["start"] + F.length(pp[0])).cast("int").alias("end"),
            pp[0].alias("text")).alias("s")),
        F.struct(F.lit("PARTY").alias("type"), F.struct(
            (s["end"] - F.length(pp[1])).cast("int").alias("start"), s["end"].alias("end"),
            pp[1].alias("text")).alias("s"))))))
    allents = F.flatten(F.array(*typed, parties))
    return (df.select(id_col, F.explode_outer(allents).alias("e")).filter(F.col("e").isNotNull())
            .select(id_col, F.col("e.type").alias("type"), F.col("e.s.start").cast("bigint").alias("start"),
                    F.col("e.s.end").cast("bigint").alias("end"), F.col("e.s.text").alias("text")))


def extract_citations(df: DataFrame, text: str = "text", id_col: str = "doc_id", keep=()) -> DataFrame:
    """(id, kind, start, end, citation[, keep…])."""
    kinds = [F.transform(regex_spans(text, p), _tagger("kind", k)) for k, p in CITATION_PATTERNS]
    keep = list(keep)
    return (df.select(id_col, *keep, F.explode_outer(F.flatten(F.array(*kinds))).alias("c"))
            .filter(F.col("c").isNotNull())
            .select(id_col, F.col("c.kind").alias("kind"), F.col("c.s.start").cast("bigint").alias("start"),
                    F.col("c.s.end").cast("bigint").alias("end"), F.col("c.s.text").alias("citation"), *keep))


def canonical_keys(cites: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical_key`` = kind:code:number (statute), case:p1 v p2, reporter:REP:year:vol:page.

    A statute's code is its alias, else its full name in lower case (initials of two Acts may be equal).

    ``aliases`` (spelling, code) is a fixed lookup of a few rows (broadcast).
    """
    c = cites.withColumn("_code_raw", F.regexp_extract("citation", r" of the (.*)$", 1))
    c = c.join(F.broadcast(aliases.withColumnRenamed("spelling", "_code_raw")), "_code_raw", "left")
    code = F.coalesce(F.col("code"), F.lower("_code_raw"))
    statute = F.concat(F.lit("statute:"), code, F.lit(":"),
                       F.regexp_extract("citation", r"Section ([0-9]+[A-Z]?)", 1))
    parties = F.split("citation", r" v\. ", 2)
    case = F.concat(F.lit("case:"), F.lower(parties[0]), F.lit(" v "), F.lower(parties[1]))
    rep_re = r"\(([0-9]{4})\) ([0-9]+) ([A-Z]{2,5}) ([0-9]+)"
    reporter = F.concat_ws(":", F.lit("reporter"), *[F.regexp_extract("citation", rep_re, g) for g in (3, 1, 2, 4)])
    key = (F.when(F.col("kind") == "statute", statute)
           .when(F.col("kind") == "case", case).otherwise(reporter))
    return c.withColumn("canonical_key", key).drop("_code_raw", "code")


def _lexicon_maps():
    return {cls: F.create_map(*[x for t, w in sorted(terms.items()) for x in (F.lit(t), F.lit(w))])
            for cls, terms in sorted(CLAUSE_LEXICON.items())}


def classify_sentences(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, sent_pos, clause_class, score) for every non-empty sentence.

    Score of a class = Σ lexicon weights of the sentence's tokens; the class
    with the highest score wins (ties → class name), no hit → 'other'.
    The lexicon is a handful of fixed terms, inlined as map literals.
    """
    maps = _lexicon_maps()

    def ranked(toks):
        scored = F.array(*[F.struct(
            F.aggregate(toks, F.lit(0), _weight_sum(m)).alias("score"),
            F.lit(cls).alias("cls")) for cls, m in maps.items()])
        return F.array_sort(scored, lambda x, y: F.when(x["score"] > y["score"], -1)
                            .when(x["score"] < y["score"], 1)
                            .when(x["cls"] < y["cls"], -1).when(x["cls"] > y["cls"], 1)
                            .otherwise(0))

    def per_sentence(s):
        return let(tokens(s), lambda toks: let(F.element_at(ranked(toks), 1), lambda best: F.struct(
            F.when(best["score"] > 0, best["cls"]).otherwise("other").alias("clause_class"),
            best["score"].cast("bigint").alias("score"))))

    rows = df.select(id_col, F.posexplode_outer(sentences(text)).alias("sent_pos", "sentence"))
    rows = rows.filter(F.length("sentence") > 0)
    return rows.select(id_col, F.col("sent_pos").cast("bigint").alias("sent_pos"), "sentence",
                       per_sentence(F.col("sentence")).alias("c")).select(
        id_col, "sent_pos", "sentence", "c.clause_class", "c.score")


def risk_scores(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: Σ class risk / max(1, sentences) × 100 and its level."""
    w = F.lit(0)
    for cls, r in CLASS_RISK.items():
        w = F.when(F.col("clause_class") == cls, F.lit(r)).otherwise(w)
    agg = clauses.groupBy(id_col).agg(F.sum(w).alias("_pts"), F.count(F.lit(1)).alias("n_sentences"))
    risk = F.col("_pts") / F.greatest(F.col("n_sentences"), F.lit(1)) * 100.0
    level = F.lit("LOW")
    for name, th in reversed(RISK_LEVELS):
        level = F.when(risk >= th, name).otherwise(level)
    return agg.select(id_col, "n_sentences", risk.alias("risk"), level.alias("level"))


def riskiest_clauses(clauses: DataFrame, k: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The k riskiest clauses per document: class risk, then lexicon score, then position."""
    w = F.lit(0)
    for cls, r in CLASS_RISK.items():
        w = F.when(F.col("clause_class") == cls, F.lit(r)).otherwise(w)
    rows = clauses.withColumn("class_risk", w.cast("bigint")).filter(F.col("class_risk") > 0)
    order = Window.partitionBy(id_col).orderBy(F.desc("class_risk"), F.desc("score"), "sent_pos")
    return (rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
            .select(id_col, "rank", "clause_class", "class_risk", "score", "sent_pos", "sentence"))


def risk_report(risk: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rollup(source, level): documents and mean risk per source × level, per source, overall."""
    j = risk.join(docs.select(id_col, "source"), id_col)
    return j.rollup("source", "level").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"),
                                           F.round(F.avg("risk"), 6).alias("avg_risk"))


def exact_quantiles(df: DataFrame, value: str, probs, tiebreak: str) -> dict:
    """Exact linear-interpolation quantiles (like ``percentile``) without one-task buffers.

    Rows are ranked by the distributed exact ordinal; only the rows at the
    needed ranks are brought back (two per quantile).
    """
    ranked = exact_ordinal(df.select(value, tiebreak), [value, tiebreak], out="_r", total_out="_n")
    n_row = ranked.select("_n").limit(1).collect()
    if not n_row:
        return {p: None for p in probs}
    n = n_row[0]["_n"]
    want = {}
    for p in probs:
        h = p * (n - 1)
        lo = int(h)
        want[p] = (lo + 1, min(lo + 2, n), h - lo)
    ranks = sorted({r for a, b, _ in want.values() for r in (a, b)})
    vals = {r["_r"]: float(r[value]) for r in ranked.filter(F.col("_r").isin(ranks)).select("_r", value).collect()}
    return {p: vals[a] + frac * (vals[b] - vals[a]) for p, (a, b, frac) in want.items()}


def has_holding(text: str = "text") -> Column:
    """True when a sentence carries a holding cue phrase."""
    return F.exists(sentences(text), lambda s: F.lower(s).rlike("|".join(HOLDING_CUES)))


def precedent_scores(legal: DataFrame, aliases: DataFrame, text: str = "text", id_col: str = "doc_id",
                     case_list: DataFrame | None = None) -> DataFrame:
    """Per case key: citing documents, citing documents with a holding, and the
    level by exact percentiles of ``cited_by``.

    The holding flag rides along the citation pass (no filter over whole
    documents and no join back); citing documents are distinct per key.
    ``case_list`` (canonical_key) adds the cases that nobody cites, as uncited.
    """
    flagged = legal.select(id_col, text, has_holding(text).alias("_h"))
    keys = canonical_keys(extract_citations(flagged, text, id_col, keep=["_h"]), aliases)
    per = (keys.filter(F.col("kind") == "case").select(id_col, "canonical_key", "_h").distinct()
           .groupBy("canonical_key").agg(F.count(F.lit(1)).cast("bigint").alias("cited_by"),
                                         F.sum(F.col("_h").cast("int")).cast("bigint").alias("cited_by_holdings")))
    if case_list is not None:
        per = per.join(case_list.select("canonical_key").distinct(), "canonical_key", "full_outer").fillna(
            0, ["cited_by", "cited_by_holdings"])
    return _levels(per)


def _levels(per: DataFrame) -> DataFrame:
    # One row per case key, read several times (rank count, quantile rows,
    # output): written once to the shared checkpoint folder.
    per = materialize(per, "precedents")
    qs = exact_quantiles(per, "cited_by", [p for _, p in PRECEDENT_LEVELS], "canonical_key")
    level = F.lit("ordinary")
    for name, p in reversed(PRECEDENT_LEVELS):
        if qs[p] is not None:
            level = F.when(F.col("cited_by") >= F.lit(qs[p]), name).otherwise(level)
    return per.withColumn("level", F.when(F.col("cited_by") == 0, "uncited").otherwise(level))
