"""Stand-ins that turn the driver's tables into the reference's inputs.

* Corpus: ``documents`` left join ``labels`` (``quality`` is the outcome
  label, 1 → ALLOWED).  Labelled rows are split into train/dev/test by a
  seeded md5 bucket; every document also belongs to the expert split.
* Expert annotations: each of five experts picks sentences of the
  document by a seeded md5 rule and ranks them; the picks are written as
  JSON annotation strings in the document's own row, like the
  reference's expert split (text and ``expert_1..5`` side by side).
  Everything is computed in-row: no join and no shuffle.

The same rules are spelled out in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.text import MAX_LEN, hex8, let, sentences

# ---- fixed values (stand-in rules, mirrored in the oracle SQL) --------------
N_EXPERTS = 5
PICK_PERCENT = 8          # an expert picks a sentence when hash % 100 < 8
SPLIT_SEED = "split"      # bucket = hex8(md5('split:' || doc_id)) % 10
TRAIN_BUCKETS = 8         # buckets 0-7 train, 8 dev, 9 test
FOREIGN_ONE_IN = 3        # a third of the documents have a foreign sentence,
FOREIGN_ITEMS = 40        # of benchmark item hash % 40
# -----------------------------------------------------------------------------


def split_bucket(doc_id="doc_id"):
    return hex8(F.concat(F.lit(f"{SPLIT_SEED}:"), F.col(doc_id).cast("string"))) % 10


def _expert_json(k: int, sents, doc_id: str = "doc_id", foreign=None):
    """JSON annotation of expert k over the row's trimmed sentences and the foreign ones of rank 5, or null."""
    tagged = F.transform(sents, lambda s, p: F.struct(
        s.alias("sentence"),
        hex8(F.concat(F.lit(f"expert:{k}:"), F.col(doc_id).cast("string"), F.lit(":"), p.cast("string"))).alias("h"),
    ))

    def build(picks):
        own = lambda r: F.transform(F.filter(picks, lambda x: (F.floor(x["h"] / 100) % 5) + 1 == r),
                                    lambda x: x["sentence"])
        value = lambda r: own(r) if foreign is None else F.when(r == 5, F.concat(own(r), foreign)).otherwise(own(r))
        by_rank = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda r: F.struct(
            F.concat(F.lit("rank"), r.cast("string")).alias("key"), value(r).alias("value")))
        nonempty = F.filter(by_rank, lambda e: F.size(e["value"]) > 0)
        chosen = F.size(picks) > 0 if foreign is None else (F.size(picks) > 0) | (F.size(foreign) > 0)
        return F.when(chosen, F.to_json(F.map_from_entries(nonempty)))

    picks = F.filter(tagged, lambda x: (F.length(x["sentence"]) > 0) & (x["h"] % 100 < PICK_PERCENT))
    return let(picks, build)


def expert_split(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, expert_1..expert_5) for every document.

    The first expert of some documents also names a sentence that he read elsewhere: the first one of a benchmark text.
    """
    seeded = lambda name: hex8(F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")))
    elsewhere = benchmark.select(F.col("item_id").alias("_item"), F.slice(F.filter(
        sentences("text"), lambda x: F.length(x) > 0), 1, 1).alias("_foreign"))
    item = F.when(seeded("foreign") % FOREIGN_ONE_IN == 0, seeded("item") % FOREIGN_ITEMS)
    rows = documents.select("doc_id", "text", item.alias("_item")).join(elsewhere, "_item", "left")
    foreign = F.coalesce("_foreign", F.array().cast("array<string>"))
    experts = let(sentences("text"), lambda ss: F.struct(
        *[_expert_json(k, ss, foreign=foreign if k == 1 else None).alias(f"expert_{k}") for k in range(1, N_EXPERTS + 1)]))
    return rows.select("doc_id", "text", experts.alias("_e")).select("doc_id", "text", "_e.*")


def labelled_splits(labels: DataFrame) -> DataFrame:
    """(doc_id, split) of the labelled documents."""
    b = split_bucket()
    return labels.select("doc_id", F.when(b < TRAIN_BUCKETS, "train").when(b == TRAIN_BUCKETS, "dev").otherwise("test").alias("split"))


def corpus_splits(documents: DataFrame, labels: DataFrame, experts: DataFrame) -> DataFrame:
    """All splits in one table: (split, doc_id, text, raw_text, label, rationale_mask, expert_1..5).

    train/dev/test hold the labelled documents; expert holds all documents
    with their annotations.  The 512-zero mask is set for train, dev and
    expert, not test (as in the reference).
    """
    docs = documents.select("doc_id", "text")
    lab = docs.join(labels.select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    b = split_bucket()
    labelled = lab.withColumn(
        "split", F.when(b < TRAIN_BUCKETS, "train").when(b == TRAIN_BUCKETS, "dev").otherwise("test"))
    experts = experts.join(
        labels.select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id", "left"
    ).withColumn("split", F.lit("expert"))
    allsplits = labelled.unionByName(experts, allowMissingColumns=True)
    zeros = F.array_repeat(F.lit(0), MAX_LEN)
    return (allsplits
            .withColumn("raw_text", F.col("text"))
            .withColumn("rationale_mask", F.when(F.col("split") != "test", zeros)))


# ---- legal templates (fixed values) -----------------------------------------
# The corpus has no legal wording, so the text jobs run over the document
# followed by one of these templates, chosen by doc_id % 6.  Placeholders:
# {n} = doc_id % 500, {a} = doc_id % 12 + 1, {b} = (doc_id * 7) % 900 + 100,
# {m} = doc_id % 90 + 10, {d} = doc_id % 18 + 10.
LEGAL_TEMPLATES = [
    "ARTICLE 1. DEFINITIONS\nThe appellant was charged under Section {n}A of the Indian Penal Code. "
    "In State v. Sharma the court held that the evidence was insufficient.\nSECTION 2) PAYMENT\n"
    "The buyer shall pay Rs. {m},000 on 14 March 2019 to Tata Motors Ltd.",
    "The accused relied on ({y}) {a} SCC {b} and on Section {n} of the I.P.C. We hold that the appeal "
    "must be allowed.\nThe supplier shall indemnify the buyer against all losses.\n"
    "Payment of USD {m},500.75 is due on 2020-01-{d}.",
    "CONFIDENTIALITY\nEach party shall keep all information confidential and shall not disclose it.\n"
    "This agreement may be terminated by either party on notice. It is settled that Section {n} of the IPC "
    "applies. See Union of India v. Rao, ({y}) {a} SCC {b}.",
    "The Reserve Bank of India issued a circular. The High Court in Kumar v. State of Punjab held that "
    "bail may be granted.\nThe tenant shall pay $ {m}.00 per month. Liability shall be limited to direct damages.",
    "",
    "SECTION 5. TERMINATION\nEither party may terminate this agreement for breach. The licensee shall "
    "indemnify and hold harmless the licensor.\nSection {n}A of the Indian Penal Code was considered in "
    "({y}) {a} SCC {b}.",
]
# {y} = 1990 + doc_id % 30
# -----------------------------------------------------------------------------

_PLACEHOLDERS = {
    "n": lambda c: c % 500,
    "a": lambda c: c % 12 + 1,
    "b": lambda c: (c * 7) % 900 + 100,
    "m": lambda c: c % 90 + 10,
    "d": lambda c: c % 18 + 10,
    "y": lambda c: c % 30 + 1990,
}


def _template_expr(tpl: str, doc_id):
    import re as _re
    parts = []
    for chunk in _re.split(r"(\{[a-z]\})", tpl):
        if _re.fullmatch(r"\{[a-z]\}", chunk):
            parts.append(_PLACEHOLDERS[chunk[1]](doc_id).cast("string"))
        elif chunk:
            parts.append(F.lit(chunk))
    return F.concat(*parts) if parts else F.lit("")


def legal_text(doc_id: str = "doc_id", text: str = "text"):
    """The document followed by its legal template (newline-separated)."""
    c = F.col(doc_id)
    k = c % len(LEGAL_TEMPLATES)
    tpl = F.lit("")
    for i in reversed(range(len(LEGAL_TEMPLATES))):
        tpl = F.when(k == i, _template_expr(LEGAL_TEMPLATES[i], c)).otherwise(tpl)
    return F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), tpl)


def legal_text_sql(doc_id: str = "doc_id", text: str = "text") -> str:
    """DuckDB spelling of :func:`legal_text` for the oracle."""
    import re as _re
    sql_ph = {
        "n": f"({doc_id} % 500)", "a": f"({doc_id} % 12 + 1)", "b": f"(({doc_id} * 7) % 900 + 100)",
        "m": f"({doc_id} % 90 + 10)", "d": f"({doc_id} % 18 + 10)", "y": f"({doc_id} % 30 + 1990)",
    }

    def one(tpl):
        out = []
        for chunk in _re.split(r"(\{[a-z]\})", tpl):
            if _re.fullmatch(r"\{[a-z]\}", chunk):
                out.append(f"CAST({sql_ph[chunk[1]]} AS VARCHAR)")
            elif chunk:
                out.append("'" + chunk.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        return " || ".join(out) if out else "''"

    cases = " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(LEGAL_TEMPLATES))
    return f"(coalesce({text}, '') || chr(10) || CASE {doc_id} % {len(LEGAL_TEMPLATES)} {cases} END)"


def legal_template(doc_id: str = "doc_id"):
    """The template part alone (used as gold for extractor metrics)."""
    c = F.col(doc_id)
    k = c % len(LEGAL_TEMPLATES)
    tpl = F.lit("")
    for i in reversed(range(len(LEGAL_TEMPLATES))):
        tpl = F.when(k == i, _template_expr(LEGAL_TEMPLATES[i], c)).otherwise(tpl)
    return tpl


def legal_template_sql(doc_id: str = "doc_id") -> str:
    full = legal_text_sql(doc_id, "''")
    return full.replace("(coalesce('', '') || chr(10) || ", "(", 1)
