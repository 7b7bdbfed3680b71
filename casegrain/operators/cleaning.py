"""Text ingestion and cleaning: HTML to text, canonical text, sections.

All per-row: nested ``regexp_replace`` / ``translate`` and array functions
over the lines of a document, linear in its length, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.text import col_of, let

# ---- fixed values -----------------------------------------------------------
SCRIPT_STYLE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
TAG = r"<[^>]*>"
# Entities decoded in this order (&amp; last, so "&amp;lt;" stays "&lt;").
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
CURLY_FROM = "‘’‚‛“”„‟–—‒―"
CURLY_TO = "''''\"\"\"\"----"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HEADING_NUMBERED = r"^(ARTICLE|SECTION|Section)?[\t ]*[0-9IVX]+[.)][\t ]+[^\t ]"
HEADING_PREFIX = r"^(ARTICLE|SECTION|Section)?[\t ]*[0-9IVX]+[.)][\t ]+"
MAX_CAPS_HEADING_WORDS = 8
# -----------------------------------------------------------------------------


def html_to_text(html) -> "F.Column":
    """Drop script/style blocks and tags, decode common entities, collapse whitespace."""
    x = F.regexp_replace(col_of(html), SCRIPT_STYLE, " ")
    x = F.regexp_replace(x, TAG, " ")
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.regexp_replace(x, r"[\t\n\x0B\f\r ]+", " ")
    return F.regexp_replace(x, r"^ | $", "")


def _clean_line(line):
    return F.regexp_replace(F.regexp_replace(line, r"[\t\r ]+", " "), r"^ | $", "")


def _mostly_text(line):
    """At least half of the non-space characters are letters or digits."""
    alnum = F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]", ""))
    nonspace = F.length(F.regexp_replace(line, r"[\t\n\x0B\f\r ]", ""))
    return alnum * 2 >= nonspace


def clean_text(text) -> "F.Column":
    """Canonical text: straight quotes/dashes, no control characters, spaces
    collapsed per line, junk lines and repeated lines dropped, blank-line
    runs collapsed to one."""
    x = F.translate(F.coalesce(col_of(text), F.lit("")), CURLY_FROM, CURLY_TO)
    x = F.regexp_replace(x, CONTROL, "")
    lines = F.transform(F.split(x, "\n", -1), _clean_line)

    def keep(ls):
        # First place of every distinct line, by sorting: no search per line.
        placed = F.array_sort(F.transform(ls, lambda ln, i: F.struct(ln.alias("ln"), i.alias("i"))))
        firsts = let(placed, lambda p: F.transform(F.filter(
            p, lambda z, k: F.coalesce(F.get(p, k - 1)["ln"] != z["ln"], F.lit(True))), lambda z: z["i"]))
        blank = F.filter(F.transform(ls, lambda ln, i: F.when(F.length(ln) == 0, i)), lambda i: i.isNotNull())
        chosen = F.transform(F.array_sort(F.array_union(firsts, blank)), lambda i: F.get(ls, i))
        joined = F.array_join(F.filter(chosen, lambda ln: (F.length(ln) == 0) | _mostly_text(ln)), "\n")
        return F.regexp_replace(F.regexp_replace(joined, r"\n\n+", "\n\n"), r"^\n+|\n+$", "")

    return let(lines, keep)


def is_heading(line) -> "F.Column":
    ln = col_of(line)
    words = F.size(F.split(F.trim(ln), " +"))
    caps = (F.upper(ln) == ln) & (F.lower(ln) != ln) & (words <= MAX_CAPS_HEADING_WORDS)
    return (F.length(ln) > 0) & (ln.rlike(HEADING_NUMBERED) | caps)


def split_sections(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, section_no, heading_key, n_lines, body_chars, body); text before the first heading is section 0.

    All inside the row: the places of the headings cut the list of lines.
    """
    clean = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda raw: F.regexp_replace(
        F.regexp_replace(raw, r"[\t\r ]+", " "), r"^ | $", ""))

    def sections(ls):
        heads = F.filter(F.transform(ls, lambda ln, i: F.when(is_heading(ln), i)), lambda i: i.isNotNull())

        def cut(h):
            # Borders: the first line, then every heading; section 0 falls away if a heading comes first.
            borders = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("no"))),
                               F.transform(h, lambda x, k: F.struct(x.alias("at"), (k + 1).alias("no"))))
            stops = F.concat(h, F.array(F.size(ls)))
            rows = F.zip_with(borders, stops, lambda b, stop: F.struct(
                b["no"].alias("no"),
                F.when(b["no"] > 0, F.lower(F.regexp_replace(F.get(ls, b["at"]), HEADING_PREFIX, ""))).alias("key"),
                F.slice(ls, b["at"] + F.when(b["no"] > 0, 2).otherwise(1),
                        stop - b["at"] - F.when(b["no"] > 0, 1).otherwise(0)).alias("body")))
            return F.filter(rows, lambda r: (r["no"] > 0) | (F.size(r["body"]) > 0))
        return let(heads, cut)

    rows = df.select(id_col, F.explode_outer(let(clean, sections)).alias("s")).filter(F.col("s").isNotNull())
    return rows.select(
        id_col, F.col("s.no").cast("bigint").alias("section_no"), F.col("s.key").alias("heading_key"),
        F.size("s.body").cast("bigint").alias("n_lines"),
        F.aggregate("s.body", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("body_chars"),
        F.array_join("s.body", "\n").alias("body"))
