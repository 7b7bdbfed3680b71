"""Text expressions shared by every job: tiles, tokens, sentences, hashing.

All helpers return JVM-side Column expressions (regex and higher-order
functions), so they stay inside Spark's expression evaluation and never
cross into Python.  The patterns are written so that Java regex and RE2
(the oracle's engine) accept them and agree: no look-around (but for
``ABBREVIATION_JAVA``), no back-references, Unicode classes written as
``\\p{L}``/``\\p{N}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Whitespace characters, spelled out so Java and RE2 agree on them.
WS = r"\t\n\x0B\f\r "
# A token is a run of letters/digits or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\f\r ]"
# Tiles add whitespace runs, so the tiles of a text concatenate back to it.
TILE_PATTERN = r"[\p{L}\p{N}]+|[\t\n\x0B\f\r ]+|[^\p{L}\p{N}\t\n\x0B\f\r ]"
# A sentence: characters up to a terminator (or line end), plus the terminators.
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
# Abbreviations whose dot ends no sentence: these words, and single capital letters.
ABBREVIATION_PATTERN = r"(^|[^\p{L}\p{N}])(v|vs|Mr|Mrs|Ms|Dr|Rs|No|Art|Sec|Ltd|Co|St|Cr|[A-Z])\."
# The same in one pass, for Java: it takes no neighbour into the match, and looks at the first letter before anything else.
ABBREVIATION_JAVA = ABBREVIATION_PATTERN.replace(r"(^|[^\p{L}\p{N}])", r"(?=[vA-Z])(?<![\p{L}\p{N}])")
GUARD = "\uE000"
ALNUM_CHAR = r"^[\p{L}\p{N}]$"
# Model window: 512 positions = start id + 510 tokens + end id.
MAX_LEN = 512
WINDOW_TOKENS = MAX_LEN - 2
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 100, 101, 102, 103
FIRST_WORD_ID = 1000
# -----------------------------------------------------------------------------


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tiles(text) -> Column:
    return F.regexp_extract_all(col_of(text), F.lit(TILE_PATTERN), 0)


def raw_tokens(text) -> Column:
    """Tokens with their original case (offsets refer to these)."""
    return F.regexp_extract_all(col_of(text), F.lit(TOKEN_PATTERN), 0)


def tokens(text) -> Column:
    """Lower-cased tokens of a text (uncased vocabulary)."""
    return F.transform(raw_tokens(text), lambda t: F.lower(t))


def token_count(text) -> Column:
    return F.size(raw_tokens(F.coalesce(col_of(text), F.lit(""))))


def trim_ws(c) -> Column:
    """Strip whitespace on both sides (space, tab, CR, LF, VT, FF)."""
    return F.regexp_replace(col_of(c), r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")


def guard_abbreviations(text) -> Column:
    """The dots of abbreviations and initials as a private character; lengths stay the same.

    Neighbours such as ``I.P.C.`` share the character between them, so ``ABBREVIATION_PATTERN`` needs two passes for this (as in the SQL).
    """
    return F.regexp_replace(col_of(text), ABBREVIATION_JAVA, f"$1{GUARD}")


def raw_sentences(text) -> Column:
    """Sentence matches in order, untrimmed; index = sentence position."""
    guarded = guard_abbreviations(F.coalesce(col_of(text), F.lit("")))
    found = F.regexp_extract_all(guarded, F.lit(SENTENCE_PATTERN), 0)
    return F.transform(found, lambda s: F.translate(s, GUARD, "."))


def sentences(text) -> Column:
    """Trimmed sentences; empty ones are kept as '' so positions stay stable."""
    return F.transform(raw_sentences(text), lambda s: trim_ws(s))


def window_count(n_tokens) -> Column:
    """Consecutive windows of 510 tokens that hold a text (one for a text without tokens)."""
    return F.greatest(F.lit(1), F.ceil(col_of(n_tokens) / WINDOW_TOKENS)).cast("int")


def window_slice(arr, window_no, size: int = WINDOW_TOKENS) -> Column:
    """Elements of window ``window_no`` (from 0)."""
    return F.slice(col_of(arr), (col_of(window_no) * size + 1).cast("int"), size)


def quote_literal(s) -> Column:
    r"""Regex that matches ``s`` literally (\Q…\E, with \E inside escaped)."""
    return F.concat(F.lit(r"\Q"), F.replace(col_of(s), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def hex8(s) -> Column:
    """First 32 bits of md5(s) as a non-negative bigint (same in DuckDB)."""
    return F.conv(F.substring(F.md5(col_of(s)), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(*parts) -> Column:
    """Deterministic u in [0,1) from md5 of the ':'-joined parts."""
    key = F.concat_ws(":", *[col_of(p).cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return hex8(key) / F.lit(4294967296.0)


# Note on generators: ``explode``/``posexplode`` make Catalyst infer a
# ``size(array) > 0`` filter and push it to the scan, which evaluates the
# whole array expression a second time (below any repartition, in the scan
# tasks).  Jobs therefore use the ``*_outer`` forms and drop the null row.


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn`` as a lambda variable.

    Catalyst inlines staged columns into lambda bodies (CollapseProject sees
    one syntactic reference), which re-evaluates them per array element.
    A value passed as a higher-order function's *argument* is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)
