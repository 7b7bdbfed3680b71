"""Expert annotations → sentence sets → spans → token-level rationale masks.

An expert-split row carries its text and up to five annotation columns, so
the whole chain runs inside the row: no join, no shuffle, one narrow stage.
Parsing and the sentence sets are higher-order functions; spans and masks take one pass
over the text in Arrow batches, linear in its length and in the number of sentences: one automaton finds all
occurrences, a binary search finds the tokens of a span, and a running sum over span borders gives the mask.

The tokens overlapping the span [s, e) are those starting before e and ending after s. Masks cover
whole texts in consecutive model windows of 510 tokens; every token is in one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.batches import over_batches, token_bounds, with_array
from casegrain.functions.text import MAX_LEN, WINDOW_TOKENS, col_of, sentences, trim_ws

# ---- fixed values -----------------------------------------------------------
EXPERT_COLUMNS = ["expert_1", "expert_2", "expert_3", "expert_4", "expert_5"]
RANK_KEYS = ["rank1", "rank2", "rank3", "rank4", "rank5"]
# -----------------------------------------------------------------------------

SPAN = T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
_SPAN_ARROW = pa.struct([("sentence", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _parsed_map(annotation) -> Column:
    """Annotation text → map<rank, text>; JSON or Python-literal dicts.

    ``from_json`` accepts single-quoted strings, which covers Python literal
    dicts.  What doesn't parse as it stands is tried again with Python's
    unquoted ``None`` as JSON ``null``.  Anything else (tuples, bare words,
    broken text) parses to null and is rejected.
    """
    return _json(annotation, "map<string,string>")


def _json(text, schema: str) -> Column:
    c = col_of(text)
    # Quoted strings are single pieces, so a None inside a sentence stays.
    pieces = F.regexp_extract_all(c, F.lit(
        r'''"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[A-Za-z0-9_]+|[^"'A-Za-z0-9_]+|["']'''), 0)
    cleaned = F.array_join(F.transform(pieces, lambda p: F.when(p == "None", "null").otherwise(p)), "")
    return F.coalesce(F.from_json(c, schema), F.from_json(cleaned, schema))


def _rank_list(value) -> Column:
    """A rank value is a list, or a list written as a string → array<string>."""
    return _json(value, "array<string>")


def parse_annotation(annotation) -> Column:
    """One annotation → array of trimmed sentences over rank1..rank5 (nulls dropped).

    Empty / null annotation → empty array; unparseable → null (a reject).
    """
    m = _parsed_map(annotation)
    ranks = F.filter(F.map_entries(m), lambda e: e["key"].isin(RANK_KEYS))
    lists = F.transform(ranks, lambda e: F.coalesce(_rank_list(e["value"]), F.array().cast("array<string>")))
    flat = F.filter(F.flatten(lists), lambda s: s.isNotNull())
    empty = col_of(annotation).isNull() | (F.length(trim_ws(annotation)) == 0)
    return (F.when(empty, F.array().cast("array<string>"))
            .otherwise(F.transform(flat, lambda s: trim_ws(s))))


def annotation_rows(df: DataFrame, id_col: str = "doc_id",
                    expert_cols=EXPERT_COLUMNS) -> DataFrame:
    """Unpivot the expert columns and explode ranks → (id, expert, rank, sentence).

    Empty annotations are dropped; unparseable ones are dropped here and
    counted by :func:`annotation_rejects`.
    """
    present = [c for c in expert_cols if c in df.columns]
    long = df.select(id_col, *present).unpivot(id_col, present, "expert_col", "annotation")
    long = long.filter(F.col("annotation").isNotNull() & (F.length(trim_ws("annotation")) > 0))
    parsed = long.select(
        id_col,
        F.regexp_extract("expert_col", r"(\d+)$", 1).cast("bigint").alias("expert"),
        F.explode_outer(F.map_entries(_parsed_map("annotation"))).alias("e"),
    )
    parsed = parsed.filter(F.col("e").isNotNull() & F.col("e.key").isin(RANK_KEYS))
    return parsed.select(
        id_col, "expert", F.col("e.key").alias("rank"),
        F.explode_outer(_rank_list(F.col("e.value"))).alias("sentence"),
    ).filter(F.col("sentence").isNotNull()).withColumn("sentence", trim_ws("sentence"))


def annotation_rejects(df: DataFrame, expert_cols=EXPERT_COLUMNS) -> DataFrame:
    """Count non-empty annotations that parse to nothing usable."""
    present = [c for c in expert_cols if c in df.columns]
    bad = sum(
        (F.when(F.col(c).isNotNull() & (F.length(trim_ws(c)) > 0) & _parsed_map(c).isNull(), 1).otherwise(0)
         for c in present), F.lit(0))
    return df.agg(F.sum(bad).cast("bigint").alias("rejected_annotations"))


def with_rationale_sentences(df: DataFrame, expert_cols=EXPERT_COLUMNS,
                             out: str = "rationale_sentences") -> DataFrame:
    """Distinct trimmed sentences chosen by any expert at any rank (in-row set union)."""
    present = [c for c in expert_cols if c in df.columns]
    parts = [F.coalesce(parse_annotation(c), F.array().cast("array<string>")) for c in present]
    merged = F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")
    return df.withColumn(out, F.array_distinct(merged))


def with_matched_sentences(df: DataFrame, text: str = "text",
                           chosen: str = "rationale_sentences", out: str = "matched_sentences") -> DataFrame:
    """Document sentences (trimmed, distinct) that an expert chose: a hash-set intersection."""
    if "_sents" not in df.columns:
        df = df.withColumn("_sents", sentences(text))
    doc_sents = F.filter(F.col("_sents"), lambda s: F.length(s) > 0)
    return df.withColumn(out, F.array_intersect(doc_sents, F.col(chosen)))


def occurrences(text: str | None, sentences: list[str] | None) -> list[tuple[str, int, int]]:
    """(sentence, start, end) of all literal occurrences, those of one sentence not overlapping each other.

    One automaton of all sentences reads the text once, however many they are.
    """
    automaton = ahocorasick.Automaton()
    for s in dict.fromkeys(sentences or []):
        if s:
            automaton.add_word(s, s)
    if not text or not len(automaton):
        return []
    automaton.make_automaton()
    out, free = [], {}
    for last, s in automaton.iter(text):
        start = last + 1 - len(s)
        if start >= free.get(s, 0):
            out.append((s, start, last + 1))
            free[s] = last + 1
    return out


def with_spans(df: DataFrame, text: str = "text", matched: str = "matched_sentences",
               out: str = "spans") -> DataFrame:
    """Character spans [start, end) of every occurrence of every matched sentence."""
    def spans(t, sentences):
        return [{"sentence": s, "start": a, "end": b} for s, a, b in occurrences(t, sentences)]
    return with_array(df, out, T.ArrayType(SPAN), pa.list_(_SPAN_ARROW), [text, matched], spans)


def _positions(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token (from 1) that overlap each span [a, b): a token [s, e) does iff s < b and e > a."""
    return np.searchsorted(ends, a, "right") + 1, np.searchsorted(starts, b, "left")


def with_span_positions(df: DataFrame, text: str = "text", spans: str = "spans",
                        out: str = "span_positions") -> DataFrame:
    """Token positions [lo, hi] (from 1) each span overlaps, over the whole text; spans without a token are left out."""
    def positions(t, found):
        if not found:
            return []
        lo, hi = _positions(*token_bounds(t), np.array([x["start"] for x in found]), np.array([x["end"] for x in found]))
        return [{**x, "lo": a, "hi": b} for x, a, b in zip(found, lo.tolist(), hi.tolist()) if a <= b]
    kind = T.StructType([*SPAN.fields, T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
    arrow_kind = pa.struct([*_SPAN_ARROW, ("lo", pa.int32()), ("hi", pa.int32())])
    return with_array(df, out, T.ArrayType(kind), pa.list_(arrow_kind), [text, spans], positions)


def marked_tokens(text: str | None, sentences: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts and ends of a text, and whether an occurrence of a sentence overlaps the token.

    A running sum over the borders of the spans: linear in tokens and spans.
    """
    starts, ends = token_bounds(text or "")
    found = occurrences(text, sentences)
    edge = np.zeros(len(starts) + 1, np.int64)
    if found:
        lo, hi = _positions(starts, ends, np.array([x[1] for x in found]), np.array([x[2] for x in found]))
        some = lo <= hi
        np.add.at(edge, lo[some] - 1, 1)
        np.add.at(edge, hi[some], -1)
    return starts, ends, np.cumsum(edge[:-1]) > 0


def window_rows(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, window number and positions inside of each model window of texts with that many positions (one for none)."""
    sizes = np.array(sizes, np.int64)
    count = np.maximum(1, -(-sizes // WINDOW_TOKENS))
    row = np.repeat(np.arange(len(sizes)), count)
    no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, no, np.minimum(sizes[row] - no * WINDOW_TOKENS, WINDOW_TOKENS)


def windowed(values: list[np.ndarray], inside: np.ndarray, first: int = 0, after: int = 0) -> np.ndarray:
    """Values of all texts as rows of 512: ``first``, up to 510 values, ``after``, zeros."""
    out = np.zeros((len(inside), MAX_LEN), np.int32)
    out[:, 0] = first
    place = np.arange(MAX_LEN)
    out[(place > 0) & (place <= inside[:, None])] = np.concatenate(values) if values else []
    out[np.arange(len(inside)), inside + 1] = after
    return out


def lists_of(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * MAX_LEN), pa.array(rows.ravel()))


def rationale_masks(experts: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Expert split → (keep…, window_no, n_active, n_positive, rationale_mask[512]), a row per model window, in one narrow stage.

    Position p (from 1) of a text is position (p - 1) % 510 + 1 of window (p - 1) // 510; 0 is the start id.
    """
    df = with_matched_sentences(with_rationale_sentences(experts), text)
    keep = list(keep)
    rows = df.select(*keep, F.col(text).alias("_text"), "matched_sentences")
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("window_no", T.LongType()),
                           T.StructField("n_active", T.LongType()), T.StructField("n_positive", T.LongType()),
                           T.StructField("rationale_mask", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [marked_tokens(t, s)[2] for t, s in zip(batch.column("_text").to_pylist(),
                                                            batch.column("matched_sentences").to_pylist())]
            row, no, inside = window_rows([len(m) for m in marks])
            masks = windowed(marks, inside)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(row)) for c in keep], pa.array(no), pa.array(inside + 2),
                 pa.array(masks.sum(axis=1, dtype=np.int64)), lists_of(masks)], names=schema.names)
    return over_batches(rows, run, schema)


def coverage(masks: DataFrame) -> DataFrame:
    """Share of positive positions: over 512 × windows (reference) and over active positions."""
    agg = masks.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).cast("bigint").alias("positive_tokens"),
        F.coalesce(F.sum("n_active"), F.lit(0)).cast("bigint").alias("active_tokens"),
    )
    padded = F.col("n_windows") * MAX_LEN
    return agg.select(
        "n_windows", "positive_tokens", padded.cast("bigint").alias("padded_tokens"), "active_tokens",
        F.round(F.coalesce(F.try_divide(F.col("positive_tokens"), F.nullif(padded, F.lit(0))), F.lit(0.0)), 9)
        .alias("coverage_padded"),
        F.round(F.coalesce(F.try_divide(F.col("positive_tokens"), F.nullif(F.col("active_tokens"), F.lit(0))),
                           F.lit(0.0)), 9).alias("coverage_active"),
    )


def class_weights(masks: DataFrame) -> DataFrame:
    """Inverse-frequency class weights; (1, 1) without positives; null-safe.

    Reference totals count all 512 positions per window; the active variant
    counts attention positions only.
    """
    agg = masks.agg(
        (F.count(F.lit(1)) * MAX_LEN).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).cast("bigint").alias("positive_tokens"),
        F.coalesce(F.sum("n_active"), F.lit(0)).cast("bigint").alias("active_tokens"),
    )

    def weights(n, p, suffix):
        pos = F.when(p == 0, 1.0).otherwise(F.coalesce(F.try_divide(n, 2.0 * p), F.lit(1.0)))
        neg = F.when(p == 0, 1.0).otherwise(F.coalesce(F.try_divide(n, 2.0 * (n - p)), F.lit(1.0)))
        return [F.round(neg, 9).alias(f"weight_negative{suffix}"), F.round(pos, 9).alias(f"weight_positive{suffix}")]

    return agg.select(
        "total_tokens", "positive_tokens", "active_tokens",
        *weights(F.col("total_tokens"), F.col("positive_tokens"), ""),
        *weights(F.col("active_tokens"), F.col("positive_tokens"), "_active"),
    )
