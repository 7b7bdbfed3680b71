"""Annotations in a table of their own: matching by joins, spans against tokens by an interval join on bins.

For annotations that come apart from the texts (doc_id, sentence), in long format. Sentences meet the
document's own by an equi-join on (document, sentence); the few chosen ones come back to the text, whose occurrences one automaton
finds. Tokens and spans are then cut into bins of ``BIN`` characters and joined on (document, bin), so a document of any length spreads over
tasks and no token is compared with a span of another bin. The tokens of a bin are one row, and the marks of a model
window 512 bits, so neither join nor grouping moves a row per token. Spans are clipped to their bin; of those
with one start the longest stands for all, so sentences that overlap or repeat don't multiply the work.

Results equal those of :mod:`casegrain.operators.annotations` on the same data. Null sentences and documents without a
text match nothing; repeated annotations count once; rows that repeat a doc_id are one document only if their texts are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.batches import over_batches, token_bounds
from casegrain.functions.text import MAX_LEN, WINDOW_TOKENS
from casegrain.operators.annotations import lists_of, occurrences
from casegrain.operators.tokens import sentence_rows

BIN = 4096
#: The marks of a window: bit p % 64 of word p // 64 is place p of 512.
WORDS = [f"w{i}" for i in range(MAX_LEN // 64)]


def _schema(df: DataFrame, id_col: str, **columns: T.DataType) -> T.StructType:
    return T.StructType([df.schema[id_col], *[T.StructField(c, t) for c, t in columns.items()]])


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and the row of each; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def matched_sentences(docs: DataFrame, annotations: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, sentence): annotated sentences that are sentences of their document."""
    chosen = annotations.where(F.col("sentence").isNotNull()).select(id_col, "sentence").distinct()
    own = sentence_rows(docs, text, id_col).select(id_col, "sentence")
    return chosen.join(own, [id_col, "sentence"], "left_semi")


def span_rows(docs: DataFrame, matched: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, start, end): every literal occurrence of a document's matched sentences."""
    per_doc = matched.groupBy(id_col).agg(F.collect_list("sentence").alias("_s"))
    both = docs.select(id_col, F.col(text).alias("_t")).join(per_doc, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [occurrences(t, s) for t, s in zip(batch.column("_t").to_pylist(), batch.column("_s").to_pylist())]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(row)), *[pa.array([o[i] for x in found for o in x], pa.int64()) for i in (1, 2)]],
                names=[id_col, "start", "end"])
    return over_batches(both, run, _schema(both, id_col, start=T.LongType(), end=T.LongType()))


def _bins_of(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, first token and tokens of each bin, and gaps and lengths of the tokens."""
    starts, ends = token_bounds(text or "")
    if not len(starts):
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), starts, ends
    touched = (ends - 1) // size - starts // size + 1
    token = np.repeat(np.arange(len(starts)), touched)
    no = starts[token] // size + np.arange(len(token)) - np.repeat(np.cumsum(touched) - touched, touched)
    at = np.flatnonzero(np.diff(no, prepend=-1))
    gaps = np.diff(ends[token], prepend=0)
    length = (ends - starts)[token]
    gaps -= length
    gaps[at] = starts[token[at]] - no[at] * size
    return no[at], token[at], np.diff(at, append=len(no)), gaps, length


def token_bins(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = BIN) -> DataFrame:
    """(id, bin, first, gap[], length[]): a row per bin, with the tokens that touch it.

    ``first`` is the position of the first of them, the others follow it. A gap counts from the end of the token before, the first one from the
    start of the bin (negative if the token starts before it): small numbers, which shuffles compress well. A token that touches
    several bins is in each. A text without tokens has a row without any.
    """
    rows = docs.select(id_col, F.col(text).alias("_t"))
    numbers = T.ArrayType(T.IntegerType())
    schema = _schema(rows, id_col, bin=T.LongType(), first=T.LongType(), gap=numbers, length=numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [_bins_of(t, size) for t in batch.column("_t").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            no, first, sizes, gaps, lengths = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row)), pa.array(no), pa.array(first), _lists(gaps, sizes),
                                              _lists(lengths, sizes)], names=schema.names)
    return over_batches(rows, run, schema)


def token_places(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, start, end) of every token, pos from 0."""
    rows = docs.select(id_col, F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("_t").to_pylist()):
                starts, ends = token_bounds(t or "")
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(np.full(len(starts), i))), pa.array(np.arange(len(starts))),
                                                  pa.array(starts), pa.array(ends)], names=[id_col, "pos", "start", "end"])
    return over_batches(rows, run, _schema(rows, id_col, pos=T.LongType(), start=T.LongType(), end=T.LongType()))


def _binned(rows: DataFrame, size: int) -> DataFrame:
    """A row per bin that [start, end) touches, clipped to the bin (``lo``, ``hi``)."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    out = rows.withColumn("bin", F.explode(F.sequence(first, last)))
    return out.withColumns({"lo": F.greatest("start", F.col("bin") * size), "hi": F.least("end", (F.col("bin") + 1) * size)})


def span_bins(spans: DataFrame, id_col: str = "doc_id", size: int = BIN) -> DataFrame:
    """(id, bin, lo[], hi[]): the spans of each bin, counted from its start; at most ``size`` of them, whatever the spans were."""
    longest = _binned(spans, size).groupBy(id_col, "bin", (F.col("lo") - F.col("bin") * size).cast("int").alias("lo")).agg(
        F.max((F.col("hi") - F.col("bin") * size).cast("int")).alias("hi"))
    both = longest.groupBy(id_col, "bin").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    return both.select(id_col, "bin", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def window_marks(bins: DataFrame, id_col: str = "doc_id", size: int = BIN) -> DataFrame:
    """(id, window_no, n, w0…w7) from rows of :func:`token_bins` with ``lo`` and ``hi`` of :func:`span_bins`: the part of each window in each bin.

    ``n`` counts the tokens that start in the bin, the words mark those that a span overlaps: a token [a, b) is
    overlapped by as many spans as start before b, less those that end up to a.
    """
    rows = bins.select(id_col, "first", "gap", "length", "lo", "hi")
    schema = _schema(rows, id_col, window_no=T.LongType(), n=T.LongType(), **dict.fromkeys(WORDS, T.LongType()))
    step = size + 1     # the bins of a batch lie apart from each other on one line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap, row = _flat(batch.column("gap"))
            length = batch.column("length").flatten().to_numpy()
            held = np.bincount(row, minlength=batch.num_rows)
            begin = np.cumsum(held) - held
            run_on = np.concatenate([[0], np.cumsum(gap.to_numpy() + length.astype(np.int64))])
            end = run_on[1:] - run_on[begin[row]]
            start = end - length
            lo, span_row = _flat(batch.column("lo"))
            lo, hi = np.sort(span_row * step + lo.to_numpy()), np.sort(span_row * step + batch.column("hi").flatten().to_numpy())
            hit = np.searchsorted(lo, row * step + np.minimum(end, size), "left") > np.searchsorted(hi, row * step + np.maximum(start, 0), "right")
            pos = batch.column("first").to_numpy()[row] + np.arange(len(row)) - begin[row]
            window = pos // WINDOW_TOKENS
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
            at, part, none = np.flatnonzero(new), np.cumsum(new) - 1, np.flatnonzero(held == 0)
            marks = np.zeros((len(at) + len(none), MAX_LEN), bool)
            marks[part[hit], pos[hit] % WINDOW_TOKENS + 1] = True
            words = np.packbits(marks, axis=1, bitorder="little").view("<i8")
            zeros = np.zeros(len(none), np.int64)
            n = np.bincount(part[start >= 0], minlength=len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(np.concatenate([row[at], none]))), pa.array(np.concatenate([window[at], zeros])),
                 pa.array(np.concatenate([n, zeros])), *[pa.array(np.ascontiguousarray(w)) for w in words.T]], names=schema.names)
    return over_batches(rows, run, schema)


def interval_masks(docs: DataFrame, annotations: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = BIN) -> DataFrame:
    """(id, window_no, n_active, n_positive, rationale_mask[512]): a row per model window of every document."""
    known, unknown = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    spans = span_bins(span_rows(known, matched_sentences(known, annotations, text, id_col), text, id_col), id_col, size)
    # A null id joins with nothing; its texts go around the join, which would bring them all to one task.
    none = F.lit(None).cast("array<int>")
    alone = token_bins(unknown, text, id_col, size).where(F.size("gap") > 0).withColumns({"lo": none, "hi": none})
    bins = token_bins(known, text, id_col, size).join(spans, [id_col, "bin"], "left").unionByName(alone)
    rows = window_marks(bins, id_col, size).groupBy(id_col, "window_no").agg(F.sum("n").alias("n"), *[F.bit_or(w).alias(w) for w in WORDS])
    zero = F.lit(0).cast("bigint")
    # And it is one document without tokens besides.
    rows = rows.unionByName(unknown.select(id_col).distinct().select(id_col, zero.alias("window_no"), zero.alias("n"), *[zero.alias(w) for w in WORDS]))
    positive = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0])).cast("bigint")
    rows = rows.select(id_col, "window_no", (F.col("n") + 2).alias("n_active"), positive.alias("n_positive"), *WORDS)
    schema = _schema(rows, id_col, window_no=T.LongType(), n_active=T.LongType(), n_positive=T.LongType(), rationale_mask=T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1).astype("<i8")
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], lists_of(bits)], names=schema.names)
    return over_batches(rows, run, schema)
