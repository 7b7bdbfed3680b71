"""Benchmark decontamination with a distributed positional inverted index.

``index`` cuts the documents into segments of about 4 MB of text, never cutting a document, and
writes for each one its documents, its dictionary (every distinct word) and for every word the
positions it has, as variable-length gaps. Positions of different documents lie ``GAP``
apart, so no phrase crosses a document.

``search`` takes the benchmark's windows (``width`` consecutive words; a shorter item is one
window) in chunks of bounded size against all segments. First the segments' counts give each
term's frequency in the corpus. Then every segment intersects, window by window, the lists of its
terms, shifted by their offset in the window, from the rarest term to the commonest; a window
with a term that the segment lacks is left out at once. With ``slop`` 0 that finds exact phrases;
with a slop every term may lie that many words before or after its place (proximity). Term
strings are compared, not only their hashes.

Exact matches mark the words of their span; the result has the merged spans per document.

Defined results: null text has no words; items without words or with a null id are left out;
items of one id count as one; equal windows of several items count for each; documents are rows,
so repeated rows and null ids are judged like others; empty tables give empty results (no items: no
hits); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import words as W
from casegrain.llm.tables import arrow, free, written

WIDTH = 10
SLOP = 3                  # words, for proximity matches
SEGMENT_BYTES = 4 << 20
GAP = 64                  # must exceed the width plus twice the slop
CHUNK_WORDS = 200_000     # benchmark words searched (and sent to every task) at a time

INDEX = ("segment long, doc_ids array<long>, word_counts array<long>, hashes binary, spelling binary, "
         "spelling_ends binary, counts binary, postings binary")
MATCHES = ("doc_id long, segment long, row int, n_words long, spans array<struct<start:long,stop:long>>, "
           "items array<long>, near_items array<long>")
MATCHES_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("segment", pa.int64()), ("row", pa.int32()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))])


def pack(values: np.ndarray) -> np.ndarray:
    """Variable-length bytes: seven bits each, the high bit set on all but a value's last byte."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= (1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[(ends - size)[has] + k] = ((values[has] >> (7 * k)) & 127).astype(np.uint8) | more
    return out


def unpack(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    k = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * k), first)


def _bases(counts: np.ndarray) -> np.ndarray:
    """Position of each document's first word."""
    return np.concatenate(([0], np.cumsum(counts + GAP)))[:-1] + GAP


def _segment(data: np.ndarray, offs: np.ndarray, ids: pa.Array, name: int) -> pa.RecordBatch:
    starts, ends, first = W.spans(data, offs, W.ALNUM)
    h = W.hashes(data, starts, ends)
    counts = np.diff(first)
    position = np.arange(len(h)) + np.repeat(_bases(counts) - first[:-1], counts)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    begin = np.flatnonzero(np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))) if len(h) else np.zeros(0, np.int64)
    own = np.diff(np.concatenate((begin, [len(h)])))
    gaps = position[order].copy()
    gaps[1:] -= position[order][:-1]
    gaps[begin] = position[order][begin]
    shown = order[begin]  # the first occurrence gives the spelling
    length = (ends - starts)[shown]
    stop = np.cumsum(length)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[shown] - (stop - length), length)
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([name], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
         pa.array([counts], pa.list_(pa.int64())), binary(sorted_h[begin]), binary(W.LOWER[data[at]]),
         binary(stop.astype(np.int64)), binary(own.astype(np.uint32)), binary(pack(gaps))],
        names=["segment", "doc_ids", "word_counts", "hashes", "spelling", "spelling_ends", "counts", "postings"])


def index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, scratch: list[DataFrame] | None = None) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), one row per segment, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offs = W.column_bytes(W.column(batch, "text"))
            for lo, hi in W.slices(offs, segment_bytes):
                yield _segment(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo],
                               W.column(batch, "doc_id").slice(lo, hi - lo), name)
                name += 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(arrow(rows, run, INDEX), "positional-index", scratch=scratch)


class Queries:
    """The windows of a chunk of items: terms, offsets and the items of each distinct window."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int):
        terms: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            t = [terms.setdefault(w.encode(), len(terms)) for w in words]
            for i in range(max(1, len(t) - width + 1)):
                windows.setdefault(tuple(t[i:i + width]), set()).add(item)
        self.spelling = list(terms)
        blob = np.frombuffer(b"".join(self.spelling), np.uint8)
        ends = np.cumsum([len(t) for t in self.spelling], dtype=np.int64)
        lengths = np.array([len(t) for t in self.spelling], np.int64)
        self.hashes = W.hashes(blob, ends - lengths, ends) if len(ends) else np.zeros(0, np.uint64)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.terms = np.full((len(windows), width), -1, np.int64)
        for i, w in enumerate(windows):
            self.terms[i, :len(w)] = w
        self.items = [np.array(sorted(x), np.int64) for x in windows.values()]
        self.order = np.tile(np.arange(width), (len(windows), 1))

    def rarest_first(self, frequency: np.ndarray) -> None:
        f = np.where(self.terms >= 0, np.append(frequency, 0)[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(f, axis=1, kind="stable")


def _found(row: dict, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Query terms that the segment has, and their places in its dictionary."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hashes, q.hashes), len(hashes) - 1)
    ends = np.frombuffer(row["spelling_ends"], np.int64)
    hit = [t for t in np.flatnonzero(hashes[at] == q.hashes)
           if row["spelling"][ends[at[t] - 1] if at[t] else 0:ends[at[t]]] == q.spelling[t]]
    return np.array(hit, np.int64), at[hit] if hit else np.zeros(0, np.int64)


def _keys(row: dict, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (term << 40 | position) of all postings of query terms, and the count of each term."""
    terms, place = _found(row, q)
    counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
    raw = np.frombuffer(row["postings"], np.uint8)
    ends = np.concatenate(([0], np.flatnonzero(raw < 128) + 1))   # after each value
    upto = np.concatenate(([0], np.cumsum(counts)))
    have = np.zeros(len(q.spelling), np.int64)
    have[terms] = counts[place]
    lo, hi = ends[upto[place]], ends[upto[place] + counts[place]]
    size = hi - lo
    stop = np.cumsum(size)
    gaps = unpack(raw[np.arange(stop[-1] if len(stop) else 0) + np.repeat(lo - (stop - size), size)])
    total = np.cumsum(gaps)
    n = counts[place]
    first = np.cumsum(n) - n
    base = np.concatenate(([0], total))[first]
    return (np.repeat(terms, n) << 40) | (total - np.repeat(base, n)), have


def _match(q: Queries, keys: np.ndarray, have: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every match: shifted lists intersected from the rarest term on."""
    n = len(q.length)
    if not n or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    have = np.append(have, 1)
    w = np.flatnonzero((have[q.terms] > 0).all(axis=1))
    anchor = q.order[w, 0]
    term = q.terms[w, anchor]
    count = have[term]
    stop = np.cumsum(count)
    first = np.searchsorted(keys, term << 40)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - count), count)
    window = np.repeat(w, count)
    start = (keys[at] & ((1 << 40) - 1)) - np.repeat(anchor, count)
    for step in range(1, q.terms.shape[1]):
        offset = q.order[window, step]
        term = q.terms[window, offset]
        want = (np.maximum(term, 0) << 40) + start + offset
        i = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
        ok = (term < 0) | ((keys[i] >= want - slop) & (keys[i] <= want + slop))
        window, start = window[ok], start[ok]
    return window, start


def _pairs(doc: np.ndarray, window: np.ndarray, q: Queries) -> dict[int, list[int]]:
    out: dict[int, set[int]] = {}
    for d, w in set(zip(doc.tolist(), window.tolist())):
        out.setdefault(d, set()).update(q.items[w].tolist())
    return {d: sorted(x) for d, x in out.items()}


def _search_segment(row: dict, q: Queries, slop: int) -> list[dict]:
    counts = np.array(row["word_counts"], np.int64)
    base = _bases(counts)
    keys, have = _keys(row, q)
    window, start = _match(q, keys, have, 0)
    doc = np.searchsorted(base, start, "right") - 1
    exact = _pairs(doc, window, q)
    near: dict[int, list[int]] = {}
    if slop:
        w2, s2 = _match(q, keys, have, slop)
        near = _pairs(np.searchsorted(base, s2 + slop, "right") - 1, w2, q)
    spans: dict[int, list[dict]] = {}
    if len(start):
        edge = np.zeros(int(base[-1] + counts[-1] + GAP), np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + q.length[window], -1)
        inside = np.concatenate(([0], np.cumsum(edge) > 0, [0])).astype(np.int8)
        lo, hi = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        for d, a, b in zip((np.searchsorted(base, lo, "right") - 1).tolist(), lo.tolist(), hi.tolist()):
            spans.setdefault(d, []).append({"start": a - int(base[d]), "stop": b - int(base[d])})
    return [{"doc_id": i, "segment": row["segment"], "row": k, "n_words": c, "spans": spans.get(k, []),
             "items": exact.get(k, []), "near_items": near.get(k, [])}
            for k, (i, c) in enumerate(zip(row["doc_ids"], row["word_counts"]))]


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and the words of every benchmark text that has some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.column_bytes(W.column(batch, "text"))
            starts, ends, first = W.spans(data, offs, W.ALNUM)
            low = W.LOWER[data].tobytes()
            found = [low[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "item_id"), pa.array([found[a:b] for a, b in zip(first[:-1], first[1:])],
                                                      pa.list_(pa.string()))], names=["item_id", "words"])
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return arrow(rows, run, "item_id long, words array<string>").where("size(words) > 0").distinct()


def search(idx: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = SLOP,
           chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Exact spans, items and near items of every document in the index; a row per document."""
    if GAP <= width + 2 * slop:
        raise ValueError("the gap between documents is too small for this width and slop")
    spark = idx.sparkSession
    items = written(items, "benchmark-words")
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_words))
    results = []
    for c in range(chunks):
        # A chunk holds about chunk_words words: what is collected and broadcast is bounded by that.
        own = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(chunks)) == c)
        q = Queries([(r["item_id"], r["words"]) for r in own.collect()], width)
        q.rarest_first(_frequency(idx, q))
        results.append(written(_run(idx, spark.sparkContext.broadcast(q), slop), "matches"))
    return results[0] if chunks == 1 else _merge(results)


def _frequency(idx: DataFrame, q: Queries) -> np.ndarray:
    sent = idx.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value.spelling), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms, place = _found(row, sent.value)
                total[terms] += np.frombuffer(row["counts"], np.uint32)[place]
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have])], names=["term", "n"])
    found = arrow(idx.select("hashes", "spelling", "spelling_ends", "counts"), run, "term long, n long")
    rows = (found.groupBy("term").agg(F.sum("n").alias("n")).collect())  # one row per term of the chunk, at most
    out = np.zeros(len(q.spelling), np.int64)
    for term, n in rows:
        out[term] = n
    return out


def _run(idx: DataFrame, sent, slop: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(_search_segment(row, sent.value, slop), MATCHES_ARROW)
    return arrow(idx, run, MATCHES)


def _merge(results: list[DataFrame]) -> DataFrame:
    """One row per document from the rows of all chunks: spans united, items joined."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    g = rows.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.start <= element_at(acc, -1).stop,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
                  'stop', greatest(x.stop, element_at(acc, -1).stop)))),
           concat(acc, array(x))))""")
    return g.withColumn("spans", joined)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP,
                  chunk_words: int = CHUNK_WORDS) -> DataFrame:
    scratch: list[DataFrame] = []
    found = search(index(docs, scratch=scratch), item_words(benchmark), width, slop, chunk_words)
    free(scratch)       # the matches are written: the index has done its work
    return found
