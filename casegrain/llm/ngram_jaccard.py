"""Exact n-gram Jaccard join by universe partitions.

A document's set holds its distinct word n-grams (64-bit hashes of lower-cased
words). Two sets a, b of Jaccard similarity t or more differ in at most
(1-t)/(1+t) * (|a|+|b|) elements, H of them. Sizes are cut into bands; for the sets whose
smaller partner lies in a band, the universe of n-grams is hashed into m = H + 1 segments,
so by pigeonhole some segment holds the same subset of both.

Which segments a set indexes is decided by cost. Subsets made of nothing but very
frequent n-grams (and empty ones) are shared by many unrelated documents: such weak segments are
not indexed. If a set has e weak segments, it instead indexes the one-deletion
neighbourhood of the first segments that hold e strong ones (two or more infrequent
n-grams). That is complete: let a and b differ in at most H = m - 1 elements and share no
index entry, let Z be the segments that are weak and equal in both, and let a have the shorter
prefix J. Outside Z each segment differs by one or more, and each strong segment of J by two
or more, since a difference of one would meet a deletion of one side. The sum is at least
(m - |Z|) + e(a) >= m, as |Z| <= e(a): a contradiction. A set without enough strong segments
indexes all its segments, weak ones included, and all deletions; two such sets then meet by
the plain pigeonhole. The choice of frequent n-grams steers costs only, never results.

Equal sets are grouped by a 128-bit digest first; one of each group is indexed. Index entries are
combined before the shuffle: a block of documents keeps the smallest document of each key and links
the others to it, and the shuffle carries blocks of packed entries. So a key that a
third of all documents share is one entry per block. Each bucket is then a tree of heads and members.
First every document is verified exactly against the one head that it shares most keys with, then
against its heads in other components. Members of a bucket that are in one component
then need no further comparison; of the rest, pairs of different components are verified too unless
their sizes or their histograms (n-grams counted in ``BINS`` bins: the sum of the smaller counts
bounds the intersection) rule them out. No link that could join two components is lost.

Defined results: null or empty texts and texts without words have the empty set and no links;
texts of fewer than n words have one n-gram, the whole sequence; rows with one id are one
node; a null id is never linked; repeated rows are linked as copies; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import words as W
from casegrain.llm.components import components
from casegrain.llm.tables import arrow, free, membership_bits, with_membership, written
from casegrain.session import freed_shuffles

N = 5
SIMILAR = (80, 100)
BAND_RATIO = 1.4
FREQUENT_SHARE = 0.001    # of all documents
FREQUENT_LEAST = 64       # documents
FREQUENT_MOST = 200_000   # n-grams sent to every task; the rest count as infrequent

BLOCK_ENTRIES = 1 << 20   # index entries combined before the shuffle
BINS = 256

_C = W.mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)
_GOLD = 0x9E3779B97F4A7C15


def text_sets(col: pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted set of n-gram hashes of each text, in order."""
    data, offs = W.column_bytes(col)
    for lo, hi in W.slices(offs):
        part, own = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        starts, ends, first = W.spans(part, own, W.NOT_SPACE)
        h = W.hashes(part, starts, ends)
        all_grams = _grams(h, n) if len(h) >= n else None
        for i in range(hi - lo):
            k = first[i + 1] - first[i]
            if k >= n:
                x = np.sort(all_grams[first[i]:first[i + 1] - n + 1])
                yield lo + i, x[np.concatenate(([True], x[1:] != x[:-1]))]
            else:
                yield lo + i, _grams(h[first[i]:first[i + 1]], int(k)) if k else np.zeros(0, np.uint64)


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words."""
    stop = len(h) - width + 1
    total = h[:stop] * _C[0]
    for i in range(1, width):
        total += h[i:stop + i] * _C[i]
    return W.mix(total + np.uint64(width))


@lru_cache(maxsize=8)
def bands(similar: tuple[int, int] = SIMILAR, ratio: float = BAND_RATIO) -> list[tuple[int, int, int]]:
    """(smallest size, largest size that takes part, segments) of each band of the smaller set's size."""
    num, den = similar
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo + 1, int(lo * ratio))
        partner = (hi - 1) * den // num
        differ = (hi - 1 + partner) * (den - num) // (den + num)
        out.append((lo, partner, differ + 1))
        lo = hi
    return out


def index_entries(s: np.ndarray, frequent: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """All index keys of one set; ``frequent``: sorted hashes of very frequent n-grams."""
    at = np.searchsorted(frequent, s)
    rare = np.ones(len(s), bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] != s
    out = []
    for k, (lo, most, m) in enumerate(bands(similar)):
        if lo > len(s):
            break
        if most >= len(s):
            out.append(_band_entries(s, rare, k, m))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _band_entries(s: np.ndarray, rare: np.ndarray, band: int, m: int) -> np.ndarray:
    seed = np.uint64((band + 1) * _GOLD % (1 << 64))
    r = W.mix(s ^ seed)
    segment = ((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, value, is_rare = segment[order], W.mix(s[order] + seed), rare[order]
    begin = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    present = segment[begin]
    total = np.add.reduceat(value, begin)
    rares = np.add.reduceat(is_rare.astype(np.int64), begin)
    key = lambda v, seg: W.mix(v + (seg + np.uint64(1)) * _C[7] + seed)
    weak = m - np.count_nonzero(rares)
    strong = present[rares >= 2]
    if not weak:
        return key(total, present)
    if len(strong) >= weak:
        out, last = [key(total[rares > 0], present[rares > 0])], strong[weak - 1]
    else:
        absent = np.setdiff1d(np.arange(m, dtype=np.uint64), present)
        out, last = [key(total, present), key(np.zeros(len(absent), np.uint64), absent)], np.uint64(m)
    stop = np.searchsorted(segment, last, "right")
    group = np.searchsorted(begin, np.arange(stop), "right") - 1
    left = rares[group] - is_rare[:stop] >= 1
    out.append(key((total[group] - value[:stop])[left], segment[:stop][left]))
    return np.concatenate(out)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Set size and digest (doc_id, size, d1, d2) and, per block of text, n-grams found twice or more (shingle, count)."""
    names = ["doc_id", "size", "d1", "d2", "shingle", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: list[tuple[int, int, int]] = []
            found: list[np.ndarray] = []

            def flush(found=found):
                u, c = np.unique(np.concatenate(found), return_counts=True)
                u, c = u[c > 1], c[c > 1]
                found.clear()
                none = pa.nulls(len(u), pa.int64())
                return pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=names)
            held = 0
            for _, s in text_sets(W.column(batch, "text"), n):
                told.append((len(s), int(W.mix(s).sum().view(np.int64)), int(W.mix(s ^ _C[9]).sum().view(np.int64))))
                found.append(s)
                held += len(s)
                if held > 1 << 20:
                    yield flush()
                    held = 0
            if found:
                yield flush()
            none = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "doc_id"), *[pa.array([x[k] for x in told], pa.int64()) for k in range(3)], none, none],
                names=names)
    return arrow(docs.select("doc_id", "text"), run, ", ".join(f"{x} long" for x in names))


class _Block:
    """Index entries of a block of documents, combined by key."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.docs: list[int] = []
        self.n = 0

    def add(self, doc: int, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.docs.append(doc)
        self.n += len(keys)

    def rows(self, bits: int) -> pa.RecordBatch:
        """One row per bucket of keys: the combined entries and the links inside the block, packed."""
        keys = np.concatenate(self.keys)
        docs = np.repeat(np.array(self.docs, np.int64), [len(k) for k in self.keys])
        key, head, link = _combine(keys, docs)
        cuts = np.arange((1 << bits) + 1, dtype=object) << (64 - bits)
        at = [int(np.searchsorted(key, np.uint64(c))) if c < 1 << 64 else len(key) for c in cuts]
        links = [int(np.searchsorted(link[0], np.uint64(c))) if c < 1 << 64 else len(link[0]) for c in cuts]
        used = [b for b in range(1 << bits) if at[b] < at[b + 1]]
        packed = lambda x, cut, kind=None: pa.array(
            [(x[cut[b]:cut[b + 1]] if kind is None else x[cut[b]:cut[b + 1]].astype(kind)).tobytes() for b in used], pa.binary())
        # 48 bits of the key beside the bucket's: false candidates are verified away.
        shift = np.uint64(64 - bits - 48)
        narrow = head.min() >= 0 and head.max() < 1 << 31
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), packed((key >> shift) & np.uint64(0xFFFFFFFF), at, np.uint32),
             packed((key >> (shift + np.uint64(32))) & np.uint64(0xFFFF), at, np.uint16),
             packed(head, at, np.int32 if narrow else np.int64),
             packed((link[0] >> shift) & np.uint64((1 << 48) - 1), links), packed(link[1], links), packed(link[2], links)],
            names=["bucket", "key_low", "key_high", "doc", "link_key", "link_head", "link_member"])


def _combine(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Sorted distinct keys, the smallest document of each, and (key, head, member) for the others."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    head = np.minimum.reduceat(docs, begin) if len(keys) else docs
    each = np.repeat(head, np.diff(np.concatenate((begin, [len(keys)]))))
    other = docs != each
    return keys[begin], head, (keys[other], each[other], docs[other])


ENTRIES = ("bucket int, key_low binary, key_high binary, doc binary, link_key binary, link_head binary, "
           "link_member binary")


def _entries(docs: DataFrame, n: int, similar: tuple[int, int], frequent: np.ndarray, bits: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            ids = W.column(batch, "doc_id").to_pylist()
            for i, s in text_sets(W.column(batch, "text"), n):
                if len(s):
                    block.add(ids[i], index_entries(s, sent.value, similar))
                if block.n > BLOCK_ENTRIES:
                    yield block.rows(bits)
                    block = _Block()
        if block.n:
            yield block.rows(bits)
    return arrow(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), run, ENTRIES)


def _buckets(entries: DataFrame, parts: int) -> DataFrame:
    """(key, head, member) of the tree of every key that two documents or more share."""
    def tree(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        kind = lambda r: np.int32 if len(r["doc"]) * 2 == len(r["key_high"]) * 4 else np.int64
        keys = np.concatenate([np.frombuffer(r["key_low"], np.uint32).astype(np.uint64)
                               | np.frombuffer(r["key_high"], np.uint16).astype(np.uint64) << np.uint64(32) for r in rows])
        docs = np.concatenate([np.frombuffer(r["doc"], kind(r)).astype(np.int64) for r in rows])
        _, _, link = _combine(keys, docs)
        local = [np.concatenate([np.frombuffer(r[c], t) for r in rows])
                 for c, t in (("link_key", np.uint64), ("link_head", np.int64), ("link_member", np.int64))]
        key, head, member = (np.concatenate(x) for x in zip(link, local))
        key = key | np.uint64(bucket) << np.uint64(48)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(head), pa.array(member)],
                                          names=["key", "head", "member"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["bucket"] != bucket:
                    yield tree(bucket, rows)
                    rows = []
                bucket = r["bucket"]
                rows.append(r)
        if rows:
            yield tree(bucket, rows)
    ordered = entries.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return arrow(ordered, run, "key long, head long, member long").distinct()


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) whose id is in ``ids`` (doc_id): only rows that a bitmap marks are shuffled."""
    bits = membership_bits(ids.select(F.xxhash64("doc_id").alias("h")), "h")
    told = with_membership(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), "h", bits, "maybe")
    return told.where("maybe").select("doc_id", "text").join(ids, "doc_id", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, n: int = N, scratch: list[DataFrame] | None = None) -> DataFrame:
    """A written table of ``pairs`` (a, b) with the exact counts: size_a, size_b, common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, s = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = W.column(batch, "a"), W.column(batch, "b")
            ta, tb = W.column(batch, "text_a"), W.column(batch, "text_b")
            names = list(zip(a.to_numpy().tolist(), W.column(batch, "digest").to_numpy().tolist()))
            out = []
            for i, other in text_sets(tb, n):
                if names[i] != held:
                    held, s = names[i], next(text_sets(ta.slice(i, 1), n))[1]
                at = np.searchsorted(s, other)
                common = np.count_nonzero(s[np.minimum(at, len(s) - 1)] == other) if len(s) else 0
                out.append((len(s), len(other), common))
            yield pa.RecordBatch.from_arrays(
                [a, b, *[pa.array([x[k] for x in out], pa.int64()) for k in range(3)]],
                names=["a", "b", "size_a", "size_b", "common"])
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # Rows that share an id are all compared: the digest tells the texts of one id apart.
    own: list[DataFrame] = []
    texts = written(_marked(docs, ids), "ngram-texts", "zstd", own)
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), F.xxhash64("text").alias("digest"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(tb, "b").join(ta, "a").sortWithinPartitions("a", "digest")
    schema = "a long, b long, size_a long, size_b long, common long"
    out = written(arrow(both.select("a", "digest", "b", "text_a", "text_b"), run, schema), "ngram-verified", scratch=scratch)
    free(own)
    return out


def _linked(verified: DataFrame, similar: tuple[int, int]) -> DataFrame:
    num, den = similar
    return verified.where(den * F.col("common") >= num * (F.col("size_a") + F.col("size_b") - F.col("common")))


def _histograms(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size and n-grams counted in ``BINS`` bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, bins = [], []
            for _, s in text_sets(W.column(batch, "text"), n):
                size.append(len(s))
                bins.append(np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "doc_id"), pa.array(size, pa.int64()), pa.array(bins, pa.binary())],
                names=["doc_id", "size", "bins"])
    return arrow(docs, run, "doc_id long, size long, bins binary")


def _across(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``shared`` whose documents are in different components."""
    told = shared.select("a", "b")
    for side in ("a", "b"):
        told = told.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    return told.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _remaining(buckets: DataFrame, labels: DataFrame, docs: DataFrame, n: int,
               similar: tuple[int, int], parts: int, scratch: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of bucket members in different components that may still be similar."""
    named = labels.withColumnRenamed("node", "doc_id")
    nodes = buckets.select("key", F.explode(F.array("head", "member")).alias("doc_id")).join(
        named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # A bucket of a single component is done.
    open_keys = nodes.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    chosen = written(nodes.join(open_keys, "key", "left_semi").distinct(), "ngram-open", scratch=scratch)
    known = _histograms(_marked(docs, chosen.select("doc_id").distinct()), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = W.column(batch, "key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and W.column(held[-1], "key")[-1].as_py() != keys[0]):
                yield from pairs_of([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from pairs_of(held)

    def pairs_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in parts if x.num_rows]
        if not parts:
            return
        key, doc, component, size = (np.concatenate([W.column(x, c).to_numpy() for x in parts])
                                     for c in ("key", "doc_id", "component", "size"))
        bins = np.concatenate([np.frombuffer(b"".join(W.column(x, "bins").to_pylist()), np.uint16).reshape(-1, BINS)
                               for x in parts])
        num, den = similar
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for lo, hi in zip(edges[:-1], edges[1:]):
            for i in range(lo, hi - 1):
                j = np.arange(i + 1, hi)
                j = j[(component[j] != component[i])
                      & (np.minimum(size[j], size[i]) * den >= np.maximum(size[j], size[i]) * num)]
                if not len(j):
                    continue
                most = np.minimum(bins[j], bins[i]).sum(axis=1, dtype=np.int64)
                j = j[den * most >= num * (size[j] + size[i] - most)]
                if len(j):
                    x = np.sort(np.stack((np.full(len(j), doc[i]), doc[j])), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    rows = chosen.join(known, "doc_id").repartition(parts, "key").sortWithinPartitions("key", "doc_id")
    return arrow(rows.select("key", "doc_id", "component", "size", "bins"), run, "a long, b long").distinct()


def join(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(4, (4 * parts).bit_length()))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Tables that a later step alone reads go as soon as it is written.
    first: list[DataFrame] = []
    scan = written(_scan(docs, n), "ngram-scan", scratch=first)
    sizes = written(scan.where("size IS NOT NULL").select("doc_id", "size", "d1", "d2"), "ngram-sizes")
    least = max(FREQUENT_LEAST, int(sizes.count() * FREQUENT_SHARE))
    often = scan.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("n")).where(F.col("n") >= least)
    # At most FREQUENT_MOST hashes reach the driver and the tasks.
    with freed_shuffles(spark):
        frequent = np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST)
                                     .select("shingle").collect()], np.int64).view(np.uint64))
    free(first)
    equal = sizes.where("doc_id IS NOT NULL AND size > 0").groupBy("size", "d1", "d2").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # An id on several rows may have several sets: it is indexed as it stands.
    several = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = written(sizes.join(equal, ["size", "d1", "d2"]).where("doc_id <> first")
                     .join(several, "doc_id", "left_anti").select("doc_id", "first"), "ngram-copies")
    told = with_membership(docs.withColumn("__h", F.xxhash64("doc_id")), "__h",
                           membership_bits(copies.select(F.xxhash64("doc_id").alias("__h")), "__h"), "__maybe")
    single = told.where("NOT __maybe").select("doc_id", "text").unionByName(
        told.where("__maybe").select("doc_id", "text").join(copies, "doc_id", "left_anti"))
    index: list[DataFrame] = []
    checked: list[DataFrame] = []
    buckets = written(_buckets(_entries(single, n, similar, frequent, bits), parts), "ngram-buckets", scratch=index)
    shared = written(buckets.groupBy(F.col("head").alias("a"), F.col("member").alias("b")).agg(F.count(F.lit(1)).alias("n")),
                     "ngram-shared", scratch=index)
    # First each document against the head it shares most keys with, then against heads of other components, last the rest.
    best = shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    verified = verify(best, docs, n, checked)
    labels = components(_linked(verified, similar), "a", "b")
    steps = (lambda own: _across(shared, labels), lambda own: _remaining(buckets, labels, docs, n, similar, parts, own))
    for step in steps:
        own: list[DataFrame] = []
        pairs = written(step(own).join(verified.select("a", "b"), ["a", "b"], "left_anti"), "ngram-pairs", scratch=own)
        more = verify(pairs, docs, n, checked)
        free(own)
        verified = verified.unionByName(more)
        if not _linked(more, similar).isEmpty():
            labels = components(_linked(verified, similar), "a", "b")
    free(index)
    free(checked)
    rows = sizes.join(copies, "doc_id", "left").withColumn("node", F.coalesce("first", "doc_id"))
    return rows.join(labels, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
