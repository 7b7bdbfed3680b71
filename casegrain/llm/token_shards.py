"""Token-id shards: one wavelet-matrix file per shard, in ascending document order.

Texts are range-partitioned and sorted by document id, encoded with a tokenizer file
(no special tokens added, one end id after each document) and packed into shards
of about ``shard_tokens`` ids, never cutting a document. Each shard is one compressed
Parquet file with one row: its place, its counts and the bytes of ``wavelet.py``,
so any store Spark can write to holds it and failed tasks leave nothing behind.

Readers take a shard's bytes and answer token access, counts and occurrences
without decoding it; ``read_documents`` gives every document back.

Defined results: null or empty text gives the end id alone; documents with a null id
come first; repeated ids follow each other in order of their text; an empty table
gives no shards; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrain.llm.chunks import ChunkEncoder
from casegrain.llm.tables import arrow
from casegrain.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from casegrain.llm.words import column, column_bytes, slices

SHARD_TOKENS = 4 << 20
END_ID = 2
SHARD_SCHEMA = "part int, seq int, before long, first_doc long, n_docs long, n_tokens long, payload binary"


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[ChunkEncoder, int]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    # The tokenizer drops white space and never joins what it parts.
    return ChunkEncoder(t, spaces=False), max(1, int(t.get_vocab_size() - 1).bit_length())


class _Shard:
    """Documents gathered for the next shard."""

    def __init__(self):
        self.ids, self.docs, self.null, self.lengths, self.n = [], [], [], [], 0

    def add(self, docs: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs += [0 if d is None else d for d in docs]
        self.null += [d is None for d in docs]
        self.lengths.append(lengths)
        self.n += len(ids)

    def row(self, part: int, seq: int, before: int, bits: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        bits = max(bits, int(ids.max()).bit_length())
        payload = to_bytes(WaveletMatrix.of(ids, bits), np.array(self.docs, np.int64), np.array(self.null),
                           np.concatenate(([0], np.cumsum(np.concatenate(self.lengths)))))
        first = None if self.null[0] else self.docs[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([first], pa.int64()),
             pa.array([len(self.docs)], pa.int64()), pa.array([len(ids)], pa.int64()),
             pa.array([payload], pa.binary())],
            names=["part", "seq", "before", "first_doc", "n_docs", "n_tokens", "payload"])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bits = _encoder(tokenizer)
        part, seq, before, shard = TaskContext.get().partitionId(), 0, 0, _Shard()
        for batch in batches:
            (data, offs), keys = column_bytes(column(batch, "text")), column(batch, "doc_id").to_pylist()
            for lo, hi in slices(offs, 4 << 20):
                ids, first = encoder.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                # The end id of each document goes in at once; then as many documents as fit go to the shard.
                ids, first = np.insert(ids, first[1:], end_id), first + np.arange(hi - lo + 1)
                j = 0
                while j < hi - lo:
                    k = int(np.searchsorted(first, first[j] + shard_tokens - shard.n, "right")) - 1
                    if k <= j and shard.n:
                        yield shard.row(part, seq, before, bits)
                        seq, before, shard = seq + 1, before + shard.n, _Shard()
                        continue
                    k = min(max(k, j + 1), hi - lo)
                    shard.add(keys[lo + j:lo + k], ids[first[j]:first[k]], np.diff(first[j:k + 1]))
                    j = k
        if shard.n:
            yield shard.row(part, seq, before, bits)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (arrow(ordered, run, SHARD_SCHEMA)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``: ids in all shards before, those of the same task counted when it wrote them."""
    all_shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row per partition of the write.
    parts = all_shards.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    parts = parts.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    return all_shards.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("__before")).drop("__before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ``tokens`` (little-endian unsigned 32-bit ids) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix, docs, null, starts = from_bytes(column(batch, "payload")[i].as_buffer().to_pybytes())
                ids = matrix.all()
                base = column(batch, "start")[i].as_py()
                for lo, hi in slices(starts, 1 << 18):
                    raw = ids[starts[lo]:starts[hi]].astype("<u4").tobytes()
                    offs = (starts[lo:hi + 1] - starts[lo]) * 4
                    tokens = pa.Array.from_buffers(pa.binary(), hi - lo, [
                        None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[lo:hi], mask=null[lo:hi]), pa.array(base + starts[lo:hi]),
                         pa.array(np.diff(starts[lo:hi + 1])), tokens],
                        names=["doc_id", "start", "n_tokens", "tokens"])
    return arrow(shards(spark, path).select("start", "payload"), run, "doc_id long, start long, n_tokens long, tokens binary")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of one id per shard: first_doc, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [from_bytes(x.as_buffer().to_pybytes())[0].count(token) for x in column(batch, "payload")]
            yield pa.RecordBatch.from_arrays([column(batch, "first_doc"), pa.array(n, pa.int64())],
                                             names=["first_doc", "n"])
    return arrow(shards(spark, path).select("first_doc", "payload"), run, "first_doc long, n long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of one id: doc_id, offset in the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in column(batch, "payload"):
                matrix, docs, null, starts = from_bytes(x.as_buffer().to_pybytes())
                at = matrix.find(token)
                d = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(docs[d], mask=null[d]), pa.array(at - starts[d])],
                                                 names=["doc_id", "offset"])
    return arrow(shards(spark, path).select("payload"), run, "doc_id long, offset long")
