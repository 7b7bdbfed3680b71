"""Reading input tables and writing intermediate ones for the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.session import drop_path, freed_shuffles, scratch_path
from casegrain.session import table as read  # noqa: F401


BATCH_BYTES = "8m"


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of at most ``BATCH_BYTES`` (a session setting), which bounds a task's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def freeing(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()   # workers live on: what a task no longer needs goes back
    return df.mapInArrow(freeing, schema)


def written(df: DataFrame, name: str, compression: str = "snappy", scratch: list[DataFrame] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive lost executors, so nothing above them is computed again: the shuffle files of this
    write go when it is complete. A table added to ``scratch`` is for its owner to ``free``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        out.scratch_path = path
        scratch.append(out)
    return out


def free(scratch: list[DataFrame]) -> None:
    """Delete written tables that no table still to be computed reads; the list is empty then."""
    while scratch:
        table = scratch.pop()
        drop_path(table.sparkSession, table.scratch_path)


def bind(value, body):
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Spark copies a column expression into every place that uses it, also into
    lambdas that run per array element; a one-element ``transform`` binds it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


WORDS = 1 << 17


def membership_bits(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of 64-bit hashes as at most ``WORDS`` rows (word, bits): safe to broadcast at any input size."""
    return keys.groupBy((F.shiftright(F.col(key), 6).bitwiseAND(F.lit(WORDS - 1))).alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))).alias("__bits"))


def with_membership(df: DataFrame, key: str, bits: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: false if ``key`` is surely not among the bitmap's keys, true if it may be."""
    word = F.shiftright(F.col(key), 6).bitwiseAND(F.lit(WORDS - 1))
    bit = F.call_function("shiftright", F.col("__bits"), F.col(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    joined = df.withColumn("__w", word).join(F.broadcast(bits), F.col("__w") == F.col("__word"), "left")
    return joined.withColumn(out, F.coalesce(bit == 1, F.lit(False))).drop("__w", "__word", "__bits")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids`` (doc_id); rows without an id stay.

    Only rows that a bitmap of the ids marks are shuffled.
    """
    columns = docs.columns
    bits = membership_bits(ids.select(F.xxhash64("doc_id").alias("__h")), "__h")
    told = with_membership(docs.withColumn("__h", F.xxhash64("doc_id")), "__h", bits, "__maybe")
    return told.where("NOT __maybe").select(columns).unionByName(
        told.where("__maybe").select(columns).join(ids, "doc_id", "left_anti").select(columns))
