"""Sharding by proportional stratified interleaving (native DataFrame code).

Rows of one source are put in a seeded random order and get the fractional
rank ``(2r - 1) / 2n`` (r-th of n). All rows sorted by fractional rank form
one sequence in which every stretch holds the sources in their overall
proportions; cutting it into equal stretches gives shards that match the
mixture, with row counts at most one apart (law ``rows``).

No source is sorted as one group. Rows are range-partitioned by source and seeded 64-bit hash, numbered in
their partition, and get the counts of the partitions before; a row's rank in its source is its number less
the source's first one. The global position is found the same way from the fractional rank and a hash, so neither a big source nor
many sources of one row land in one task. The text itself never enters a shuffle: size and checksum are computed in the
scan.

Equal texts are not kept together: under the law ``rows`` a shard is a stretch of the interleaving, and copies
are rows like any other. Rows with equal fractions follow each other by a seeded hash, then by source.

Defined results: a null source is a stratum of its own; null and empty text
have size 1 and the checksum of no bytes (0); repeated rows are separate rows;
rows equal in every used column are interchangeable; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.ordinal import exact_ordinal
from casegrain.llm.tables import free, written

N_SHARDS = 8
SEED = 20240607


def interleave(rows: DataFrame, stratum: str, tie: list[str], seed: int = SEED) -> DataFrame:
    """``rows`` plus ``position``: 0-based place in the proportional interleaving.

    ``tie`` names the columns that order the rows of a stratum beside the seeded
    hash of the first of them.
    """
    order = [stratum, "__h", *tie, "__row"]
    # Rows equal in every column are told apart by their place, so that even they spread over partitions.
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), tie[0])).withColumn("__row", F.monotonically_increasing_id())
    ranked = exact_ordinal(hashed, order, out="__place")
    # The stratum sizes are a partial aggregate; one row per stratum. Its rows follow each other in the first order.
    sizes = ranked.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"), F.min("__place").alias("__first"))
    sized = ranked.alias("r").join(
        sizes.alias("s"), F.col(f"r.{stratum}").eqNullSafe(F.col(f"s.{stratum}"))).select("r.*", "s.__size", "s.__first")
    fraction = (2 * (F.col("__place") - F.col("__first")) + 1).cast("double") / (2 * F.col("__size")).cast("double")
    # Strata of one row, or of one size, share their fractions: the hash of stratum and row splits them.
    mixed = sized.withColumns({"__f": fraction, "__g": F.xxhash64(stratum, "__h")})
    placed = exact_ordinal(mixed, ["__f", "__g", *order], out="__at")
    return placed.withColumn("position", F.col("__at") - 1).drop("__h", "__row", "__place", "__size", "__first", "__f", "__g", "__at")


def assign_shards(docs: DataFrame, shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Shard assignment of ``docs`` (doc_id, text, source): one row per input row.

    Returns doc_id, source, size, text_crc32, law, shard, slot, grown_shard.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    # Written once: the text is scanned a single time, and only these narrow rows are shuffled.
    rows = written(rows, "shard-rows")
    placed = interleave(rows, "source", ["doc_id", "text_crc32", "size"], seed)
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    whole = placed.join(F.broadcast(total))
    shard = F.expr(f"position * {int(shards)}L div __total")
    return whole.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        # First position of the shard: ceil(shard * total / shards) in integers.
        (F.col("position") - F.expr(f"(shard * __total + {int(shards)}L - 1) div {int(shards)}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "position")


def write_shards(docs: DataFrame, path: str, shards: int = N_SHARDS, seed: int = SEED) -> None:
    """Write ``docs`` under ``path``, one folder per shard; ``slot`` gives the order.

    Every row is written once, also rows with null or repeated ids: they are told apart by their place in a
    written copy, which takes the part of the document id in the seeded order. Columns named shard and slot are replaced.
    """
    scratch: list[DataFrame] = []
    rows = written(docs.drop("shard", "slot").withColumn("__row_id", F.monotonically_increasing_id()), "shard-texts", scratch=scratch)
    a = assign_shards(rows.select(F.col("__row_id").alias("doc_id"), "text", "source"), shards, seed).select(
        F.col("doc_id").alias("__row_id"), "shard", "slot")
    rows.join(a, "__row_id").drop("__row_id").write.partitionBy("shard").parquet(path)
    free(scratch)
