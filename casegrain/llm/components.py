"""Connected components by alternating large and small stars, on tables only.

Each round replaces every node's edges by edges to its smallest neighbour; the
edges end as one star per component around its smallest node. Rounds are written to the
shared folder; neither edges nor labels ever reach the driver, only their count and
checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm.tables import free, written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """A written table of ``node`` and ``component`` (smallest node reachable) of every node of a link between two nodes."""
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    rounds: list[DataFrame] = []
    e = written(e, "links", scratch=rounds)
    state = _state(e)
    while True:
        last, rounds = rounds, []
        e = written(_small(_large(e)), "stars", scratch=rounds)
        free(last)
        now = _state(e)
        if now == state:
            break
        state = now
    # Stars: every node but the centre has one edge, to the centre.
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", scratch=scratch)
    free(rounds)
    return out
