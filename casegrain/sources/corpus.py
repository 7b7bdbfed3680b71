"""Corpus sources: named splits → one table with a ``split`` column; case intake."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.text import MAX_LEN

SPLIT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])


def union_splits(spark: SparkSession, splits: dict) -> DataFrame:
    """{name: DataFrame or None} → one table; a missing split contributes no rows.

    ``raw_text`` copies ``text``; the 512-zero mask is set for every split but test.
    """
    frames = []
    for name, df in splits.items():
        if df is None:
            df = spark.createDataFrame([], SPLIT_SCHEMA)
        frames.append(df.withColumn("split", F.lit(name)))
    if not frames:
        return spark.createDataFrame([], SPLIT_SCHEMA).withColumn("split", F.lit(None).cast("string"))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    zeros = F.array_repeat(F.lit(0), MAX_LEN)
    return (u.withColumn("raw_text", F.col("text"))
            .withColumn("rationale_mask", F.when(F.col("split") != "test", zeros)))


def case_intake(cases: DataFrame, text: str = "text"):
    """(scorable cases, count of blank/null texts) — blank text is not scored."""
    blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    return cases.filter(~blank), cases.filter(blank).count()
