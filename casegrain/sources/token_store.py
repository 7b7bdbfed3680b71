"""Token-table sink/source: fixed-length windows per split, Parquet
partitioned by split, so a reader of one split prunes the others and reads
only the columns it selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tokens(encoded: DataFrame, path: str, split_col: str = "split") -> None:
    encoded.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_tokens(spark: SparkSession, path: str, split: str | None = None,
                columns=("doc_id", "window_no", "input_ids", "attention_mask", "offset_mapping")) -> DataFrame:
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.select(*columns, "split") if "split" not in columns else df.select(*columns)
