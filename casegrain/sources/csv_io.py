"""CSV sink and source for corpus splits, lossless for text with newlines,
quotes, outer spaces, empty strings and nulls.

Array columns (masks) are written as JSON text and parsed back with
``from_json`` — the stringified-list round trip of the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: options that make the round trip lossless ----------------
CSV_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N",
    "emptyValue": "",
    "multiLine": "true",
}
# -----------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, array_cols=(), partition_by=None) -> None:
    out = df
    for c in array_cols:
        out = out.withColumn(c, F.to_json(F.col(c)))
    w = out.write.mode("overwrite").options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, array_cols: dict | None = None) -> DataFrame:
    """Read with a declared schema (no inference); JSON-text array columns are parsed."""
    string_schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in (array_cols or {}) else f.dataType)
                                  for f in schema.fields])
    df = spark.read.options(**CSV_OPTIONS).schema(string_schema).csv(path)
    for c, typ in (array_cols or {}).items():
        df = df.withColumn(c, F.from_json(F.col(c), typ))
    return df
