"""Stand-ins over ``embeddings`` for logits, hidden states and attention rows.

* teacher = row ``vec_id``, student = row ``vec_id + 1`` (an equi join);
  gold class = the teacher row's ``label``; batch = floor(vec_id / 8).
* token-classification logits = the first two components, gold = label % 2,
  active = label < 8.
* attention: the rows of one label form that label's (layer, head) stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.text import hex8

# ---- fixed values (stand-in rules, mirrored in the oracle SQL) --------------
BATCH = 8
MLM_MASK_PERCENT = 15
# -----------------------------------------------------------------------------


def distill_pairs(emb: DataFrame) -> DataFrame:
    t = emb.select(F.col("vec_id").alias("t_id"), F.col("embedding").alias("teacher"), F.col("label").alias("gold"))
    s = emb.select(F.col("vec_id").alias("s_id"), F.col("embedding").alias("student"))
    p = t.join(s, F.col("s_id") == F.col("t_id") + 1)
    return p.select(
        F.col("t_id").alias("vec_id"),
        F.floor(F.col("t_id") / BATCH).cast("bigint").alias("batch"),
        F.col("teacher").cast("array<double>").alias("teacher"),
        F.col("student").cast("array<double>").alias("student"),
        F.col("teacher").cast("array<double>").alias("teacher_hidden"),
        F.col("student").cast("array<double>").alias("student_hidden"),
        F.col("gold").cast("int").alias("gold"),
        (hex8(F.concat(F.lit("mlm:"), F.col("t_id").cast("string"))) % 100 < MLM_MASK_PERCENT).alias("masked"),
    )


def token_logits(emb: DataFrame) -> DataFrame:
    return emb.select(
        "vec_id",
        F.floor(F.col("vec_id") / BATCH).cast("bigint").alias("batch"),
        F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("logits"),
        (F.col("label") % 2).cast("int").alias("gold"),
        (F.col("label") < 8).alias("active"),
    )
