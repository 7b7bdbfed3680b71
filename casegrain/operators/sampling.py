"""Reproducible splits, shuffled mini-batches and random token masking.

Library random generators cannot be reproduced across engines or
partitionings, so every random choice is a seeded md5 of stable keys:
the same seed gives the same split / order / mask on any cluster layout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.ordinal import exact_ordinal
from casegrain.functions.text import CLS_ID, MASK_ID, MAX_LEN, PAD_ID, SEP_ID, hex8

# ---- fixed values (reference parameters) ------------------------------------
VALIDATION_SHARE = 0.2
SPLIT_SEED = 42
BATCH_SIZE = 8
ACCUMULATION_STEPS = 2
MASK_RATE = 0.15
# -----------------------------------------------------------------------------


def seeded_key(seed, id_col: str = "doc_id"):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def train_val_split(df: DataFrame, id_col: str = "doc_id", share: float = VALIDATION_SHARE,
                    seed=SPLIT_SEED) -> DataFrame:
    """Adds ``part``: the first ceil(share·n) rows in seeded order are 'validation'.

    Exact sizes like a shuffled split; the ordinal is computed without a
    single-task window (see :func:`exact_ordinal`).
    """
    ranked = exact_ordinal(df.withColumn("_key", seeded_key(seed, id_col)),
                           ["_key", id_col], out="_rn", total_out="_n")
    n_val = F.ceil(F.col("_n") * F.lit(share))
    return ranked.withColumn("part", F.when(F.col("_rn") <= n_val, "validation").otherwise("train")) \
                 .drop("_key", "_rn", "_n")


def minibatch_assign(df: DataFrame, id_col: str = "doc_id", batch_size: int = BATCH_SIZE,
                     accumulation: int = ACCUMULATION_STEPS, seed=SPLIT_SEED) -> DataFrame:
    """Seeded shuffle → (rn, batch, step); the last batch / step may be short."""
    ranked = exact_ordinal(df.withColumn("_key", seeded_key(f"shuffle:{seed}", id_col)),
                           ["_key", id_col], out="rn")
    return (ranked.withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("bigint"))
            .withColumn("step", F.floor(F.col("batch") / accumulation).cast("bigint"))
            .drop("_key"))


def mlm_mask(df: DataFrame, ids: str = "input_ids", id_col: str = "doc_id", seed=SPLIT_SEED,
             rate: float = MASK_RATE, out: str = "masked_ids") -> DataFrame:
    """Replace ~15% of non-special positions by the mask id, by a seeded hash of (doc, position over all windows)."""
    first = F.col("window_no") * MAX_LEN if "window_no" in df.columns else F.lit(0)
    threshold = int(math.floor(rate * 4294967296.0))
    special = [PAD_ID, CLS_ID, SEP_ID]
    masked = F.transform(F.col(ids), lambda x, i: F.when(
        (~x.isin(special))
        & (hex8(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(":"), (first + i).cast("string")))
           < threshold),
        F.lit(MASK_ID)).otherwise(x))
    return df.withColumn(out, masked)
