"""Distillation and classification losses over logits stored as array columns.

One row = one example position with its logits (``array<double>``); a
``batch`` column groups rows the way the training loop would.  Per-row
terms are computed in-row, batch results are ``groupBy(batch)``
aggregations (partial aggregation map-side, one small shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.functions.arrays import cosine, kl_divergence, log_softmax
from casegrain.functions.text import let

# ---- fixed values (reference parameters) ------------------------------------
TEACHER_TEMPERATURE = 2.0
LOSS_WEIGHTS = (0.5, 0.4, 0.1)      # KL, masked-word, cosine
# -----------------------------------------------------------------------------


def kl_term(student, teacher, temperature: float = TEACHER_TEMPERATURE) -> Column:
    """Σ_i p_i (ln p_i − ln q_i), p = softmax(teacher / T), q = softmax(student)."""
    return kl_divergence(log_softmax(teacher, temperature), log_softmax(student))


def nll_term(logits, gold) -> Column:
    """−log softmax(z)[gold] (gold is a 0-based class index)."""
    return let(log_softmax(logits), lambda lp: -F.element_at(lp, F.col(gold) + 1 if isinstance(gold, str) else gold + 1))


def cosine_term(student, teacher) -> Column:
    return F.lit(1.0) - cosine(student, teacher)


def batch_losses(pairs: DataFrame, student: str = "student", teacher: str = "teacher",
                 student_hidden: str = "student_hidden", teacher_hidden: str = "teacher_hidden",
                 gold: str = "gold", masked: str | None = "masked", batch: str = "batch") -> DataFrame:
    """Per batch: KL (batchmean), masked-word loss over all rows and over masked rows,
    cosine loss, and the weighted combination."""
    rows = pairs.select(
        batch,
        kl_term(student, teacher).alias("_kl"),
        nll_term(student, gold).alias("_nll"),
        (F.col(masked) if masked else F.lit(True)).alias("_masked"),
        cosine_term(student_hidden, teacher_hidden).alias("_cos"),
    )
    agg = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum("_kl") / F.count(F.lit(1))).alias("kl_loss"),
        F.avg("_nll").alias("mlm_loss"),
        F.avg(F.when(F.col("_masked"), F.col("_nll"))).alias("mlm_loss_masked"),
        F.avg("_cos").alias("cosine_loss"),
    )
    a, b, g = LOSS_WEIGHTS
    return agg.withColumn("combined_loss",
                          a * F.col("kl_loss") + b * F.col("mlm_loss") + g * F.col("cosine_loss"))


def weighted_ce(rows: DataFrame, logits: str = "logits", gold: str = "gold", active: str = "active",
                weights: tuple[float, float] | None = None, batch: str = "batch") -> DataFrame:
    """Per batch: Σ w_y (−ln softmax(z)_y) / Σ w_y over active rows; 0 when none.

    ``weights`` = (weight_negative, weight_positive), scalars read from the
    one-row :func:`class_weights` result.
    """
    if weights is not None:
        w = F.when(F.col(gold) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    else:
        w = F.lit(1.0)
    on = F.col(active)
    terms = rows.select(batch, F.when(on, 1).otherwise(0).alias("_a"),
                        F.when(on, w).otherwise(0.0).alias("_w"),
                        F.when(on, w * nll_term(logits, gold)).otherwise(0.0).alias("_wl"))
    agg = terms.groupBy(batch).agg(F.sum("_a").cast("bigint").alias("n_active"),
                                   F.sum("_wl").alias("_num"), F.sum("_w").alias("_den"))
    return agg.select(batch, "n_active",
                      F.coalesce(F.col("_num") / F.nullif(F.col("_den"), F.lit(0.0)), F.lit(0.0)).alias("weighted_ce"))
