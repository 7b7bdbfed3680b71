"""Evaluation aggregates: binary metrics, best epoch, batch means, running means,
attention rationale.

Prediction/label pairs stay distributed rows; metrics are conditional sums
grouped by (run, epoch) — never collected lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions.ordinal import running_total


def _safe_div(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def binary_metrics(pairs: DataFrame, keys=("run", "epoch"), pred: str = "pred",
                   label: str = "label", digits: int = 9, count: str | None = None) -> DataFrame:
    """accuracy, precision, recall, F1 per key; zero division → 0. A row is one pair, or as many as its column ``count`` says."""
    p, y = F.col(pred) == 1, F.col(label) == 1
    one = F.col(count) if count else F.lit(1)
    agg = pairs.groupBy(*keys).agg(
        F.sum(one).cast("bigint").alias("n"),
        F.sum(F.when(p & y, one).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when(p & ~y, one).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(~p & y, one).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when(~p & ~y, one).otherwise(0)).cast("bigint").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    return agg.select(
        *keys, "n", "tp", "fp", "fn", "tn",
        F.round(_safe_div(tp + tn, F.col("n").cast("double")), digits).alias("accuracy"),
        F.round(prec, digits).alias("precision"),
        F.round(rec, digits).alias("recall"),
        F.round(_safe_div(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
    )


def best_epoch(metrics: DataFrame, run: str = "run", epoch: str = "epoch", f1: str = "f1") -> DataFrame:
    """First epoch with the strictly largest F1 above 0; else the last epoch (save-last).

    Metric tables have one row per (run, epoch): a few rows per run, so the
    per-run window is small by construction.
    """
    w = Window.partitionBy(run).orderBy(F.col(f1).desc(), F.col(epoch).asc())
    ranked = metrics.withColumn("_r", F.row_number().over(w))
    best = ranked.filter((F.col("_r") == 1) & (F.col(f1) > 0)).select(
        run, F.col(epoch).alias("_best"), F.col(f1).alias("_best_f1"))
    last = metrics.groupBy(run).agg(F.max_by(epoch, epoch).alias("_last"),
                                    F.max_by(f1, epoch).alias("_last_f1"))
    return last.join(best, run, "left").select(
        run,
        F.coalesce("_best", "_last").cast("bigint").alias("best_epoch"),
        F.coalesce("_best_f1", "_last_f1").alias("best_f1"),
        F.when(F.col("_best").isNotNull(), "best").otherwise("last").alias("saved_by"),
    )


def batch_mean(losses: DataFrame, loss: str, n_rows: str = "n_rows", keys=()) -> DataFrame:
    """Epoch loss as the mean of batch means (reference) and the row-weighted mean."""
    return losses.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_batches"),
        F.avg(loss).alias("mean_of_batch_means"),
        (F.sum(F.col(loss) * F.col(n_rows)) / F.sum(n_rows)).alias("row_weighted_mean"),
    )


def running_mean(losses: DataFrame, loss: str, order: str = "batch") -> DataFrame:
    """Cumulative mean of batch losses in batch order (distributed prefix sum)."""
    r = running_total(losses.select(order, loss), order, [loss], out_prefix="_cum_")
    return r.select(order, loss,
                    F.col("_cum_count").alias("batches_so_far"),
                    (F.col(f"_cum_{loss}") / F.col("_cum_count")).alias("running_mean"))


def attention_rationale(rows: DataFrame, group: str, weights: str = "weights", digits: int = 12) -> DataFrame:
    """Mean attention per position over a group's (layer, head) rows; 1 where
    the mean exceeds the mean over all positions (strict, rounded to 12 digits).

    (group, pos) pre-aggregates map-side, so a hot group never lands whole
    in one task; the per-group window then sees one row per position.
    """
    per_pos = (rows.select(group, F.posexplode(F.col(weights).cast("array<double>")).alias("pos", "w"))
               .groupBy(group, "pos").agg(F.avg("w").alias("avg_w")))
    g = Window.partitionBy(group)
    return per_pos.select(
        group, F.col("pos").cast("bigint").alias("pos"),
        F.round("avg_w", digits).alias("avg_weight"),
        F.when(F.round("avg_w", digits) > F.round(F.avg("avg_w").over(g), digits), 1).otherwise(0).alias("mask"),
    )
