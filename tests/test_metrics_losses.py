"""Losses and metrics: closed forms and the selection quirks."""

import math

from pyspark.sql import functions as F

from casegrain.operators import losses as L
from casegrain.operators import metrics as M


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([("r", 1, 0, 0), ("r", 1, 0, 1), ("r", 2, 1, 0)], "run string, epoch long, pred int, label int")
    m = {r.epoch: r for r in M.binary_metrics(df).collect()}
    assert (m[1].precision, m[1].recall, m[1].f1, m[1].accuracy) == (0.0, 0.0, 0.0, 0.5)
    assert (m[2].tp, m[2].fp, m[2].f1) == (0, 1, 0.0)


def test_best_epoch_tie_and_fallback(spark):
    met = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.0), ("b", 2, 0.0)],
                                "run string, epoch long, f1 double")
    got = {r.run: (r.best_epoch, r.saved_by) for r in M.best_epoch(met).collect()}
    assert got == {"a": (2, "best"), "b": (2, "last")}


def test_kl_zero_and_two_class_closed_form(spark):
    # KL is 0 when softmax(teacher / 2) equals softmax(student): student = teacher / 2.
    df = spark.createDataFrame([(0, [2.0, 4.0, -2.0], [1.0, 2.0, -1.0], 1, True)],
                               "batch long, teacher array<double>, student array<double>, gold int, masked boolean")
    df = df.withColumn("teacher_hidden", F.col("teacher")).withColumn("student_hidden", F.col("student"))
    r = L.batch_losses(df).first()
    assert abs(r.kl_loss) < 1e-12
    z = [1.0, 2.0, -1.0]
    lse = math.log(sum(math.exp(x) for x in z))
    assert abs(r.mlm_loss - (lse - z[1])) < 1e-12
    assert abs(r.cosine_loss) < 1e-12  # parallel vectors


def test_weighted_ce_closed_form(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0], 1, True), (0, [2.0, 0.0], 0, True), (1, [1.0, 1.0], 0, False)],
                                 "batch long, logits array<double>, gold int, active boolean")
    got = {r.batch: r for r in L.weighted_ce(rows, weights=(1.0, 3.0)).collect()}
    nll1 = math.log(1 + math.exp(-1.0))
    nll0 = math.log(1 + math.exp(-2.0))
    assert abs(got[0].weighted_ce - (3 * nll1 + 1 * nll0) / 4) < 1e-12
    assert got[1].weighted_ce == 0.0 and got[1].n_active == 0


def test_batch_and_running_means(spark):
    losses = spark.createDataFrame([(0, 8, 1.0), (1, 8, 3.0), (2, 2, 5.0)], "batch long, n_rows long, loss double")
    b = M.batch_mean(losses, "loss").first()
    assert b.mean_of_batch_means == 3.0 and abs(b.row_weighted_mean - (8 + 24 + 10) / 18) < 1e-12
    r = {x.batch: x.running_mean for x in M.running_mean(losses, "loss").collect()}
    assert r == {0: 1.0, 1: 2.0, 2: 3.0}


def test_attention_rationale_uniform_and_peak(spark):
    rows = spark.createDataFrame([(0, [0.25, 0.25, 0.25, 0.25]), (0, [0.25, 0.25, 0.25, 0.25]),
                                  (1, [0.1, 0.1, 0.7, 0.1])], "g long, weights array<double>")
    got = {(r.g, r.pos): r.mask for r in M.attention_rationale(rows, "g").collect()}
    assert [got[(0, p)] for p in range(4)] == [0, 0, 0, 0]
    assert [got[(1, p)] for p in range(4)] == [0, 0, 1, 0]
