"""Streaming prediction: a file source of incoming cases → the batch scorer.

Every case is complete inside one micro-batch, so there is no cross-batch
state (no watermark needed).  ``foreachBatch`` runs the same
:func:`predict_cases` as the batch job and writes each micro-batch to its
own ``batch_id=`` folder with overwrite, so a replayed batch after a
failure is idempotent.  ``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.plans.models import predict_cases
from casegrain.session import scratch_path


def stage_cases(cases: DataFrame, landing: str, files: int = 4) -> None:
    """Write incoming cases as several files (each becomes a micro-batch)."""
    cases.repartition(files).write.mode("overwrite").parquet(landing)


def run_prediction_stream(spark: SparkSession, landing: str, schema, classifier, tagger,
                          keys=("case_id",), work: str | None = None,
                          files_per_trigger: int = 1) -> DataFrame:
    work = work or scratch_path(spark, "stream")
    out, ckpt = f"{work}/out", f"{work}/checkpoint"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        scored = predict_cases(batch, classifier, tagger, keys=keys)
        scored.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (src.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return spark.read.parquet(out)
