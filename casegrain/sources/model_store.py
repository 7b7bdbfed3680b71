"""Saved models: written under the shared folder, loaded from an ordered list of places.

The order is the chain of training: the rationale model's folder first, then
the classifier's, then the distilled one's.  A place that doesn't exist is
passed over; any other failure is an error, so scoring never changes method
because a store had a hiccup.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_first(spark: SparkSession, paths: list[str], required: bool = False) -> PipelineModel | None:
    """The first model of ``paths`` that is there; none is null, or an error if one is required."""
    for p in paths:
        if exists(spark, p):
            return PipelineModel.load(p)
    if required:
        raise FileNotFoundError(f"no saved model at any of {paths}")
    return None
