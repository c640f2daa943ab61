"""Fitted models with what is needed to use them again."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(spark: SparkSession, model: PipelineModel, path: str, facts: dict, predictions: DataFrame | None = None) -> None:
    """The pipeline, its facts (features, target, unit, metrics) as JSON and, where given, the predictions with their row ids."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    if predictions is not None:
        predictions.write.mode("overwrite").parquet(f"{path}/predictions")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/facts").first().value)
