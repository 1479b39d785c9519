"""Trained scorers of transcripts and events with pyspark.ml: forests and boosted trees over numeric features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, features: list[str], label: str, kind: str = "forest", trees: int = 50, depth: int = 6, seed: int = 42) -> PipelineModel:
    """A model of 0/1 labels; rows with a null or non-finite feature are passed over."""
    make = {"forest": lambda: RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed), "boosted": lambda: GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)}
    if kind not in make:
        raise ValueError(f"kind must be one of {sorted(make)}")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), make[kind]()]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with the probability of label 1."""
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction").withColumn("score", F.round("score", 9))
