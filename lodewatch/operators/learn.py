"""Calibration by logistic regression with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, features: Sequence[str], label: str, penalty: float = 0.01) -> LogisticRegressionModel:
    """A model on standardised features with an L2 penalty on the weights alone."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return LogisticRegression(labelCol=label, regParam=penalty, elasticNetParam=0.0, maxIter=100).fit(vectors)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with p (the chance of 1) and predicted."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    scored = model.transform(vectors).withColumn("p", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("predicted", (F.col("p") >= 0.5).cast("int"))
