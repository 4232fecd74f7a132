"""Boosted trees by MLlib, with nulls as a value of their own: missing features get 0 and an indicator."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features} | {f"_no_{c}": F.col(c).isNull().cast("double") for c in features})
    return VectorAssembler(inputCols=[f"{p}{c}" for c in features for p in ("_", "_no_")], outputCol="features").transform(filled)


def fit_predict(train: DataFrame, ask: DataFrame, features: list[str], target: str, loss: str = "squared", rounds: int = 20, depth: int = 4) -> DataFrame:
    """ask with `pred`."""
    model = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="pred", lossType=loss, maxIter=rounds, maxDepth=depth, seed=0)
    fitted = model.fit(assembled(train.where(F.col(target).isNotNull()), features).select("features", target))
    out = fitted.transform(assembled(ask, features))
    return out.select(*ask.columns, "pred")


def capacity_factor(df: DataFrame, value: str, capacity: str) -> DataFrame:
    """value / capacity as `cf`; null where there is no capacity."""
    return df.withColumn("cf", F.when(F.col(capacity) > 0, F.col(value) / F.col(capacity)))


def from_capacity_factor(df: DataFrame, capacity: str) -> DataFrame:
    """pred back to MW, not below zero."""
    return df.withColumn("pred", F.greatest(F.lit(0.0), F.col("pred") * F.col(capacity)))
