"""Models that Spark ML already has, bound to the cohort's conventions (arrays in, risk out)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardline.operators.survival import ipcw_weights


def _with_vector(df: DataFrame, features: str, out: str = "__vec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


class Risk:
    """A fitted regressor of time read as a risk: minus the predicted time."""

    def __init__(self, model, features: str):
        self.model, self.features = model, features

    def transform(self, df: DataFrame, out: str = "risk_score") -> DataFrame:
        scored = self.model.transform(_with_vector(df, self.features))
        return scored.withColumn(out, -F.col("prediction")).drop("__vec", "prediction")


def time_regression(df: DataFrame, features: str, time: str, ridge: float = 0.01, mix: float = 0.0) -> Risk:
    """Squared-error regression of the observed time."""
    learner = LinearRegression(featuresCol="__vec", labelCol=time, regParam=ridge, elasticNetParam=mix)
    return Risk(learner.fit(_with_vector(df, features)), features)


def boosted_benchmark(
    df: DataFrame, features: str, time: str, event: str, tau: float | None = None, rounds: int = 20, depth: int = 3, seed: int = 42
) -> Risk:
    """Boosted trees on the event times, each event weighted by its inverse censoring probability.

    With ``tau``, times stop there: a row observed up to ``tau`` or longer is known to have reached it, event or not.
    """
    known = df
    if tau is not None:
        reached = F.col(time) >= F.lit(float(tau))
        known = df.withColumn(event, (F.col(event).cast("boolean") | reached).cast(df.schema[event].dataType))
        known = known.withColumn(time, F.when(reached, F.lit(float(tau))).otherwise(F.col(time)))
    weighted = ipcw_weights(df, known, time, event, out="__w").where(F.col("__w") > 0)
    learner = GBTRegressor(featuresCol="__vec", labelCol=time, weightCol="__w", maxIter=rounds, maxDepth=depth, seed=seed)
    return Risk(learner.fit(_with_vector(weighted, features)), features)


def fit_kmeans(df: DataFrame, features: str, k: int, seed: int = 42) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol="cluster").fit(_with_vector(df, features))


def assign_clusters(model: KMeansModel, df: DataFrame, features: str) -> DataFrame:
    return model.transform(_with_vector(df, features)).drop("__vec")


def fit_embedding(df: DataFrame, features: str, k: int) -> PCAModel:
    """Dense representation of a row: its leading principal components."""
    return PCA(k=k, inputCol="__vec", outputCol="__emb").fit(_with_vector(df, features))


def embed_rows(model: PCAModel, df: DataFrame, features: str, out: str = "embedding") -> DataFrame:
    made = model.transform(_with_vector(df, features))
    return made.withColumn(out, vector_to_array("__emb")).drop("__vec", "__emb")
