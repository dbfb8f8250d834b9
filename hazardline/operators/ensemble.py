"""Cluster-wise models and per-cluster choice between models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardline.operators.forest import ForestParams, Forests, ModelSpec, fit_forests


def fit_per_cluster(
    df: DataFrame, cluster: str, k: int, params: ForestParams, features: str, time: str, event: str, key: str, names: Sequence[str] | None = None
) -> Forests:
    """One forest per cluster 0..k-1, all grown in the same jobs."""
    return fit_forests(df, [ModelSpec(params, (c,)) for c in range(k)], features, time, event, key, cluster, names)


def mean_of_all(forests: Forests, df: DataFrame, features: str, out: str = "risk_score") -> DataFrame:
    """Plain mean over all cluster models, whatever the row's own cluster."""
    scores = forests.score_all_column(features)
    total = F.aggregate("__all", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("__all", scores).withColumn(out, total / F.size("__all")).drop("__all")


def own_cluster_score(forests: Forests, df: DataFrame, cluster: str, features: str, out: str = "risk_score") -> DataFrame:
    """Each row scored by the model of its own cluster."""
    return df.withColumn(out, F.element_at(forests.score_all_column(features), F.col(cluster) + 1))


def choose_models(metrics: DataFrame, cluster: str, default: str) -> DataFrame:
    """Best model per cluster from (cluster, model, cindex) rows; the default keeps ties."""
    best = Window.partitionBy(cluster).orderBy(F.desc_nulls_last("cindex"), (F.col("model") != default), "model")
    return (
        metrics.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(cluster, F.col("model").alias("choice"))
    )


def route_by_cluster(
    scored: DataFrame, cluster: str, choices: DataFrame, risks: Sequence[str], default: str, out: str = "risk_score"
) -> DataFrame:
    """The chosen model's score; a cluster without a choice uses the default model."""
    joined = scored.join(choices, cluster, "left")
    pick = F.coalesce("choice", F.lit(default))
    value = F.when(pick == risks[0], F.col(risks[0]))
    for r in risks[1:]:
        value = value.when(pick == r, F.col(r))
    return joined.withColumn("choice", pick).withColumn(out, value)
