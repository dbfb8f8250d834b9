"""Whole experiments: features, split, model, evaluation, refit on all rows, scores for the test table.

One description serves training, validation and the final scores, so the model that is measured is
the model that is used. Everything fitted before the metric is fitted on the train part only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardline.operators import cox, graph, models, relational, search
from hazardline.operators.aggregates import top_k_by_score
from hazardline.operators.ensemble import choose_models, fit_per_cluster, mean_of_all, own_cluster_score, route_by_cluster
from hazardline.operators.forest import EXTRA_TREES, FOREST_BASE, FOREST_SMALL, FOREST_TUNED, ForestParams, ModelSpec, fit_forests
from hazardline.operators.importance import permutation_importance
from hazardline.operators.ordering import stratified_split
from hazardline.operators.prepare import Standardizer, assemble_features
from hazardline.operators.survival import TAU, evaluate_by_cluster, evaluate_by_split
from hazardline.operators.tree_table import fit_trees
from hazardline.plans.features import PRESETS, FeatureSpec, fit_features
from hazardline.session import cut_lineage


@dataclass(frozen=True)
class Cohort:
    """Subject and observation tables, and the labels where they are known."""

    subjects: DataFrame
    obs: DataFrame
    labels: DataFrame | None = None


@dataclass(frozen=True)
class Experiment:
    """``learner``: forest, clusters, voting, cox, regression or boosted. ``represent``: None, pca or graph."""

    features: FeatureSpec
    learner: str = "forest"
    params: ForestParams = FOREST_TUNED
    scale: bool = False
    represent: str | None = None
    dims: int = 16
    neighbours: int = 10
    clusters: int = 3
    select_top: int | None = None
    importance: bool = False
    grid: dict | None = None
    grid_metric: str = "ipcw"
    trials: int = 0
    space: dict | None = None
    tau: float = TAU
    key: str = "ID"
    time: str = "OS_YEARS"
    event: str = "OS_STATUS"


@dataclass
class Outcome:
    """What an experiment leaves: a metric row per part, test scores, and the tables made on the way."""

    metrics: DataFrame
    scores: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _of(features: str, **settings) -> Experiment:
    return Experiment(PRESETS[features], **settings)


EXPERIMENTS: dict[str, Experiment] = {
    "forest_base": _of("base10", params=FOREST_BASE),
    "forest_small": _of("base10", params=FOREST_SMALL),
    "forest_text": _of("text10"),
    "forest_sets": _of("text15_sets"),
    "forest_importance": _of("text15_sets", importance=True),
    "forest_selected": _of("text15_sets", select_top=50),
    "forest_pairs": _of("pairs25"),
    "forest_rich": _of("rich30"),
    "forest_rich_age": _of("rich30_age"),
    "forest_embedded": _of("wide30", scale=True, represent="pca"),
    "forest_clusters": _of("values25", learner="clusters", scale=True, clusters=3),
    "extra_sets": _of("text15_sets", params=EXTRA_TREES),
    "extra_embedded": _of("wide30", params=EXTRA_TREES, scale=True, represent="pca"),
    "extra_graph": _of("wide30", params=EXTRA_TREES, scale=True, represent="graph"),
    "extra_density_grid": _of("density15", params=replace(EXTRA_TREES, n_estimators=300), grid=search.GRID_EXTRA, grid_metric="harrell"),
    "extra_entropy_grid": _of("entropy15", params=replace(EXTRA_TREES, n_estimators=300), grid=search.GRID_SMALL, grid_metric="harrell"),
    "grid_base": _of("base10", grid=search.GRID_BASE),
    "grid_text": _of("text10", grid=search.GRID_BASE),
    "random_forest": _of("text15_sets", trials=500, space=search.SPACE_FOREST),
    "random_extra": _of("text15_sets", params=EXTRA_TREES, trials=200, space=search.SPACE_EXTRA),
    "voting": _of("zero15", learner="voting", scale=True, clusters=4),
    "cox": _of("text10_sets", learner="cox", scale=True),
    "time_regression": _of("wide30", learner="regression", scale=True),
    "boosted_subject_only": _of("subject_only", learner="boosted"),
}


def prepare(exp: Experiment, train: Cohort, test: Cohort | None, seed: int = 42) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Rows of both tables as (key, part, time, event, features) and the feature names."""
    labelled = relational.drop_unlabelled(relational.join_labels(train.subjects, train.labels, exp.key), exp.event, exp.time)
    placed = cut_lineage(stratified_split(labelled, exp.key, exp.event, seed=seed))
    fitted = fit_features(exp.features, placed.where("part = 'train'"), train.obs)
    names = fitted.names
    rows = fitted.transform(placed, train.obs, ("part", exp.time, exp.event))
    other = fitted.transform(test.subjects, test.obs) if test else None
    if exp.scale:
        rows = cut_lineage(rows)
        scaler = Standardizer.fit(rows.where("part = 'train'"), names)
        rows, other = scaler.transform(rows), scaler.transform(other) if test else None

    def packed(df: DataFrame) -> DataFrame:
        kept = [c for c in (exp.key, "part", exp.time, exp.event) if c in df.columns]
        return cut_lineage(assemble_features(df, names).select(*kept, "features"))

    return packed(rows), packed(other) if test else None, names


def _represented(exp: Experiment, rows: DataFrame, other: DataFrame | None, names: list[str]):
    if exp.represent == "pca":
        dims = min(exp.dims, len(names))
        pca = models.fit_embedding(rows.where("part = 'train'"), "features", dims)
        swap = lambda df: cut_lineage(models.embed_rows(pca, df.withColumnRenamed("features", "__x"), "__x", "features").drop("__x"))
        return swap(rows), swap(other) if other is not None else None, [f"pc{i}" for i in range(dims)]
    if exp.represent == "graph":
        # one graph over both tables; labels take no part in it
        both = rows.select(exp.key, "features")
        both = both.unionByName(other.select(exp.key, "features")) if other is not None else both
        coded = cut_lineage(both.withColumn("__k", F.xxhash64(exp.key)))
        edges = cut_lineage(graph.knn_graph(coded, "__k", "features", exp.neighbours))
        spread = cut_lineage(graph.propagate_neighbors(coded, "__k", "features", edges, out="__p"))
        swap = lambda df: df.withColumn("__k", F.xxhash64(exp.key)).join(spread, "__k").drop("features", "__k").withColumnRenamed("__p", "features")
        return swap(rows), swap(other) if other is not None else None, names
    return rows, other, names


Scorer = Callable[[DataFrame], DataFrame]


def _fit(exp: Experiment, rows: DataFrame, names: list[str], params: ForestParams) -> Scorer:
    """Fit on ``rows``; the scorer adds ``risk_score``."""
    if exp.learner == "cox":
        model = cox.fit_cox(rows, "features", exp.time, exp.event, len(names))
        return lambda df: df.withColumn("risk_score", model.score_column("features"))
    if exp.learner == "regression":
        return models.time_regression(rows, "features", exp.time).transform
    if exp.learner == "boosted":
        return models.boosted_benchmark(rows, "features", exp.time, exp.event, exp.tau).transform
    forests = fit_forests(rows, [ModelSpec(params)], "features", exp.time, exp.event, exp.key, names=names)
    return lambda df: df.withColumn("risk_score", forests.score_column("features"))


def run_experiment(exp: Experiment, train: Cohort, test: Cohort | None = None) -> Outcome:
    rows, other, names = prepare(exp, train, test)
    if exp.learner == "voting":
        return _voting(exp, rows, other, names)
    rows, other, names = _represented(exp, rows, other, names)
    if exp.learner == "clusters":
        return _clusters(exp, rows, other, names)
    params, tables = exp.params, {}
    learn = rows.where("part = 'train'")
    if exp.grid or exp.trials:
        if exp.grid:
            table = search.grid_search(
                learn, exp.grid, "features", exp.time, exp.event, exp.key, exp.params, metric=exp.grid_metric, tau=exp.tau, names=names
            )
        else:
            table = search.random_search(
                rows.drop("part"), exp.trials, exp.space, "features", exp.time, exp.event, exp.key, exp.params, exp.tau, names=names
            )
        tables["search"] = cut_lineage(table)
        params = search.best_params(tables["search"], exp.params)
    if exp.importance or exp.select_top:
        trees = fit_trees(learn, [ModelSpec(params)], "features", exp.time, exp.event, exp.key, names=names)
        table = permutation_importance(
            trees, rows.where("part = 'valid'"), learn, "features", exp.time, exp.event, exp.key, names, tau=exp.tau
        )
        tables["importance"] = cut_lineage(table)
    if exp.select_top:
        top = top_k_by_score(tables["importance"], "importance", "feature", exp.select_top)
        chosen = sorted(names.index(r["feature"]) for r in top.collect())
        pick = F.array(*[F.col("features")[i] for i in chosen])
        rows, other = rows.withColumn("features", pick), other.withColumn("features", pick) if other is not None else None
        names = [names[i] for i in chosen]
    scored = _fit(exp, rows.where("part = 'train'"), names, params)(rows)
    metrics = evaluate_by_split(scored, "part", exp.time, exp.event, "risk_score", exp.tau)
    scores = None
    if other is not None:
        scores = _fit(exp, rows, names, params)(other).select(F.col(exp.key).alias("ID"), "risk_score")
    return Outcome(metrics, scores, tables)


def _clusters(exp: Experiment, rows: DataFrame, other: DataFrame | None, names: list[str]) -> Outcome:
    """A forest per cluster; the test score is the mean over all of them."""
    learn = rows.where("part = 'train'")
    clusters = models.fit_kmeans(learn, "features", exp.clusters)
    placed = cut_lineage(models.assign_clusters(clusters, rows, "features"))
    fit = lambda df: fit_per_cluster(df, "cluster", exp.clusters, exp.params, "features", exp.time, exp.event, exp.key, names)
    scored = own_cluster_score(fit(placed.where("part = 'train'")), placed, "cluster", "features")
    metrics = evaluate_by_split(scored, "part", exp.time, exp.event, "risk_score", exp.tau)
    scores = None
    if other is not None:
        scores = mean_of_all(fit(placed), other, "features").select(F.col(exp.key).alias("ID"), "risk_score")
    return Outcome(metrics, scores)


def _voting(exp: Experiment, rows: DataFrame, other: DataFrame | None, names: list[str]) -> Outcome:
    """Two models, one on the features and one on their embedding; each cluster uses its better one."""
    learn = rows.where("part = 'train'")
    pca = models.fit_embedding(learn, "features", min(exp.dims, len(names)))
    clusters = models.fit_kmeans(rows, "features", exp.clusters)

    def enrich(df: DataFrame) -> DataFrame:
        return cut_lineage(models.assign_clusters(clusters, models.embed_rows(pca, df, "features"), "features"))

    rows = enrich(rows)
    learn = rows.where("part = 'train'")
    extra_params = replace(EXTRA_TREES, n_estimators=min(exp.params.n_estimators, EXTRA_TREES.n_estimators), max_depth=exp.params.max_depth)
    plain = fit_forests(learn, [ModelSpec(exp.params)], "features", exp.time, exp.event, exp.key, names=names)
    embedded = fit_forests(learn, [ModelSpec(extra_params)], "embedding", exp.time, exp.event, exp.key)

    def both(df: DataFrame) -> DataFrame:
        return df.withColumns({"forest": plain.score_column("features"), "extra": embedded.score_column("embedding")})

    scored = cut_lineage(both(rows))
    by_cluster = cut_lineage(evaluate_by_cluster(scored, "cluster", exp.time, exp.event, ["forest", "extra"], exp.tau))
    choices = choose_models(by_cluster, "cluster", "forest")
    routed = route_by_cluster(scored, "cluster", choices, ["forest", "extra"], "forest")
    metrics = evaluate_by_split(routed, "part", exp.time, exp.event, "risk_score", exp.tau)
    scores = None
    if other is not None:
        scores = route_by_cluster(both(enrich(other)), "cluster", choices, ["forest", "extra"], "forest").select(
            F.col(exp.key).alias("ID"), "risk_score"
        )
    return Outcome(metrics, scores, {"clusters": by_cluster})
