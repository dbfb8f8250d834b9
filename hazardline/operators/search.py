"""Parameter searches as one forest job: every trial and fold is a set of trees in the same levels.

Trees are numbered, and tree i of a setting does not depend on how many trees there are. Trials that
differ only in ``n_estimators`` therefore share one forest, scored on its leading trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardline.operators.forest import ForestParams, Forests, ModelSpec, fit_forests
from hazardline.operators.ordering import kfold_assign, stratified_split
from hazardline.operators.survival import TAU, concordance, ipcw_weights

Trial = dict[str, object]

# The reference's grids and search spaces.
GRID_BASE = {"n_estimators": [100, 200, 300], "min_samples_split": [5, 10], "min_samples_leaf": [5, 10], "max_features": ["sqrt", "log2"]}
GRID_EXTRA = {"n_estimators": [100, 150, 200, 300], "min_samples_split": [5, 10], "min_samples_leaf": [5, 10], "max_features": ["sqrt", 0.5]}
GRID_SMALL = {"n_estimators": [300], "min_samples_split": [5], "min_samples_leaf": [5], "max_features": ["sqrt", 0.5]}
SPACE_FOREST = {"n_estimators": (100, 400), "min_samples_split": (2, 20), "min_samples_leaf": (2, 20), "max_features": ["sqrt", "log2"]}
SPACE_EXTRA = {"n_estimators": (100, 500), "min_samples_split": (2, 10), "min_samples_leaf": (1, 10), "max_features": ["sqrt", "log2", None]}


def grid_trials(grid: Mapping[str, Sequence[object]]) -> list[Trial]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def random_trials(spark: SparkSession, n: int, space: Mapping[str, object], seed: int = 42) -> DataFrame:
    """Trial table: per parameter an even draw from an inclusive (low, high) range or a list of choices."""

    def draw(name: str, options: object):
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("param_id").cast("string")))
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        if isinstance(options, tuple):
            low, high = options
            return (number % F.lit(high - low + 1) + F.lit(low)).cast("string")
        texts = F.array(*[F.lit("None" if o is None else str(o)) for o in options])
        return F.element_at(texts, (number % F.lit(len(options)) + 1).cast("int"))

    ids = spark.range(n).select(F.col("id").cast("int").alias("param_id"))
    return ids.select("param_id", *[draw(name, options).alias(name) for name, options in space.items()])


def _parsed(name: str, text: str) -> object:
    if name == "max_features":
        if text == "None":
            return None
        return text if text.isalpha() or text.startswith("log") else float(text)
    return int(text)


def collect_trials(table: DataFrame) -> list[Trial]:
    """A trial table as keyword settings, in order; its size is the number of trials asked for."""
    names = [c for c in table.columns if c != "param_id"]
    return [{n: _parsed(n, r[n]) for n in names} for r in table.orderBy("param_id").collect()]


def _families(trials: Sequence[Trial], base: ForestParams) -> tuple[dict[ForestParams, dict[int, int]], dict[int, str]]:
    """Settings without the tree count -> {trial: tree count}; and the messages of impossible trials."""
    families: dict[ForestParams, dict[int, int]] = {}
    failed: dict[int, str] = {}
    for i, trial in enumerate(trials):
        try:
            params = replace(base, **trial).checked()
        except (TypeError, ValueError) as error:
            failed[i] = str(error)
            continue
        families.setdefault(replace(params, n_estimators=1), {})[i] = params.n_estimators
    return families, failed


def _score_trials(forests: Forests, rows: DataFrame, scored_by: list[dict[int, tuple[int, int]]]) -> DataFrame:
    """Long scores (param_id, grp, t, ev, w, risk): per row group, the trials evaluated on it.

    ``scored_by[g]`` maps trial -> (forest number, tree count) for the rows of group g.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            bins = forests.bin_rows(np.vstack(b["x"].to_numpy()))
            groups = b["grp"].to_numpy()
            for g in np.unique(groups):
                mine = groups == g
                by_forest: dict[int, dict[int, int]] = {}
                for trial, (forest, trees) in scored_by[g].items():
                    by_forest.setdefault(forest, {})[trial] = trees
                for forest, wanted in by_forest.items():
                    upto = sorted(set(wanted.values()))
                    risks = forests.risks(bins[mine], forest, upto)
                    part = b.loc[mine, ["grp", "t", "ev", "w"]]
                    for trial, trees in wanted.items():
                        yield part.assign(param_id=np.int32(trial), risk=risks[:, upto.index(trees)])

    return rows.mapInPandas(run, "param_id int, grp int, t double, ev int, w double, risk double")


def _slim(df: DataFrame, features: str, time: str, event: str, weight) -> DataFrame:
    return df.select(
        F.col(features).alias("x"), "grp", F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("ev"), weight.alias("w")
    )


def _table(spark: SparkSession, trials: Sequence[Trial], base: ForestParams, failed: dict[int, str], scores: DataFrame) -> DataFrame:
    """One row per trial, best first: its settings, mean score and, for a failed one, score 0 and why."""
    settings = ["n_estimators", "min_samples_split", "min_samples_leaf", "max_features", "splitter"]
    rows = []
    for i, trial in enumerate(trials):
        shown = {**asdict(base), **trial}
        rows.append((i, *[str(shown[s]) for s in settings], failed.get(i)))
    schema = "param_id int, " + ", ".join(f"{s} string" for s in settings) + ", error string"
    listed = spark.createDataFrame(rows, schema)
    joined = listed.join(scores, "param_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    # trial count rows: a plain order over the whole small table
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "param_id")))


def grid_search(
    df: DataFrame,
    grid: Mapping[str, Sequence[object]],
    features: str,
    time: str,
    event: str,
    key: str,
    base: ForestParams = ForestParams(),
    folds: int = 3,
    metric: str = "ipcw",
    tau: float | None = TAU,
    names: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean k-fold score of every grid point: "ipcw" (weights from the fold itself) or "harrell"."""
    trials = grid_trials(grid)
    families, failed = _families(trials, base)
    placed = kfold_assign(df, key, folds, seed, "grp").withColumn("grp", F.col("grp") - 1)
    specs, scored_by = [], [dict() for _ in range(folds)]
    for params, members in families.items():
        for g in range(folds):
            rest = tuple(i for i in range(folds) if i != g)
            specs.append(ModelSpec(replace(params, n_estimators=max(members.values())), rest))
            scored_by[g].update({trial: (len(specs) - 1, trees) for trial, trees in members.items()})
    if metric not in ("ipcw", "harrell"):
        raise ValueError(f"unknown metric {metric!r}")
    scores = df.sparkSession.createDataFrame([], "param_id int, score double, folds int")
    if specs:
        forests = fit_forests(placed, specs, features, time, event, key, "grp", names)
        if metric == "ipcw":
            weighted = ipcw_weights(placed, placed, time, event, ["grp"], tau, "__w")
            slim = _slim(weighted, features, time, event, F.col("__w") * F.col("__w"))
        else:
            slim = _slim(placed, features, time, event, F.lit(1.0))
        long = _score_trials(forests, slim, scored_by)
        per_fold = concordance(long, "t", "ev", "risk", "w", ["param_id", "grp"])
        scores = per_fold.groupBy("param_id").agg(F.avg("cindex").alias("score"), F.count("cindex").cast("int").alias("folds"))
    return _table(df.sparkSession, trials, base, failed, scores)


def random_search(
    df: DataFrame,
    n_trials: int,
    space: Mapping[str, object],
    features: str,
    time: str,
    event: str,
    key: str,
    base: ForestParams = ForestParams(),
    tau: float | None = TAU,
    share: float = 0.2,
    names: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Every trial fitted on the same train part and scored on the same held-out part."""
    spark = df.sparkSession
    trials = collect_trials(random_trials(spark, n_trials, space, seed))
    families, failed = _families(trials, base)
    placed = stratified_split(df, key, event, share, seed, "__part").withColumn("grp", (F.col("__part") == "valid").cast("int"))
    specs, valid = [], {}
    for params, members in families.items():
        specs.append(ModelSpec(replace(params, n_estimators=max(members.values())), (0,)))
        valid.update({trial: (len(specs) - 1, trees) for trial, trees in members.items()})
    scores = spark.createDataFrame([], "param_id int, score double")
    if specs:
        forests = fit_forests(placed, specs, features, time, event, key, "grp", names)
        held = ipcw_weights(placed.where("grp = 0"), placed.where("grp = 1"), time, event, tau=tau, out="__w")
        long = _score_trials(forests, _slim(held, features, time, event, F.col("__w") * F.col("__w")), [{}, valid])
        metric = concordance(long, "t", "ev", "risk", "w", ["param_id"])
        scores = metric.select("param_id", F.col("cindex").alias("score"))
    return _table(spark, trials, base, failed, scores)


def best_params(table: DataFrame, base: ForestParams = ForestParams()) -> ForestParams:
    """Settings of the first-ranked trial."""
    row = table.where("rank = 1").first()
    if row["error"]:
        raise ValueError("every trial failed: " + row["error"])
    found = {n: _parsed(n, row[n]) for n in ("n_estimators", "min_samples_split", "min_samples_leaf", "max_features")}
    return replace(base, **found, splitter=row["splitter"])


def refit_and_score(
    table: DataFrame, train: DataFrame, test: DataFrame, features: str, time: str, event: str, key: str,
    base: ForestParams = ForestParams(), names: Sequence[str] | None = None, out: str = "risk_score",
) -> DataFrame:
    """The best settings fitted on every train row, and the test table's scores."""
    forests = fit_forests(train, [ModelSpec(best_params(table, base))], features, time, event, key, names=names)
    return test.select(key, forests.score_column(features).alias(out))
