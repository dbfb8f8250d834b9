"""Many categories, all pairs of items, and the forest as an ML stage."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from hazardline.operators.aggregates import pair_counts
from hazardline.operators.estimator import MetricEvaluator, SurvivalForest, SurvivalForestModel
from hazardline.operators.evaluator import ConcordanceEvaluator
from hazardline.operators.prepare import WideOneHot
from hazardline.operators.survival import harrell_cindex


@pytest.mark.parametrize("block_items", [256, 2])
def test_pair_counts_equal_brute_force(spark, block_items):
    rng = np.random.default_rng(5)
    rows = [("hot", f"i{j}") for j in range(30) for _ in range(3)]
    rows += [(f"s{rng.integers(20)}", f"i{rng.integers(12)}") for _ in range(80)] + [(None, "i1"), ("s1", None)]
    want = {}
    for s in {k for k, _ in rows if k}:
        for pair in combinations(sorted({i for k, i in rows if k == s and i}), 2):
            want[pair] = want.get(pair, 0) + 1
    got = pair_counts(spark.createDataFrame(rows, "id string, gene string"), "id", "gene", block_items).collect()
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)
    assert pair_counts(spark.createDataFrame([], "id string, gene string"), "id", "gene").count() == 0


@pytest.mark.parametrize("missing_level", [False, True])
def test_a_million_categories_encode(spark, missing_level):
    df = spark.range(1_000_000).select(F.format_string("c%07d", "id").alias("c"))
    hot = WideOneHot.fit(df, "c", missing_level)
    rows = spark.createDataFrame([("c0000000", 1), ("c0999999", 2), ("c0123456", 3), ("new", 4), (None, 5)], "c string, slot int")
    got = {r.slot: r.v for r in hot.transform(rows, "v").collect()}
    width = 1_000_000 + missing_level
    assert all(v.size == width for v in got.values())
    where = {k: list(v.indices) for k, v in got.items()}
    assert where == {1: [0], 2: [999_999], 3: [123_456], 4: [], 5: [1_000_000] if missing_level else []}


def test_no_categories(spark):
    with pytest.raises(ValueError, match="no value"):
        WideOneHot.fit(spark.createDataFrame([(None,)], "c string"), "c")


def test_forest_is_tuned_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    t = rng.exponential(np.exp(-2 * x[:, 0]))
    rows = [(str(i), float(t[i]), int(rng.random() < 0.8), [float(v) for v in x[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, time double, event int, features array<double>")
    forest = SurvivalForest(numTrees=4, maxDepth=4)
    grid = ParamGridBuilder().addGrid(forest.minSamplesLeaf, [3, 58]).build()
    metric = MetricEvaluator(lambda scored: harrell_cindex(scored, "time", "event", "risk_score").first()["cindex"])
    found = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=metric, numFolds=2, seed=1).fit(df)
    assert found.avgMetrics[0] > max(0.7, found.avgMetrics[1])
    best = found.bestModel
    best.write().overwrite().save(str(tmp_path / "model"))
    again = SurvivalForestModel.load(str(tmp_path / "model"))
    scores = [{r.id: r.risk_score for r in m.transform(df).collect()} for m in (best, again)]
    assert scores[0] == scores[1] and again.uid == best.uid
    assert ConcordanceEvaluator().evaluate(again.transform(df)) > 0.7
    forest.save(str(tmp_path / "forest"))
    assert SurvivalForest.load(str(tmp_path / "forest")).settings() == forest.settings()
    with pytest.raises(ValueError):
        SurvivalForest(maxFeatures="some").fit(df)
