import math

import pytest
from pyspark.sql import functions as F

from hazardline.functions import vectors as V
from hazardline.operators import ordering as O
from hazardline.operators import search as S
from hazardline.operators.importance import shuffled_pairs


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"r{i}", int(i % 10 < 3)) for i in range(1003)], "id string, event int")


def test_split_is_exact_and_stable(rows):
    def parts(df):
        return {r["id"]: (r["event"], r["part"]) for r in O.stratified_split(df, "id", "event").collect()}

    one = parts(rows)
    assert one == parts(rows.repartition(13))
    for e in (0, 1):
        n = sum(ev == e for ev, _ in one.values())
        assert sum(v == (e, "valid") for v in one.values()) == math.ceil(0.2 * n)


def test_folds_are_even_and_split_hot_keys_apart(rows, spark):
    folds = [r["fold"] for r in O.kfold_assign(rows, "id", 3).collect()]
    assert sorted(folds.count(f) for f in (1, 2, 3)) == [334, 334, 335]
    tiny = O.kfold_assign(rows.limit(2), "id", 3).collect()
    assert sorted(r["fold"] for r in tiny) == [1, 2]
    # one key on a third of the rows stays in one fold; every row still gets one
    hot = rows.limit(20).unionByName(spark.range(10).select(F.lit("hot").alias("id"), F.lit(0).alias("event")))
    got = O.kfold_assign(hot, "id", 3).collect()
    assert len(got) == 30 and len({r["fold"] for r in got if r["id"] == "hot"}) == 1


def test_hash_rank_is_a_permutation(rows):
    ranks = O.hash_rank(rows, "id", salt="x").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 1004))
    other = {r["id"]: r["rank"] for r in O.hash_rank(rows, "id", salt="y").collect()}
    assert any(other[r["id"]] != r["rank"] for r in ranks)


def test_shuffled_pairs_permute_rows(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(200)], "id string, v int")
    got = shuffled_pairs(df, "id", "v", 2, 7).collect()
    for r in (0, 1):
        assert sorted(x["donor"] for x in got if x["repeat"] == r) == list(range(200))
    assert [x["donor"] for x in sorted(got, key=lambda x: x["v"]) if x["repeat"] == 0] != [x["donor"] for x in sorted(got, key=lambda x: x["v"]) if x["repeat"] == 1]


def test_edges_isolate_hot_values():
    cuts, hot = O.edges_from_quantiles([1.0, 2.0, 2.0, 2.0, 5.0])
    assert cuts[1] == 2.0 and 2.0 < cuts[2] < 2.0000001 and hot == [2]


def test_corruption_shares_and_independence(spark):
    df = spark.range(2000).select("id", F.array(*[F.lit(1.0)] * 20).alias("v"))
    masked = df.select(V.mask_features_zero(F.col("v"), F.col("id"), 20, 0.25).alias("m"), *V.two_views(F.col("v"), F.col("id"), 20, 0.25))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + (1 - x))
    row = masked.agg(
        F.sum(total("m")), F.sum(total("view_a")), F.sum(F.aggregate(F.zip_with("view_a", "view_b", lambda a, b: (1 - a) * (1 - b)), F.lit(0.0), lambda s, x: s + x))
    ).first()
    assert row[0] / 40000 == pytest.approx(0.25, abs=0.01) and row[1] / 40000 == pytest.approx(0.25, abs=0.01)
    assert row[2] / 40000 == pytest.approx(0.0625, abs=0.01)
    noisy = df.select(F.explode(V.mask_features_noise(F.col("v"), F.array(*[F.lit(5.0)] * 20), F.col("id"), 20, 0.5)).alias("x"))
    row = noisy.where("x <> 1.0").agg(F.count("x"), F.avg("x"), F.stddev("x")).first()
    assert row[0] / 40000 == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(5, abs=0.01) and row[2] == pytest.approx(0.1, abs=0.01)
    moved = df.select(*V.perturb_selected(F.col("v"), [3], F.col("id"))).first()
    assert moved["perturbed"][3] != 1.0 and moved["perturbed"][2] == 1.0 and moved["mask"] == [0.0] * 3 + [1.0] + [0.0] * 16


def test_trial_tables(spark):
    assert len(S.grid_trials(S.GRID_BASE)) == 24 and len(S.grid_trials(S.GRID_EXTRA)) == 32
    trials = S.collect_trials(S.random_trials(spark, 300, S.SPACE_EXTRA))
    assert trials == S.collect_trials(S.random_trials(spark, 300, S.SPACE_EXTRA))
    assert {t["max_features"] for t in trials} == {"sqrt", "log2", None}
    leaves = [t["min_samples_leaf"] for t in trials]
    assert min(leaves) == 1 and max(leaves) == 10 and all(100 <= t["n_estimators"] <= 500 for t in trials)
