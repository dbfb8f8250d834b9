"""Boosted benchmark: rows that outlive the horizon take part."""

from hazardline.operators.models import boosted_benchmark


def test_survivors_past_the_horizon_are_learnt_from(spark):
    # the long-lived half is known by its feature and has no event before the horizon
    rows = [([0.0], 1.0 + i % 5, 1) for i in range(60)] + [([1.0], 20.0 + i % 7, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "features array<double>, time double, event int")
    model = boosted_benchmark(df, "features", "time", "event", tau=10.0, rounds=2)
    risk = {r.features[0]: r.risk_score for r in model.transform(df.dropDuplicates(["features"])).collect()}
    assert abs(risk[1.0] + 10.0) < 0.5
    assert abs(risk[0.0] + 3.0) < 0.5
