import random
from bisect import bisect, insort

import pytest
from pyspark.sql import functions as F

from hazardline.operators import ordering as O
from hazardline.operators import survival as S

FIXTURE = [("A", 1.0, 1, 9.0), ("B", 2.0, 0, 4.0), ("C", 3.0, 1, 7.0), ("D", 4.0, 1, 7.0), ("E", 5.0, 0, 1.0)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(FIXTURE, "id string, time double, event int, risk double")


def curve(df, col):
    return {r["time"]: r[col] for r in df.collect()}


def test_curves_match_the_worked_fractions(labels):
    km = curve(S.kaplan_meier(labels, "time", "event"), "survival")
    assert [km[t] for t in (1, 3, 4)] == pytest.approx([4 / 5, 8 / 15, 4 / 15])
    na = curve(S.nelson_aalen(labels, "time", "event"), "hazard")
    assert [na[t] for t in (1, 3, 4)] == pytest.approx([1 / 5, 8 / 15, 31 / 30])
    g = curve(S.kaplan_meier(labels, "time", "event", reverse=True), "survival")
    assert [g[t] for t in (1, 2, 3, 4, 5)] == pytest.approx([1, 3 / 4, 3 / 4, 3 / 4, 0])


def test_weights(labels):
    rows = S.ipcw_weights(labels, labels, "time", "event").collect()
    weights = {r["id"]: r["weight"] for r in rows}
    assert [weights[i] for i in "ABCDE"] == pytest.approx([1, 0, 4 / 3, 4 / 3, 0])


def test_concordance_fractions(labels):
    one = lambda df: df.first()["cindex"]
    assert one(S.harrell_cindex(labels, "time", "event", "risk")) == pytest.approx(13 / 14)
    assert one(S.ipcw_cindex(labels, labels, "time", "event", "risk", None)) == pytest.approx(19 / 21)
    assert one(S.ipcw_cindex(labels, labels, "time", "event", "risk", 3.5)) == pytest.approx(15 / 17)
    flipped = labels.withColumn("risk", -F.col("risk"))
    assert one(S.ipcw_cindex(labels, flipped, "time", "event", "risk", None)) == pytest.approx(2 / 21)


def test_equal_times_and_degenerate_labels(spark, labels):
    schema = "id string, time double, event int, risk double"
    tied = spark.createDataFrame([("a", 1.0, 1, 2.0), ("b", 1.0, 0, 1.0), ("c", 1.0, 1, 0.0)], schema)
    row = S.harrell_cindex(tied, "time", "event", "risk").first()
    assert (row["numerator"], row["denominator"]) == (1.0, 2.0)
    all_events = spark.createDataFrame([(str(i), float(i), 1, 1.0) for i in range(4)], schema)
    assert {r["weight"] for r in S.ipcw_weights(all_events, all_events, "time", "event").collect()} == {1.0}
    censored = labels.withColumn("event", F.lit(0))
    with pytest.raises(Exception, match="no comparable pairs"):
        S.require_pairs(S.harrell_cindex(censored, "time", "event", "risk")).collect()
    late = spark.createDataFrame([("z", 9.0, 1, 1.0)], schema)
    ends_in_event = labels.withColumn("event", F.lit(1)).unionByName(labels.limit(1).withColumn("event", F.lit(0)))
    with pytest.raises(Exception, match="beyond the train labels"):
        S.ipcw_weights(ends_in_event, late, "time", "event").collect()
    with pytest.raises(Exception, match="zero at an event time"):
        S.ipcw_weights(labels, late, "time", "event").collect()


def brute(rows):
    num = den = 0.0
    for _, ti, ei, ri, wi in rows:
        if not ei:
            continue
        for _, tj, ej, rj, _ in rows:
            if tj > ti or (tj == ti and not ej):
                den += wi
                num += wi * (1.0 if rj < ri else 0.5 if rj == ri else 0.0)
    return num, den


@pytest.mark.parametrize("seed,times,risks", [(1, 7, 5), (2, 400, 400), (3, 400, 3), (4, 3, 400), (5, 60, 30)])
def test_bucketed_concordance_equals_all_pairs(spark, seed, times, risks):
    rnd = random.Random(seed)
    rows = [
        # a third of the rows share one time, another third one risk
        (
            i % 2,
            3.0 if rnd.random() < 0.33 else rnd.randrange(times) / 7,
            int(rnd.random() < 0.5),
            2.0 if rnd.random() < 0.33 else rnd.randrange(risks) / 3,
            rnd.choice([0.5, 1.0, 2.0]),
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "g int, time double, event int, risk double, w double")
    got = {r["g"]: r for r in S.concordance(df, "time", "event", "risk", "w", ["g"], rows_per_strip=40).collect()}
    for g in (0, 1):
        num, den = brute([r for r in rows if r[0] == g])
        assert got[g]["numerator"] == pytest.approx(num) and got[g]["denominator"] == pytest.approx(den)
    whole = S.concordance(df, "time", "event", "risk", "w", rows_per_strip=40).first()
    num, den = brute(rows)
    assert whole["numerator"] == pytest.approx(num) and whole["denominator"] == pytest.approx(den)


def test_concordance_writes_each_row_once_at_any_number_of_ranges(spark, monkeypatch):
    written = []

    def counted(cut):
        def run(df, *args):
            out = cut(df, *args)
            written.append(out.count())
            return out

        return run

    monkeypatch.setattr(S, "stage_table", counted(S.stage_table))
    monkeypatch.setattr(O, "cut_lineage", counted(O.cut_lineage))
    n = 120_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("time"), (F.col("id") % 2).alias("event"), (F.col("id") * 104729 % n).alias("risk"))
    row = S.harrell_cindex(df, "time", "event", "risk", rows_per_strip=4000).first()
    assert sum(written) < 2 * n
    order = sorted(df.collect())
    seen, good, pairs = [], 0, 0
    for i, r in enumerate(reversed(order)):
        if r["event"]:
            good, pairs = good + bisect(seen, r["risk"]), pairs + i
        insort(seen, r["risk"])
    assert (row["numerator"], row["denominator"]) == (good, pairs)


@pytest.mark.parametrize("top", [float("inf"), 1e300, 0.0])
def test_concordance_of_odd_scores(spark, top):
    rnd = random.Random(4)
    rows = [(0, rnd.randrange(90) / 7, int(rnd.random() < 0.5), rnd.choice([-0.0, 0.0, 1.0, -1.0, top, -top]), rnd.choice([0.0, 1.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, time double, event int, risk double, w double")
    row = S.concordance(df, "time", "event", "risk", "w", rows_per_strip=10).first()
    assert (row["numerator"], row["denominator"]) == pytest.approx(brute(rows))


def test_bucketed_curves_equal_plain_ones(spark):
    rnd = random.Random(9)
    rows = [(str(i), rnd.randrange(150) / 10, int(rnd.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, time double, event int")
    for fn, col in ((S.kaplan_meier, "survival"), (S.nelson_aalen, "hazard")):
        plain, cut = curve(fn(df, "time", "event"), col), curve(fn(df, "time", "event", rows_per_bucket=20), col)
        assert plain.keys() == cut.keys()
        assert [cut[t] for t in plain] == pytest.approx(list(plain.values()))


def test_monotone_maps_keep_concordance_and_negation_turns_it(labels):
    c = lambda expr: S.harrell_cindex(labels.withColumn("risk", expr), "time", "event", "risk").first()["cindex"]
    assert c(F.exp("risk") * 3) == pytest.approx(c(F.col("risk")))
    assert c(-F.col("risk")) == pytest.approx(1 - c(F.col("risk")))


def test_step_lookup(spark):
    steps = spark.createDataFrame([(float(t), t / 100) for t in range(0, 100, 3)], "t double, v double")
    queries = spark.createDataFrame([(i, i * 0.37 - 1) for i in range(300)] + [(1000 + i, 50.0) for i in range(300)], "q int, t double")
    for per_bucket in (10_000, 25):
        for r in O.step_lookup(queries, steps, "t", "v", per_bucket, default=-1.0).collect():
            want = -1.0 if r["t"] < 0 else min(int(r["t"] // 3) * 3, 99) / 100
            assert r["v"] == pytest.approx(want)


def test_evaluator(labels):
    from hazardline.operators.evaluator import ConcordanceEvaluator

    scored = labels.withColumnRenamed("risk", "risk_score")
    assert ConcordanceEvaluator().evaluate(scored) == pytest.approx(13 / 14)
    assert ConcordanceEvaluator(train=labels, tau=3.5).evaluate(scored) == pytest.approx(15 / 17)
    assert ConcordanceEvaluator().isLargerBetter()
    with pytest.raises(ValueError, match="no comparable pairs"):
        ConcordanceEvaluator().evaluate(scored.withColumn("event", F.lit(0)))


def test_lost_labels_are_errors(spark, labels):
    rows = spark.createDataFrame([("A", 1.0, 1, 9.0), ("B", None, 1, 4.0)], "id string, time double, event int, risk double")
    for make in (lambda: S.harrell_cindex(rows, "time", "event", "risk"), lambda: S.ipcw_weights(labels, rows, "time", "event")):
        with pytest.raises(Exception, match="missing time"):
            make().collect()


def test_null_groups_keep_their_weights(spark):
    rows = [(g, float(t), int(t % 3 != 0), float(-t)) for g in (None, "a") for t in range(1, 9)]
    df = spark.createDataFrame(rows, "part string, time double, event int, risk double")
    got = S.ipcw_weights(df, df, "time", "event", ["part"]).groupBy("part").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert len(got) == 2 and got[0]["w"] == pytest.approx(got[1]["w"]) and got[0]["n"] == got[1]["n"] == 8
