"""Every kind of experiment end to end on a small made cohort with a known hazard."""

from dataclasses import replace

import numpy as np
import pytest

from hazardline.operators.forest import ForestParams
from hazardline.operators.forest import fit_forests, ModelSpec
from hazardline.plans import experiments as E
from hazardline.sources import tables as T
from hazardline.streaming.scoring import score_stream, write_score_stream

GENES = ["TET2", "TP53", "FLT3", "NPM1", "RUNX1", "EZH2", "ASXL1", "KIT", "CEBPA", "WT1", "SRSF2", "IDH1"]


def cohort(spark, n, seed, labelled=True):
    rng = np.random.default_rng(seed)
    subjects, obs, labels = [], [], []
    for i in range(n):
        key = f"S{seed}_{i}"
        blast, hb = rng.uniform(0, 100), rng.normal(10, 2)
        bad = rng.random() < 0.3
        text = "46,XY" + (",-7,del(5q),inv(3)" if bad else ",+8" if rng.random() < 0.2 else "")
        subjects.append((key, f"C{rng.integers(5)}", float(blast), 5.0, None if rng.random() < 0.2 else 1.0, 0.5, float(hb), 100.0, text))
        has = rng.random(len(GENES)) < 0.2
        obs += [(key, "7" if g == "EZH2" else "1", g, float(rng.uniform(0, 0.6))) for g, h in zip(GENES, has) if h]
        risk = 0.03 * blast + 1.2 * bad + 1.0 * has[1]
        t, c = rng.exponential(6 / np.exp(risk)) + 0.01, rng.exponential(3)
        labels.append((key, float(min(t, c)), None if rng.random() < 0.03 else int(t <= c)))
    names = "ID string, CENTER string, BM_BLAST double, WBC double, ANC double, MONOCYTES double, HB double, PLT double, CYTOGENETICS string"
    return E.Cohort(
        spark.createDataFrame(subjects, names).coalesce(2).cache(),
        spark.createDataFrame(obs, "ID string, CHR string, GENE string, VAF double").coalesce(2).cache(),
        spark.createDataFrame(labels, "ID string, OS_YEARS double, OS_STATUS int").coalesce(2).cache() if labelled else None,
    )


@pytest.fixture(scope="module")
def data(spark):
    return cohort(spark, 500, 1), cohort(spark, 60, 2, labelled=False)


SMALL = ForestParams(5, 10, 10, max_depth=3)
CASES = {
    "forest_selected": {"select_top": 8},
    "forest_clusters": {},
    "extra_graph": {"params": replace(SMALL, splitter="random")},
    "extra_entropy_grid": {"grid": {"n_estimators": [3, 5], "min_samples_leaf": [0, 10]}},
    "random_forest": {"trials": 3, "space": {"n_estimators": (2, 5), "min_samples_leaf": (5, 10), "max_features": ["sqrt", None]}},
    "voting": {},
    "cox": {},
    "time_regression": {},
    "boosted_subject_only": {},
}


@pytest.mark.parametrize("name", CASES)
def test_experiment(data, name):
    train, test = data
    exp = replace(E.EXPERIMENTS[name], **{"params": SMALL, **CASES[name]}, tau=2.0)
    out = E.run_experiment(exp, train, test)
    metrics = {r["part"]: r["cindex"] for r in out.metrics.collect()}
    assert set(metrics) == {"train", "valid"}
    assert metrics["train"] > (0.5 if name in ("extra_graph", "time_regression") else 0.6)
    scores = out.scores.collect()
    assert out.scores.columns == ["ID", "risk_score"]
    assert len({r["ID"] for r in scores}) == len(scores) == 60
    if "search" in out.tables:
        table = out.tables["search"].orderBy("rank").collect()
        assert [r["score"] for r in table] == sorted((r["score"] for r in table), reverse=True)
        failed = [r for r in table if r["min_samples_leaf"] == "0"]
        assert all(r["score"] == 0.0 and "out of range" in r["error"] for r in failed)
    if "importance" in out.tables:
        ranked = out.tables["importance"].orderBy("importance", ascending=False).limit(3).collect()
        assert "BM_BLAST" in [r["feature"] for r in ranked]
        # these two never vary, so no tree can use them
        still = {r["feature"]: r["importance"] for r in out.tables["importance"].collect()}
        assert still["WBC"] == still["PLT"] == 0.0


def test_all_experiments_have_known_parts():
    for exp in E.EXPERIMENTS.values():
        assert exp.learner in ("forest", "clusters", "voting", "cox", "regression", "boosted")
        exp.params.checked()


def test_scoring_a_stream_equals_scoring_the_table(spark, data, tmp_path):
    rows, _, names = E.prepare(replace(E.EXPERIMENTS["forest_base"], params=SMALL), data[0], None)
    forests = fit_forests(rows, [ModelSpec(SMALL)], "features", "OS_YEARS", "OS_STATUS", "ID", names=names)
    rows.select("ID", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ID string, features array<double>").parquet(str(tmp_path / "in"))
    write_score_stream(score_stream(stream, forests), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = {r["ID"]: r["risk_score"] for r in rows.select("ID", forests.score_column("features").alias("risk_score")).collect()}
    assert {r["ID"]: r["risk_score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_csv_round_trip_and_missing_tokens(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("OS_STATUS,ID,OS_YEARS\n1.0,a,2.5\nNA,b,nan\n,c,\n0,d,1\n")
    rows = T.read_csv_table(spark, str(tmp_path / "labels.csv"), T.LABEL_SCHEMA).orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [("a", 2.5, 1), ("b", None, None), ("c", None, None), ("d", 1.0, 0)]
    (tmp_path / "bad.csv").write_text("ID,OS_YEARS,OS_STATUS\na,soon,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        T.read_csv_table(spark, str(tmp_path / "bad.csv"), T.LABEL_SCHEMA).collect()
    subjects = "ID,CENTER,HB,CYTOGENETICS\nx,A,9.5,46 XY\n"
    (tmp_path / "s.csv").write_text(subjects)
    row = T.read_csv_table(spark, str(tmp_path / "s.csv"), T.SUBJECT_SCHEMA).first()
    assert (row["HB"], row["WBC"]) == (9.5, None)
