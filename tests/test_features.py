"""Hand-worked cases: text, per-subject summaries, sets, bins, encoding, imputation."""

import math

import pytest
from pyspark.sql import functions as F

from hazardline.functions import scalars as X
from hazardline.functions import text as T
from hazardline.operators import aggregates as A
from hazardline.operators import prepare as P
from hazardline.operators import relational as R
from hazardline.plans import features as W

TEXTS = [
    ("46,XY,+8,t(8;21)(q22;q22)", "46 xy +8 t(8;21)(q22;q22)", 2, 1, 0, {"+8", "t(8;21)"}),
    ("45,XX,-7,del(5q),inv(3)", "45 xx -7 del(5q) inv(3)", 3, 0, 1, {"-7", "del(5q)", "inv(3)"}),
    ("Complex karyotype; monosomy 7", "complex karyotype; monosomy 7", 0, 0, 0, {"complex", "monosomy 7"}),
    ("46,XY[20]", "46 xy 20", 0, 0, 0, set()),
    ("46,XY,del(5)(q13q33)", "46 xy del(5)(q13q33)", 1, 0, 0, set()),
    ("46,XY,+8,é-7", "46 xy +8 é-7", 2, 0, 0, {"+8", "-7"}),
    ("  a\t\n b__c  ", "a b__c", 0, 0, 0, set()),
    (None, "", 0, 0, 0, set()),
]


def test_text_functions(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "i int, raw string")
    clean = T.clean_text("raw")
    rows = df.select(
        "i", clean.alias("c"), T.count_anomalies("raw").alias("a"), T.count_translocations("raw").alias("t"),
        T.complex_flag(clean).alias("x"), *T.text_contains_flags(clean),
    ).collect()
    for r in rows:
        _, cleaned, anomalies, moves, flag, hits = TEXTS[r["i"]]
        assert (r["c"], r["a"], r["t"], r["x"]) == (cleaned, anomalies, moves, flag)
        assert {m for m in T.MARKERS if r[T.marker_name(m)]} == hits


def test_marker_names():
    assert [T.marker_name(m) for m in ("+8", "-7", "t(8;21)", "monosomy 7")] == ["cyto_plus8", "cyto_minus7", "cyto_t8_21", "cyto_monosomy_7"]
    names = [T.marker_name(m) for m in T.MARKERS + T.EXTRA_MARKERS]
    assert len(set(names)) == len(names)


OBS = [
    ("P1", "TET2", "4", 0.2), ("P1", "TET2", "4", 0.3), ("P1", "TP53", "17", 0.5), ("P2", "FLT3", "13", 0.4),
    ("P2", "NPM1", "5", 0.1), ("P3", "EZH2", "7", 0.0), ("P3", "EZH2", "7", 0.0), ("P4", "TP53", "17", 0.25),
]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(OBS, "ID string, GENE string, CHR string, VAF double")


def by_id(df):
    return {r["ID"]: r for r in df.collect()}


def test_summaries(obs):
    got = by_id(A.summarize(obs, "ID", [*A.basic_stats("VAF"), A.agg_distinct("GENE"), A.density_column("CHR", "7", 159345973)]))
    assert [got[p]["obs_count"] for p in ("P1", "P2", "P3", "P4")] == [3, 2, 2, 1]
    assert [round(got[p]["val_std"], 6) for p in ("P1", "P2", "P3")] == [0.152753, 0.212132, 0.0] and got["P4"]["val_std"] is None
    assert [got[p]["n_distinct"] for p in ("P1", "P2", "P3", "P4")] == [2, 2, 1, 1]
    assert got["P3"]["density"] == 2 / 159345973 and got["P1"]["density"] == 0
    entropy = by_id(A.agg_entropy(obs, "ID", "VAF"))
    assert [entropy[p]["entropy"] for p in ("P1", "P2")] == pytest.approx([1.029652984, 0.500402404])
    assert entropy["P3"]["entropy"] == 0.0 and entropy["P4"]["entropy"] == pytest.approx(-1e-8, rel=1e-3)


def test_top_values_and_pivots(obs):
    assert A.top_n_list(obs, "GENE", 3) == ["EZH2", "TET2", "TP53"]
    assert A.top_n_list(obs, "GENE", 5) == ["EZH2", "TET2", "TP53", "FLT3", "NPM1"]
    means = by_id(A.summarize(obs, "ID", A.mean_columns("GENE", "VAF", ["TET2", "TP53", "EZH2"])))
    assert means["P1"]["mean_TET2"] == pytest.approx(0.25) and means["P3"]["mean_EZH2"] == 0.0 and means["P2"]["mean_TET2"] is None
    present = means["P3"]
    assert present["mean_EZH2"] is not None  # present with value 0


def test_sets_and_pairs(obs):
    sets = {"E": ["TET2", "DNMT3A", "IDH1", "IDH2"], "S": ["TP53", "WT1", "NPM1"], "R": ["FLT3", "KIT", "NRAS", "KRAS"], "N": ["KIT"]}
    got = by_id(A.summarize(obs, "ID", A.set_columns("GENE", "VAF", sets, top=["TET2", "TP53"]) + A.pair_columns("GENE", [("FLT3", "NPM1")])))
    one = lambda p, s: [got[p][f"set_{s}_{k}"] for k in ("flag", "count", "mean", "fraction_distinct", "interaction")]
    assert one("P1", "E") == pytest.approx([1, 2, 0.25, 1 / 4, 0.5])
    assert one("P1", "S") == pytest.approx([1, 1, 0.5, 1 / 3, 0.5])
    assert one("P2", "S") == pytest.approx([1, 1, 0.1, 1 / 3, 0.1])
    assert one("P2", "R") == pytest.approx([1, 1, 0.4, 1 / 4, 0.4])
    assert got["P1"]["set_E_fraction_count"] == 2.0 and got["P2"]["set_R_fraction_count"] == 0.0
    assert {p: got[p]["both_FLT3_NPM1"] for p in got} == {"P1": 0, "P2": 1, "P3": 0, "P4": 0}


def test_scalars(spark):
    df = spark.createDataFrame([(v,) for v in (40.0, 40.5, 60.0, 80.0, 100.0, 0.5, 0.0, 101.0, None)], "v double")
    assert [r[0] for r in df.select(X.bin_numeric("v")).collect()] == [0, 1, 1, 2, 3, 0, None, None, None]
    hb = spark.createDataFrame([(None,), (9.0,), (10.0,)], "v double")
    assert [r[0] for r in hb.select(X.threshold_flag(F.col("v") < 10)).collect()] == [0, 1, 0]
    assert hb.select(X.column_or_default(hb, "absent", 1.0)).first()[0] == 1.0
    bad = spark.createDataFrame([(1, -1.0)], "e int, t double")
    with pytest.raises(Exception, match="label needs"):
        bad.select(X.make_label("e", "t")).collect()


def test_fitted_preparation(spark):
    fit = spark.createDataFrame([("B", 1.0, 5.0, 3.0), ("A", 2.0, 7.0, 3.0), ("C", 3.0, None, 3.0), ("A", 2.0, math.nan, 3.0)], "c string, x double, m double, k double")
    assert [r["m"] for r in P.MeanImputer.fit(fit, ["m"]).transform(fit).collect()] == [5, 7, 6, 6]
    with pytest.raises(ValueError, match="void"):
        P.MeanImputer.fit(fit.withColumn("void", F.lit(None).cast("double")), ["m", "void"])
    hot = P.OneHot.fit(fit, "c")
    assert hot.names() == ["c_A", "c_B", "c_C"]
    other = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    assert [tuple(r)[1:] for r in hot.transform(other).collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    missing = P.OneHot.fit(fit, "c", missing_level=True).transform(other).collect()
    assert [r["c_missing"] for r in missing] == [0, 0, 1]
    with pytest.raises(ValueError, match="categories"):
        P.OneHot.fit(fit, "c", max_categories=2)
    first3 = fit.limit(3)
    scaled = P.Standardizer.fit(first3, ["x", "k"]).transform(first3).collect()
    assert [r["x"] for r in scaled] == pytest.approx([-1.2247449, 0, 1.2247449]) and {r["k"] for r in scaled} == {0.0}
    packed = P.assemble_features(fit, ["k", "x"])
    assert P.feature_names(packed) == ["k", "x"] and packed.first()["features"] == [3.0, 1.0]


def test_presets_give_equal_columns_for_train_and_test(spark, obs):
    subjects = [(f"P{i}", "A" if i % 2 else "B", 1.0 * i, 1.0, 1.0, None if i == 2 else 2.0, 9.0 + i, 1.0, "46,XY,+8", 50.0) for i in range(1, 6)]
    schema = "ID string, CENTER string, BM_BLAST double, WBC double, ANC double, MONOCYTES double, HB double, PLT double, CYTOGENETICS string, AGE double"
    train = spark.createDataFrame(subjects, schema)
    test = train.withColumn("CENTER", F.lit("unseen")).drop("AGE")
    for name in ("text15_sets", "rich30_age", "entropy15", "values25", "zero15", "subject_only"):
        model = W.fit_features(W.PRESETS[name], train, obs)
        a, b = model.transform(train, obs), model.transform(test, obs.limit(0))
        assert a.columns == b.columns and len(set(a.columns)) == len(a.columns)
        for row in a.collect() + b.collect():
            assert all(v is not None for v in row)
        if model.one_hot:
            assert all(sum(r[c] for c in model.one_hot.names()) == 0 for r in b.collect())
    mean = by_id(W.build_feature_table(W.PRESETS["text15_sets"], train, obs))
    assert mean["P5"]["obs_count"] == pytest.approx(2.0)  # no observation: mean of the others
    zero = by_id(W.build_feature_table(W.PRESETS["zero15"], train, obs))
    assert zero["P5"]["obs_count"] == 0.0 and zero["P2"]["MONOCYTES"] == 0.0
    assert mean["P5"]["set_RTK_flag"] == 0.0 and mean["P1"]["cyto_plus8"] == 1.0


def test_relational_helpers(spark, obs):
    assert R.filter_equals(obs, "CHR", "7").count() == 2
    assert R.filter_in_table(obs, "GENE", spark.createDataFrame([("TET2",), ("TET2",)], "GENE string")).count() == 2
    assert R.prefix_columns(obs, "v_", ["ID"]).columns == ["ID", "v_GENE", "v_CHR", "v_VAF"]
    assert R.drop_if_present(obs, ["VAF", "nothing"]).columns == ["ID", "GENE", "CHR"]
    left = A.align_with_fill(spark.createDataFrame([("P1",), ("P9",)], "ID string"), obs.groupBy("ID").count(), "ID")
    assert {r["ID"]: r["count"] for r in left.collect()} == {"P1": 3, "P9": 0}


def test_standardizer_of_many_columns_ignores_missing_values(spark):
    names = [f"c {i}" for i in range(70)]
    rows = [tuple(None if (r + i) % 5 == 0 else float(r * i) for i in range(70)) for r in range(40)]
    stats = P.Standardizer.fit(spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)), names).stats
    assert list(stats) == names
    for i, name in enumerate(names):
        seen = [r[i] for r in rows if r[i] is not None]
        mean = sum(seen) / len(seen)
        assert stats[name] == pytest.approx((mean, (sum((v - mean) ** 2 for v in seen) / len(seen)) ** 0.5))
