"""Scans, sinks, projections, filters, joins, set operations, sorts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazardline.functions import scalars as X
from hazardline.operators import aggregates as A
from hazardline.operators import relational as R
from hazardline.operators.ordering import step_lookup
from hazardline.operators.survival import comparable_pairs, event_table
from hazardline.session import shared_dir
from hazardline.sources import tables as T
from proofs.registry import proof
from proofs.views import SET_A, SETS, Tables


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@proof("read_table", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def read_table(t):
    return T.read_table(t.spark, f"{t.folder}/customer.parquet", ["c_custkey", "c_mktsegment", "c_acctbal"])


@proof("write_scores", 'SELECT id AS "ID", risk AS risk_score FROM labels_s')
def write_scores(t):
    path = scratch(t, "scores")
    T.write_scores(t.labels, path, "id", "risk")
    return T.read_scores(t.spark, path)


@proof("feature_table_sink", "SELECT id, center, x1, x2, x3 FROM subjects")
def feature_table_sink(t):
    return T.feature_table_sink(t.subjects.select("id", "center", "x1", "x2", "x3"), scratch(t, "wide"))


@proof("drop_unlabelled", "SELECT id, time, event FROM labels_s WHERE event IS NOT NULL AND time IS NOT NULL")
def drop_unlabelled(t):
    return R.drop_unlabelled(t.labels, "event", "time").select("id", F.col("time"), "event")


@proof("filter_in_set", "SELECT id, gene, vaf FROM obs WHERE gene IN ('Brand#1','Brand#2','Brand#3','Brand#4')")
def filter_in_set(t):
    return R.filter_in_set(t.obs, "gene", SET_A).select("id", "gene", "vaf")


@proof("filter_equals", "SELECT id, gene, chr FROM obs WHERE chr = '7'")
def filter_equals(t):
    return R.filter_equals(t.obs, "chr", "7").select("id", "gene", "chr")


@proof("filter_by_label", "SELECT id, gene, vaf FROM obs WHERE chr = '1'")
def filter_by_label(t):
    return R.filter_by_label(t.obs, "chr", "1").select("id", "gene", "vaf")


@proof("derive_constant", "SELECT id, gene, 1 AS flag FROM obs")
def derive_constant(t):
    return R.derive_constant(t.obs.select("id", "gene"))


@proof("rename_prefix", 'SELECT id, gene AS "v_gene", vaf AS "v_fraction" FROM obs')
def rename_prefix(t):
    renamed = R.rename_columns(t.obs.select("id", "gene", "vaf"), {"vaf": "fraction"})
    return R.prefix_columns(renamed, "v_", keep=["id"])


@proof("select_by_prefix", "SELECT id, x1, x2, x3 FROM subjects")
def select_by_prefix(t):
    return R.select_by_prefix(t.subjects, ["x"], keep=["id"])


@proof("drop_if_present", "SELECT id, center, x1, x2, x3 FROM subjects")
def drop_if_present(t):
    return R.drop_if_present(t.subjects, ["karyo", "OS_YEARS", "OS_STATUS"])


@proof("column_or_default", "SELECT id, x2, CAST(10.0 AS DOUBLE) AS hb FROM subjects")
def column_or_default(t):
    df = t.subjects
    return df.select("id", X.column_or_default(df, "x2", 60.0).alias("x2"), X.column_or_default(df, "hb", 10.0).alias("hb"))


@proof("project_feature_subset", "SELECT id, x1, x3 FROM subjects")
def project_feature_subset(t):
    return R.project_feature_subset(t.subjects, ["x1", "x2", "x3"], [0, 2], keep=["id"])


@proof("fill_constant", "SELECT id, coalesce(x1, 0) AS x1, coalesce(karyo, '') AS karyo FROM subjects")
def fill_constant(t):
    df = R.fill_constant(t.subjects, 0.0, ["x1"])
    return R.fill_constant(df, "", ["karyo"]).select("id", "x1", "karyo")


@proof(
    "presence_indicator",
    """SELECT id, CAST(avg(vaf) FILTER (gene = 'Brand#1') IS NOT NULL AS INT) AS present_1,
              CAST(avg(vaf) FILTER (gene = 'Brand#5') IS NOT NULL AS INT) AS present_5 FROM obs GROUP BY id""",
)
def presence_indicator(t):
    means = A.summarize(t.obs, "id", A.mean_columns("gene", "vaf", ["Brand#1", "Brand#5"], "m_"))
    return means.select(
        "id", X.presence_indicator("m_Brand_1").alias("present_1"), X.presence_indicator("m_Brand_5").alias("present_5")
    )


@proof(
    "threshold_flag",
    "SELECT id, CAST(coalesce(x1 < 1000, false) AS INT) AS low, CAST(coalesce(x2 > 0, false) AS INT) AS any FROM subjects",
)
def threshold_flag(t):
    return t.subjects.select(
        "id", X.threshold_flag(F.col("x1") < 1000).alias("low"), X.threshold_flag(F.col("x2") > 0).alias("any")
    )


@proof(
    "bin_numeric",
    """SELECT id, CAST(CASE WHEN x2 <= 0 THEN NULL WHEN x2 <= 40 THEN 0 WHEN x2 <= 60 THEN 1 WHEN x2 <= 80 THEN 2
                       WHEN x2 <= 100 THEN 3 END AS INT) AS bin FROM subjects""",
)
def bin_numeric(t):
    return t.subjects.select("id", X.bin_numeric("x2").alias("bin"))


@proof(
    "interaction_term",
    "SELECT id, round(count(*) * avg(vaf), 6) + 0.0::DOUBLE AS product, round(count(*) / 4.0::DOUBLE, 6) AS ratio FROM obs GROUP BY id",
)
def interaction_term(t):
    df = A.summarize(t.obs, "id", A.basic_stats("vaf", ["count", "mean"]))
    product = R.interaction(F.col("obs_count"), F.col("val_mean"))
    return df.select("id", r6(product).alias("product"), r6(X.ratio_or_zero(F.col("obs_count"), F.lit(4))).alias("ratio"))


@proof("cast_columns", "SELECT id, CAST(x2 AS INT) AS x2, CAST(x3 AS FLOAT) AS x3 FROM subjects")
def cast_columns(t):
    return R.cast_columns(t.subjects.select("id", "x2", "x3"), {"x2": "int", "x3": "float"})


@proof("make_label", "SELECT id, CAST(event AS BOOLEAN) AS event, time FROM labelled")
def make_label(t):
    return t.labelled.select("id", X.make_label("event", "time").alias("y")).select("id", "y.event", "y.time")


# ---- joins ---------------------------------------------------------------------------------------


@proof("join_inner", "SELECT s.id, center, x1, time, event FROM subjects s JOIN labelled l ON s.id = l.id")
def join_inner(t):
    return R.join_labels(t.subjects, t.labelled, "id").select("id", "center", "x1", "time", "event")


@proof(
    "join_left_features",
    """SELECT s.id, x1, n, round(m, 6) + 0.0::DOUBLE AS m FROM subjects s
       LEFT JOIN (SELECT id, count(*) AS n, avg(vaf) AS m FROM obs GROUP BY id) o ON s.id = o.id""",
)
def join_left_features(t):
    features = A.summarize(t.obs, "id", [F.count(F.lit(1)).alias("n"), r6(F.avg("vaf")).alias("m")])
    return R.join_left_features(t.subjects.select("id", "x1"), features, "id")


@proof(
    "align_outer",
    """SELECT coalesce(a.id, b.id) AS id, n, has FROM (SELECT id, count(*) AS n FROM obs GROUP BY id) a
       FULL JOIN (SELECT id, 1 AS has FROM labelled WHERE event = 1) b ON a.id = b.id""",
)
def align_outer(t):
    counts = A.summarize(t.obs, "id", [F.count(F.lit(1)).alias("n")])
    events = t.labelled.where("event = 1").select("id", F.lit(1).alias("has"))
    return A.align_outer(counts, events, "id")


@proof(
    "align_with_fill",
    """SELECT s.id, coalesce(n, 0) AS n FROM subjects s LEFT JOIN (SELECT id, count(*) AS n FROM obs
       WHERE gene IN ('Brand#1','Brand#2','Brand#3','Brand#4') GROUP BY id) o ON s.id = o.id""",
)
def align_with_fill(t):
    inside = A.summarize(R.filter_in_set(t.obs, "gene", SET_A), "id", [F.count(F.lit(1)).alias("n")])
    return A.align_with_fill(t.subjects.select("id"), inside, "id")


@proof(
    "join_step_lookup",
    """, steps AS (SELECT time, count(*) AS n FROM labelled WHERE event = 1 GROUP BY time)
       SELECT l.id, CAST(s.n AS DOUBLE) AS n FROM labels_s l ASOF LEFT JOIN steps s ON l.time >= s.time""",
)
def join_step_lookup(t):
    steps = event_table(t.labelled, "time", "event").where("n_event > 0").select("time", F.col("n_event").cast("double").alias("n"))
    return step_lookup(t.labels.select("id", "time"), steps, "time", "n").select("id", "n")


@proof(
    "join_comparable_pairs",
    """SELECT i.time, CAST(count(DISTINCT i.id) AS BIGINT) AS n_event,
              CAST(count(j.id) / count(DISTINCT i.id) AS BIGINT) AS n_partners
       FROM labelled i LEFT JOIN labelled j ON j.time > i.time OR (j.time = i.time AND j.event = 0)
       WHERE i.event = 1 GROUP BY i.time""",
)
def join_comparable_pairs(t):
    return comparable_pairs(t.labelled, "time", "event")


# ---- sorts, set operations -----------------------------------------------------------------------


@proof("top_n_values", "SELECT gene, count(*) AS n FROM obs GROUP BY gene ORDER BY n DESC, gene LIMIT 10")
def top_n_values(t):
    return A.top_n_values(t.obs, "gene", 10)


@proof(
    "top_k_by_score",
    "SELECT gene, round(avg(vaf), 9) AS score FROM obs GROUP BY gene ORDER BY score DESC, gene LIMIT 20",
)
def top_k_by_score(t):
    table = t.obs.groupBy("gene").agg(F.round(F.avg("vaf"), 9).alias("score"))
    return A.top_k_by_score(table, "score", "gene", 20)


@proof(
    "top_k_by_variance",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT 'e{i}' AS feature, round(avg(v[{i + 1}]), 9) + 0.0::DOUBLE AS mean, round(var_pop(v[{i + 1}]), 9) AS var_pop FROM vectors"
        for i in range(64)
    ) + ") ORDER BY var_pop DESC, feature LIMIT 30",
)
def top_k_by_variance(t):
    df = t.vectors.select(*[F.col("v")[i].alias(f"e{i}") for i in range(64)])
    top = A.top_k_by_variance(df, df.columns, 30)
    return top.select("feature", (F.round("mean", 9) + F.lit(0.0)).alias("mean"), F.round("var_pop", 9).alias("var_pop"))


@proof("union_rows", "SELECT id, time, event FROM labelled WHERE event = 1 UNION ALL SELECT id, time, event FROM labelled WHERE event = 0")
def union_rows(t):
    both = t.labelled.select("id", "time", "event")
    return R.union_rows(both.where("event = 1"), both.where("event = 0"))


@proof(
    "intersect_names",
    """SELECT gene FROM (SELECT gene, count(*) AS n FROM obs GROUP BY gene ORDER BY n DESC, gene LIMIT 15)
       INTERSECT SELECT gene FROM obs WHERE chr = '1' AND gene IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7','Brand#8')""",
)
def intersect_names(t):
    top = A.top_n_values(t.obs, "gene", 15).select("gene")
    named = R.filter_in_set(t.obs.where("chr = '1'"), "gene", SETS["a"] + SETS["b"]).select("gene")
    return R.intersect_names(top, named)
