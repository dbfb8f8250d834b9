"""The registered queries against their SQL twins at the smallest scale, where the tables are present."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from proofs.check import canonical, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
SAMPLE = [
    "write_scores", "join_step_lookup", "join_comparable_pairs", "top_k_by_variance", "agg_entropy", "pivot_mean", "set_fraction_count",
    "set_fraction_distinct", "clean_text", "text_contains_flags", "build_feature_table", "stratified_split", "kfold_assign",
    "mask_features_noise", "kaplan_meier", "ipcw_cindex", "evaluate_by_split", "route_by_cluster", "knn_graph", "propagate_neighbors",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    found = duck.execute(entry_module.oracle_sql()[name])
    assert got == canonical(found.fetchall(), [d[0] for d in found.description])


def test_every_twin_has_a_query_and_plans_avoid_nested_loops(spark):
    queries, twins = entry_module.queries(), entry_module.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) >= 95
    for name in ("build_feature_table", "agg_entropy", "stratified_split", "kfold_assign", "kaplan_meier"):
        plan = queries[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_only_what_a_query_uses(spark):
    plan = entry_module.queries()["agg_mean"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan
