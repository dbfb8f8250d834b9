"""Every stage of the pipeline gives back a user's columns, whatever their names, and takes odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
CLASHES = ["score", "copy", "items", "spans", "clean", "masked", "mark", "size", "n_hit", "n_hex", "whole", "root", "taken"]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(900001, None, "en", "s1", None), (900002, "", "en", None, 0), (900003, "word " * 60_000, None, "s1", 300_000), (None, "no id here at all", "en", "s1", 17)],
        "doc_id long, text string, lang string, source string, n_chars int",
    )
    odd = odd.select(*(F.col(c).cast(given.schema[c].dataType) for c in given.columns))
    rows = given.unionByName(odd).unionByName(given.limit(5)).withColumn("tag", F.concat_ws("-", F.monotonically_increasing_id(), "doc_id"))
    rows = rows.cache()
    return rows.select("*", *(F.concat(F.lit(f"{c}:"), F.col("tag")).alias(c) for c in CLASHES))


@pytest.mark.parametrize("at", range(5))
def test_every_value_comes_back(spark, docs, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, FOLDER)
    assert out.columns[: len(docs.columns)] == docs.columns, name
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r['tag']}" for r in rows for c in CLASHES)
    if name in ("benchmark decontamination", "secret scans"):
        assert len(rows) == docs.count()
        assert [r.text for r in rows if r.doc_id == 900001] == [None]


@pytest.mark.parametrize("at", range(5))
def test_empty_table(spark, docs, at):
    assert corpus_pipeline.STAGES[at][1](spark, docs.where("false"), FOLDER).count() == 0
