"""Ids and rows that repeat: neighbours against brute force, and the document kept of each class of near copies."""

import numpy as np

import corpus_pipeline
from hazardline.llm.neighbours import nearest


def test_repeated_ids_and_rows_keep_their_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [rows[0]] * 1 + [rows[20]] * 30 + [(1000 + i, rows[20][1]) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = nearest(df, relax=1.0).collect()
    every = np.array([v for _, v in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        scores = np.round(every @ every[list(ids).index(q)], 9)
        want = [int(i) for _, i in sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:20]]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in mine] == want and [k for k, _ in mine] == list(range(1, 21))


def test_one_document_of_each_class_stays_when_ids_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, "short one"), (None, a), (5, None)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (4, "short one"), (None, a), (5, None)], key=str)
