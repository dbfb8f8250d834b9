"""Substring dedup against a brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from hazardline.llm.substring import substring_dedup

pytest.importorskip("hazardline.llm")


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "the", "of", "x1", "ñandú", "q" * 30]) + str(rng.randrange(60))
    passage = [word() for _ in range(25)]
    rows = []
    for i in range(80):
        words = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            words += passage + [word() for _ in range(rng.randrange(0, 9))]
        if i % 7 == 0:
            words = words[:4] + ["z"] * rng.randrange(0, 40) + words
        if i % 5 == 0 and rows:
            words += (rng.choice(rows)[1] or "").split()[:30]
        rows.append((i, rng.choice([" ", "\n", "\t \r\n"]).join(words)))
    return [*rows, rows[3], rows[6], (None, rows[9][1]), (None, None), (900, ""), (901, " \n "), (902, "lone")]


@pytest.mark.parametrize("window,anchor", [(8, 3), (10, 9), (35, 9)])
def test_equals_brute_force(spark, window, anchor):
    rows = corpus(window)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, seed string, count int").repartition(5)
    got = substring_dedup(df, window, anchor).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_spans_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, "p q " + text), (2, text + " r")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup(df, 6, 2).collect()}
    assert got == {1: [(2, 14)], 2: [(0, 12)]}
    assert substring_dedup(df.limit(0)).count() == 0
