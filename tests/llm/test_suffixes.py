"""Suffix arrays against plain sorting, and suffix dedup against a brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hazardline.llm import suffixes
from hazardline.llm.suffixes import repeated_starts, suffix_array, suffix_dedup


@pytest.mark.parametrize("letters,n", [(1, 300), (2, 2000), (3, 700), (4, 9000), (30, 3000), (200, 500)])
def test_suffix_array_equals_sorting(letters, n):
    rng = np.random.default_rng(letters)
    for s in (rng.integers(1, letters + 1, n), np.tile(rng.integers(1, letters + 1, 7), n // 7)):
        s = np.append(s, 0)
        text = s.tolist()
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: text[i:])


def test_repeated_starts_equals_counting():
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [b"", b"abcabcabcabc", b"x" * 40]
    for window in (1, 3, 8, 11):
        seen = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
        for p, flags in zip(pieces, repeated_starts(pieces, window)):
            assert flags.tolist() == [seen[p[i : i + window]] > 1 for i in range(len(p) - window + 1)]


def brute(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for (doc, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds,shard", [(512, 1 << 20), (2, 1 << 20), (512, 200)])
def test_equals_brute_force(spark, monkeypatch, kinds, shard):
    monkeypatch.setattr(suffixes, "SHARD_KINDS", kinds)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    rng = random.Random(3)
    noise = lambda k: "".join(rng.choice("aé ñb") for _ in range(k))
    passage, rows = noise(70), []
    for i in range(60):
        text = noise(rng.randrange(0, 90))
        if i % 3 == 0:
            text += passage[: rng.randrange(30, 70)] + noise(20)
        if i % 5 == 0 and rows:
            text += rng.choice(rows)[1][10:80]
        rows.append((i, text + "z" * rng.choice([0, 0, 0, 50])))
    rows += [rows[5], (None, rows[7][1]), (None, None), (99, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, mark int").repartition(4)
    got = suffix_dedup(df, 24, 14).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 24)
    assert suffix_dedup(df.limit(0), 24, 14).count() == 0
