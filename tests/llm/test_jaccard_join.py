"""The Jaccard join against all pairs, its trees against all pairs of sets, and the bounds that prune them."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hazardline.llm import jaccard_join as J


def grams(text, size=4):
    ws = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    return {ws[i : i + size] for i in range(len(ws) - size + 1)} if len(ws) >= size else {ws} if ws else set()


def expected(rows, percent=85):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    new = lambda k: [f"w{rng.randrange(2000)}" for _ in range(k)]
    rows, passage = [], new(40)
    for i in range(30):
        base = new(rng.randrange(2, 160)) + (passage if i % 2 else [])
        for j in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(j):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
            rows.append((len(rows), " ".join(words).title() if j % 2 else "  ".join(words)))
    base = new(90)
    for _ in range(150):  # a large group whose members are linked to some of the others only
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(90)] = f"other{rng.randrange(50)}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(passage[: 30 + i])) for i in range(8)] + [(len(rows) + 50 + i, rows[3][1]) for i in range(5)]
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "two words"), (None, rows[9][1]), (None, "alone here"), (3, rows[70][1]), (906, "long " + "x y z " * 20000)]


@pytest.mark.parametrize(("block", "fan", "group"), [(512, 8, 60_000), (7, 2, 40)])
def test_equals_all_pairs(spark, monkeypatch, block, fan, group):
    for name, value in (("_BLOCK", block), ("_FAN", fan), ("_GROUP", group), ("_OPEN", 50)):
        monkeypatch.setattr(J, name, value)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, copy int, mark string").repartition(3)
    got = sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str)
    assert got == expected(rows)


@pytest.mark.parametrize("rounds", [(1, None), (None,)])
def test_rounds_lose_nothing(spark, monkeypatch, rounds):
    monkeypatch.setattr(J, "_ROUNDS", rounds)
    rows = corpus(8)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_nothing_linked_and_nothing_there(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = J.jaccard_components(spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1), (2, 0, 2)]


def test_traversal_keeps_every_pair_at_the_threshold():
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(5):
            base = list(base)
            base[rng.randrange(len(base))] = "edit"
            texts.append(" ".join(base))
    s = J.Sets(pa.array(texts), 4)
    bits, n, side = s.bitmaps(len(texts)), s.size, np.repeat([0, 1], 30)
    forest = J.Forest(side, n, n, np.arange(len(texts)), bits)
    met = {(int(a), int(b)) for u, v in forest.meet(np.array([0]), np.array([1]), 85) for a, b in zip(u, v, strict=True)}
    sets = [grams(t) for t in texts]
    assert [len(x) for x in sets] == n.tolist()
    pairs = {(i, j) for i in range(30) for j in range(30, 60)}
    linked = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert linked <= met and len(met) < len(pairs) / 4


def test_only_keys_with_partners_left_are_looked_at_again(spark):
    texts = [" ".join(f"w{i}" for i in range(60)) + f" end{j}" for j in range(8)]
    s = J.Sets(pa.array(texts), 4)
    bits = s.bitmaps(len(texts))
    unseen = s.size - J._shared_bits(bits, bits)
    sets = spark.createDataFrame([(i, int(unseen[i]), bits[i].tobytes()) for i in range(8)], "copy long, unseen int, bits binary")
    rows = [(1 if i < 2 else 2, i, i, int(s.size[i]), int(s.size[i]), 2 if i < 2 else 6) for i in range(8)]
    members = spark.createDataFrame(rows, "key long, copy long, root long, n int, reach int, times long")
    met, left = J.by_trees(members, sets, 85, 1)
    assert [r.key for r in left.collect()] == [2]
    assert (0, 1) in {(r.copy, r.leader) for r in met.collect()}
    met, left = J.by_trees(members, sets, 85, None)
    assert left.isEmpty()
    assert {(r.copy, r.leader) for r in met.collect()} == {(0, 1)} | {(i, j) for i in range(2, 8) for j in range(i + 1, 8)}
