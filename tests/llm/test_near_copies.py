"""Near-copy classes against all-pairs similarities, and the sampling against the similarity it estimates."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from hazardline.llm.near_copies import SHINGLE, Shingles, components, near_copies, samples, similarities


def shingles(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    k = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def corpus():
    rng = random.Random(1)
    new = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    rows, passage = [], new(30)
    for i in range(40):
        base = new(rng.randrange(3, 220)) + (passage if i % 2 else [])
        for j in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(j and max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = "edit"
            rows.append((len(rows), (" ".join(words)).title() if j % 2 else " ".join(words)))
    rows += [(len(rows) + i, rows[5][1]) for i in range(4)]
    return [*rows, (900, None), (901, None), (902, ""), (903, ""), (904, "***"), (905, "one"), (906, "ONE"), (None, rows[9][1])]


def expected(rows):
    grams = {t: shingles(t) for _, t in rows if t is not None}
    parent = {t: t for t in grams}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    texts = list(grams)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if jaccard(grams[a], grams[b]) >= 0.8:
                parent[root(a)] = root(b)
    ids = {}
    for d, t in rows:
        if t is not None and d is not None:
            ids[root(t)] = min(d, ids.get(root(t), d))
    return sorted(((d, d if t is None else ids[root(t)]) for d, t in rows), key=str)


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, copy string, n int").repartition(5)
    got = near_copies(df).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == expected(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got if r.class_id is not None)
    assert near_copies(df.limit(0)).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(60, 480))
    texts = pa.array([a, b])
    s = Shingles(*[np.asarray(x) for x in __import__("hazardline.llm.arrays", fromlist=["x"]).buffers(texts)])
    weight = np.random.default_rng(0).uniform(1, 9, 1 << 18)[s.bucket()]
    first, second = ({k: w for k, w, t in zip(s.id.tolist(), weight, s.text) if t == x} for x in (0, 1))
    want = sum(min(first[k], second[k]) for k in first if k in second) / (sum(first.values()) + sum(second.values()) - sum(first[k] for k in first if k in second))
    equal = [len(set(samples(s.keys, s.text, s.id, np.log(weight).astype(np.float32), k)[1].tolist())) == 1 for k in range(2000)]
    assert abs(np.mean(equal) - want) < 0.04
    table = np.ones(1 << 18, np.float32)
    assert similarities(texts[:1], texts[1:], table)[0] == jaccard(shingles(a), shingles(b))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{x: 100 for x in range(101, 140)}, 201: 200}


def test_links_found_only_after_the_leader_are_kept(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(30):  # texts around one passage, near copies in chains, each link close to the threshold
        words = passage + [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(60, 120)] = f"e{rng.randrange(10**6)}"
            words[rng.randrange(60, 120)] = f"e{rng.randrange(10**6)}"
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = dict(expected(rows))
    assert sum(want[r.doc_id] != r.class_id for r in got) <= 2


def test_copies_in_a_group_of_a_third_of_the_rows_meet_by_counts(spark):
    rng = random.Random(9)
    new = lambda k: [f"w{rng.randrange(10**7)}" for _ in range(k)]
    base = new(100)
    rows = [(0, " ".join(base))]
    for i in range(1, 200):  # one or two edited words: 0.90 or 0.81 by counts, far below 0.8 by TF-IDF
        words = list(base)
        for at in (10 + i % 35, 55 + i % 35)[: 1 + i % 2]:
            words[at] = f"e{rng.randrange(10**7)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(new(100))) for i in range(400)]
    assert all(jaccard(shingles(rows[0][1]), shingles(t)) >= 0.8 for _, t in rows[:200])
    got = {r.doc_id: r.class_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i] != 0 for i in range(200)) == 0
    assert all(got[i] == i for i in range(200, 600))
