"""The index against plain search, and decontamination against a brute force over all phrases."""

import hashlib
import random
import re

import numpy as np

from hazardline.llm.contamination import WINDOW, FmIndex, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(WINDOW, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    stream = np.concatenate([np.append(rng.integers(1, 5, rng.integers(1, 40)), 0) for _ in range(60)])
    index = FmIndex(stream)
    for k in (1, 2, 3, 5):
        phrases = rng.integers(1, 6, (40, k))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(stream) - k + 1) if (stream[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_equals_brute_force(spark):
    rng = random.Random(4)
    some = lambda k: [rng.choice(["the", "Of", "AND", "é1", "x", "ñ", "to"]) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(k)]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(some(rng.randrange(10, 40)))) for i in range(30)]
    items += [(40, "the of X7"), (41, "é1"), (42, None), (43, " .. "), (None, "and to the x"), (3, items[7][1])]
    docs = []
    for i in range(120):
        text = " ".join(some(rng.randrange(0, 60)))
        if i % 3 == 0:
            w = words_of(rng.choice(items[:30])[1])
            a = rng.randrange(len(w))
            text += " -- " + " ".join(w[a : a + rng.randrange(1, 20)]) + "; " + " ".join(some(5))
        docs.append((i, text))
    docs += [(7, docs[6][1]), (None, docs[3][1]), (500, None), (501, ""), (502, "é1")]
    df = spark.createDataFrame([(d, t, 1, True) for d, t in docs], "doc_id long, text string, item_id int, contaminated boolean").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(df, bench, cut=True)
    assert sorted(map(tuple, got.drop("items", "spans", "clean").collect()), key=str) == brute(docs, items)
    for r in got.where("contaminated").collect():
        assert len(words_of(r.clean)) == r.n_words - r.n_hit and sum(s.end - s.start for s in r.spans) == r.n_hit
    empty = contamination(df, bench.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r.contaminated for r in empty)
    assert contamination(df.limit(0), bench).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    from hazardline.llm import contamination as module

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "c d"), (3, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c d", "e f", "b c d", "x y"])], "item_id long, text string")
    want = sorted(map(str, contamination(docs, bench).collect()))
    monkeypatch.setattr(module, "BLOCK_BYTES", 4)
    assert sorted(map(str, module.contamination(docs, bench).collect())) == want
