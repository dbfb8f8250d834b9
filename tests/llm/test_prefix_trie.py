"""The prefix trie against a plain one, with and without shared openings, long conversations and sketches that collide."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardline.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, share=False):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share and c % 20 else 0
        built[c] = [*own.get(c - c % 20, [])[:h], *turns[h:]]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        ends = sorted(c for c in members if len(built[c]) == len(prefix))
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        children = sum(len(p) == len(prefix) + 1 for p in below)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), children, len(leaves), saved, digest))
    return sorted(out)


def made(seed):
    rng, rows = random.Random(seed), []
    for c in range(60):
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, turn if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "x y  z", "c " * 30])))
    rows += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(3)]
    rows += [(200, t % 7, "user", f"long {t}") for t in range(300)] + [(201, t % 7, "user", f"long {t}") for t in range(300)]
    return [*rows, *rows[:4], (None, 1, "user", "nobody"), (961, 0, "user", "one turn")]


@pytest.mark.parametrize("bits", [(3, 3), (12, 22)])
def test_equals_a_plain_trie(spark, bits, monkeypatch):
    monkeypatch.setattr(P, "_CHUNK", 16)
    # equal turns within a conversation are told apart by hash, so the made-up ones differ in turn, or are the same in all
    rows = [r for r in made(1) if not (r[0] is not None and r[0] < 200 and r[1] is None)]
    rows = [r for r in rows if r[0] not in (200, 201)] + [(c, t, "user", f"long {t}") for c in (200, 201) for t in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("extra")).repartition(5)
    got = sorted((tuple(r) for r in P.prefix_trie(df, cell_bits=bits).collect()), key=lambda r: r[:2])
    assert got == expected(rows)


def test_openings_of_another_conversation(spark):
    rows = [(c, t, "user", f"{c % 3} {t} {'x' if t > 2 else ''}") for c in range(-25, 45) if c != 20 for t in range(1 + c % 5)]
    conv = F.col("conv_id")
    # Spark's remainder has the sign of the dividend, so the plain twin is given non-negative ids only
    rows = [r for r in rows if r[0] >= 0]
    got = P.prefix_trie(spark.createDataFrame(rows, SCHEMA), (conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == expected(rows, share=True)


def test_edges(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    got = P.prefix_trie(spark.createDataFrame([(7, None, None, None)], SCHEMA)).collect()
    assert [tuple(r)[:7] for r in sorted(got, key=lambda r: r.depth)] == [(7, 0, None, 1, 1, 1, 0), (7, 1, 7, 1, 0, 1, 0)]


def test_estimates_never_fall_short():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 3000)).astype(np.uint64)
    a, b = np.append(a, a[:500]), np.append(b, b[:500])
    for bits in (6, 12, 15):
        seen = np.zeros(4 << bits, np.int64)
        np.add.at(seen, P.cells(a, b, bits).ravel(), 1)
        single = P.alone(a, b, np.packbits(seen > 1), bits)
        assert not single[:500].any() and not single[3000:].any()
    assert single[500:3000].mean() > 0.9


def test_powers():
    e = np.array([0, 1, 5, -3, 12345])
    assert [int(x) for x in P.power(e)] == [pow(P._BASE, int(k), 1 << 64) for k in e]
