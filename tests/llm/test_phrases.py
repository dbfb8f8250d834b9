"""Collocations against plain counting, whatever the number of shards and the size of the table of frequent phrases."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from hazardline.llm import phrases as P


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def expected(rows, threshold, most):
    f = Counter()
    for lang, text in rows:
        for ws in plain(text):
            for size in range(1, 5):
                f.update((lang or "und", *ws[i : i + size]) for i in range(len(ws) - size + 1))
    n = Counter()
    for (lang, *words), c in f.items():
        n[lang] += c if len(words) == 1 else 0
    often = {k for k, c in f.items() if c >= threshold and len(k) > 2}
    gone = set()
    for lang, *ws in often:
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                if 100 * f[(lang, *ws)] >= 80 * f[(lang, *ws[i : i + size])]:
                    gone.add((lang, *ws[i : i + size]))
    out = {}
    for lang, *ws in often - gone:
        cuts = [(2000000 * f[(lang, *ws)] // (f[(lang, *ws[:k])] + f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        row = (score, f[(lang, *ws)], " ".join(ws), f[(lang, *ws[:k])], f[(lang, *ws[k:])])
        out.setdefault(lang, []).append(row)
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out[lang] = [(lang, i + 1, r[2], r[1], r[3], r[4], n[lang], r[0]) for i, r in enumerate(found[:most])]
    return sorted(r for found in out.values() for r in found)


def corpus(seed=3):
    rng, rows = random.Random(seed), []
    stock = ["new york city", "New York city hall", "on the other hand", "a a a a a a", "Ä ö", "x\ty"]
    for _ in range(250):
        words = [rng.choice(stock) if rng.random() < 0.3 else rng.choice("the of a one two three".split()) + rng.choice(["", "", ".", ", ", "\n"]) for _ in range(rng.randrange(0, 30))]
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(words)))
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", "only. one, piece"), *rows[:20], ("en", "of the " * 4000)]


@pytest.mark.parametrize(("shards", "bits", "threshold", "most"), [(3, 22, 8, 40), (2, 3, 30, 2000), (1, 12, 5, 2000)])
def test_equals_plain_counting(spark, shards, bits, threshold, most):
    rows = corpus()
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, phrase string").repartition(4)
    got = P.collocations(df, threshold, most, shards=shards, table_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, threshold, most)


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_places_of_words():
    values, offsets, words = P.tokens(pa.array(["a b. c", None, "", "...", "D d"]))
    assert [int(v == 0) for v in values] == [1, 0, 0, 1, 0, 1, 0, 0]
    assert offsets.tolist() == [0, 5, 5, 5, 5, 8] and values[6] == values[7] and len(words) == 5


def test_only_phrases_with_all_their_cells_are_spelt():
    texts = pa.array(["new  york city. of the", "x of\tthe NEW york", None, "of the"])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), texts, pa.array([7] * 4)], ["lang", "text", "salt"])
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("phrase", pa.string())])

    class Sent:
        value = P.np.ones((4, 8), bool)

    every = [r for b in P._spell(Sent, 3, schema)([batch]) for r in b.to_pylist()]
    assert sorted(r["phrase"] for r in every) == sorted(
        ["new york", "york city", "new york city", "of the", "x of", "the new", "x of the", "of the new", "the new york", "x of the new", "of the new york"]
    )
    wanted = next(r for r in every if r["phrase"] == "new york")
    bits, a, b = 10, *(P.np.array([wanted[c]]).view(P.np.uint64) for c in "ab")
    Sent.value = P.np.zeros((4, 1 << bits), bool)
    Sent.value[0] = True  # the cells of the first table alone say nothing here
    for table, cells in zip(Sent.value[1:], P._marks(a, b, bits)[1:], strict=True):
        table[cells] = True
    assert [r["phrase"] for b in P._spell(Sent, bits, schema)([batch]) for r in b.to_pylist()] == ["new york"]


def test_a_phrase_is_spelt_only_by_texts_of_its_place():
    texts = pa.array([f"x{i} of the y{i}" for i in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 300), texts, pa.array([7] * 300)], ["lang", "text", "salt"])
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("phrase", pa.string())])
    values, offsets, _ = P.tokens(texts)
    place = P.places(values, P.np.repeat(P.np.arange(300), P.np.diff(offsets)), 300)

    class Sent:
        value = P.np.zeros((4, 1 << 20), P.np.uint8)

    Sent.value[:] = P._ANY
    every = [r for b in P._spell(Sent, 20, schema)([batch]) for r in b.to_pylist()]
    wanted = next(r for r in every if r["phrase"] == "of the")
    a, b = (P.np.array([wanted[c]]).view(P.np.uint64) for c in "ab")
    Sent.value[:] = 0
    for table, cells in zip(Sent.value, P._marks(a, b, 20), strict=True):
        table[cells] = place[123] + 2
    found = [[r["phrase"] for part in P._spell(Sent, 20, schema)([batch.slice(i, 1)]) for r in part.to_pylist()] for i in range(300)]
    assert found == [["of the"] if p == place[123] else [] for p in place]  # before, every text spelt it
    assert [r["phrase"] for part in P._spell(Sent, 20, schema)([batch]) for r in part.to_pylist()] == ["of the"]


def test_phrases_that_share_one_cell_are_not_counted():
    words = P.np.array([0, 11, 12, 13], P.np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([words.tobytes()])], ["salt", "words"])
    value = next(P.chains(words, P.np.full(4, 7, P.np.uint64)))[1]
    table = P.np.full((4, 1 << 12), P._NEVER, P.np.uint8)
    table[1::2] = 0
    for row, high in ((0, True), (2, False)):
        table[row : row + 2, P._cell(value, 12, high)] = 1

    class Sent:
        pass

    def counted(step, lengths=range(2, 5)):
        return [n for b in P._count(Sent, step, 2, 12, lengths)([batch]) for n in b.column("length").to_pylist()]

    Sent.value = table
    assert counted(2) == [2, 2] and counted(3) == [2, 2] and counted(4) == [] and counted(2, [3]) == []
    Sent.value = table.copy()
    Sent.value[2:, P._cell(value[3:], 12, False)] = [[P._NEVER], [0]]
    assert counted(2) == [2]  # the cell by high bits alone was enough before


@pytest.mark.parametrize("bits", [2])
def test_shared_cells_over_many_shards(spark, bits):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(tuple(r) for r in P.collocations(df, 12, 300, shards=5, table_bits=bits).collect()) == expected(rows, 12, 300)
