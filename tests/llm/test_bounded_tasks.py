"""What a task of the text operators holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from hazardline.llm import phrases, quality


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_training_features_are_computed_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(map(str, rng.integers(0, 5000, 250))) for _ in range(2400)] + ["", None])
    labels = np.arange(len(texts)) % 2
    monkeypatch.setattr(quality, "EPOCHS", 1)
    monkeypatch.setattr(quality, "UPDATES", 1)
    sliced, peak = peak_of(lambda: quality.train(texts, labels))
    monkeypatch.setattr(quality, "_SLICE", 1 << 40)
    assert peak < 120 << 20
    assert (sliced == quality.train(texts, labels)).all()


class Held:
    def __init__(self, value):
        self.value = value


def test_phrases_are_counted_in_slices():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 40, 1_500_000)
    words[::500] = 0  # each text begins with the mark of a piece
    lists = pa.ListArray.from_arrays(np.arange(0, 1_500_001, 500, dtype=np.int32), pa.array(words))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(3000, 7)), lists], ["salt", "words"])
    parts = (batch.slice(i, 100) for i in range(0, 3000, 100))
    table = np.zeros((2, 1 << 10), np.uint8)
    table[1] = 200
    run = phrases._count(Held(table), 1, 2, 10)
    total, peak = peak_of(lambda: sum(int(np.asarray(b.column("n")).sum()) for b in run(parts)))
    assert total == 3000 * (499 + 498 + 497 + 496)
    assert peak < 100 << 20


def test_phrases_of_a_large_batch_are_counted_in_slices():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 40, 3_000_000)
    words[::500] = 0  # each text begins with the mark of a piece
    lists = pa.ListArray.from_arrays(np.arange(0, 3_000_001, 500, dtype=np.int32), pa.array(words))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(6000, 7)), lists], ["salt", "words"])
    table = np.zeros((2, 1 << 10), np.uint8)
    table[1] = 200
    total, peak = peak_of(lambda: sum(int(np.asarray(b.column("n")).sum()) for b in phrases._count(Held(table), 1, 2, 10)(iter([batch]))))
    assert total == 6000 * (499 + 498 + 497 + 496)
    assert peak < 100 << 20
