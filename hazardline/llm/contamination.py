"""Benchmark decontamination: an FM-index per shard of training text, searched backward for every test phrase.

A shard is a slice of at most a few MB of documents. Its words are written in the vocabulary of the phrases; a word that
no phrase has can be in no occurrence, so runs of other words shorter than the shortest phrase are left out before the
index is built. Phrases go to the shards in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardline.llm.arrays import ALPHANUMERIC, LOWER, Words, buffers, covered, runs, slices
from hazardline.llm.repeats import RANGE, arrow_schema

WINDOW = 10
#: Text of the items in one block of phrases; the broadcast of a block is a small multiple of it.
BLOCK_BYTES = 8 << 20
SAMPLE = 8


class BitRank:
    """Bits with the count of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.ones = np.append(0, np.cumsum(bits)).astype(np.int32)


class Wavelet:
    """Wavelet matrix of a sequence: how often a value occurs before a place, one bit vector a level."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1 == 1
            self.levels.append((shift, BitRank(bits)))
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        start, end = np.zeros(len(place), np.int64), place.astype(np.int64)
        for (shift, level), zeros in zip(self.levels, self.zeros, strict=True):
            one = (value >> shift) & 1 == 1
            a, b = level.ones[start].astype(np.int64), level.ones[end].astype(np.int64)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start


class FmIndex:
    """Index of word runs; ``words`` are vocabulary numbers from 1, 0 ends each run."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        # runs end at different sentinels, so the order is settled once steps are longer than any run
        rank = words.astype(np.int64) + n
        ends = np.flatnonzero(words == 0)
        rank[ends] = np.arange(len(ends))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        step, longest = 1, int(np.diff(ends, prepend=-1).max())
        while step < longest:
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:]
            later = np.where(np.arange(n) < ends[np.searchsorted(ends, np.arange(n))], later, 0)
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
            step *= 2
        order = np.argsort(rank)
        self.n = n
        last = words[order - 1]  # of the first place it is the final sentinel
        self.top = int(words.max())
        self.wavelet = Wavelet(last, self.top)
        count = np.bincount(words, minlength=self.top + 1)
        self.before = np.append(0, np.cumsum(count)).astype(np.int64)
        self.last = last
        run_start = np.append(0, ends[:-1] + 1)
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE] = sampled[run_start] = True
        self.marked = BitRank(sampled[order])
        self.places = order[sampled[order]]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, one a row, matched from their last word on."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((high > low) & (phrases[:, k] <= self.top))
            high[np.setdiff1d(np.arange(len(phrases)), live)] = 0
            if not len(live):
                break
            word = phrases[live, k]
            low[live] = self.before[word] + self.wavelet.rank(word, low[live])
            high[live] = self.before[word] + self.wavelet.rank(word, high[live])
        return low, np.maximum(high, low)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places of suffixes: step left until one is sampled."""
        out, back = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        at, live = at.copy(), np.arange(len(at))
        while len(live):
            known = self.marked.bits[at[live]]
            done = live[known]
            out[done] = self.places[self.marked.ones[at[done]]] + back[done]
            live = live[~known]
            word = self.last[at[live]]
            at[live] = self.before[word] + self.wavelet.rank(word, at[live])
            back[live] += 1
        return out


def phrases_of(texts: list[str | None]) -> list[list[tuple[bytes, ...]]]:
    """The windows of each text: every ten words, or all words of a shorter text."""
    out = []
    for text in texts:
        data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        words = Words(data, np.array([0, len(data)]), ALPHANUMERIC)
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(words.start, words.end, strict=True)]
        size = min(WINDOW, len(found))
        out.append([tuple(found[i : i + size]) for i in range(len(found) - size + 1)] if size else [])
    return out


def _block(items: list[tuple[str, str | None]]) -> dict | None:
    """Vocabulary, phrases by length and the items of each phrase."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for (item, _), windows in zip(items, phrases_of([t for _, t in items]), strict=True):
        for window in windows:
            owners.setdefault(window, set()).add(item)
    if not owners:
        return None
    vocabulary = sorted({word for window in owners for word in window})
    joined = np.frombuffer(b" ".join(vocabulary), np.uint8)
    hashes = Words(joined, np.array([0, len(joined)]), ALPHANUMERIC).hashes()
    order = np.argsort(hashes)
    number = {vocabulary[k]: i + 1 for i, k in enumerate(order)}
    by_length: dict[int, list] = {}
    for window in sorted(owners):
        by_length.setdefault(len(window), []).append(window)
    return {
        "hashes": hashes[order], "words": [vocabulary[k] for k in order], "shortest": min(by_length),
        "phrases": {k: np.array([[number[w] for w in window] for window in v], np.int64) for k, v in by_length.items()},
        "owners": {k: [sorted(owners[w]) for w in v] for k, v in by_length.items()},
    }


def occurrences(words: Words, block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, int, list]]:
    """(phrase numbers, places, length, owners of each phrase) of all occurrences in the texts of a slice."""
    h = words.hashes()
    found = np.searchsorted(block["hashes"], h)
    found[found == len(block["hashes"])] = 0
    known = np.flatnonzero(block["hashes"][found] == h)
    number = np.zeros(len(h), np.int64)
    number[known] = found[known] + 1
    # a run may not go on into the next text
    gap = np.arange(len(words.first) - 2)
    a, b = runs(np.insert(number > 0, words.first[1:-1], False))
    text = np.searchsorted(words.first[1:-1] + gap, a, "right")
    a, b = a - text, b - text
    long_ = b - a >= block["shortest"]
    a, b = a[long_], b[long_]
    if not len(a):
        return
    size = b - a + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    stream = number[np.minimum(at, len(number) - 1)]
    stream[np.cumsum(size) - 1] = 0
    index = FmIndex(stream)
    for length, phrases in block["phrases"].items():
        low, high = index.search(phrases)
        times = high - low
        phrase = np.repeat(np.arange(len(phrases)), times)
        where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        yield phrase, at[index.locate(where)], length, block["owners"][length]


def _mark(blocks: list, cut: bool, kept: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            words = Words(LOWER[data], offsets, ALPHANUMERIC)
            hit = np.zeros(len(words), bool)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for block in blocks:
                for phrase, place, length, owners in occurrences(words, block.value):
                    hit |= covered(len(words), place, place + length)
                    text = np.searchsorted(words.first, place, "right") - 1
                    for pair in np.unique(text * len(owners) + phrase).tolist():
                        items[pair // len(owners)].update(owners[pair % len(owners)])
            count = np.diff(np.append(0, np.cumsum(hit))[words.first])
            ordered = [sorted(x) for x in items]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered]
            a, b = runs(np.insert(hit, words.first[1:-1], False))
            text = np.searchsorted(words.first[1:-1] + np.arange(len(words.first) - 2), a, "right")
            spans = [[] for _ in items]
            bytes_ = [[] for _ in items]
            for t, x, y in zip(text, a - text, b - text, strict=True):
                spans[t].append({"start": int(x - words.first[t]), "end": int(y - words.first[t])})
                bytes_[t].append((int(words.start[x] - offsets[t]), int(words.end[y - 1] - offsets[t])))
            columns = [np.diff(words.first), count, [len(x) for x in ordered], digest, count > 0, ordered, spans]
            if cut:
                columns.append([_without(t, x) for t, x in zip(batch.column("text").to_pylist(), bytes_, strict=True)])
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(kept) :], strict=True))], schema=schema)

    return run


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    raw, out, done = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[done:a])
        done = b
    return b"".join([*out, raw[done:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, cut: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans[, clean]).

    Words are lower-cased (A-Z) runs of letters and digits of whole texts. Every ten words of an item of ``benchmark``
    (item_id, text), or all words of a shorter one, are a phrase; a document's word inside any occurrence of one is hit.
    ``items`` are the ids with occurring phrases, sorted as strings, ``spans`` the merged runs of hit words; with
    ``cut``, ``clean`` is the text without these runs. Null and empty texts have no words; items without words match
    nothing; repeated rows and ids are each judged alone; a null item id counts as the empty string; of other columns
    those named in ``carry`` come along after doc_id.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = 1 + int(size) // BLOCK_BYTES
    blocks = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        block = _block([(r.item_id, r.text) for r in rows])
        if block:
            blocks.append(spark.sparkContext.broadcast(block))
    columns = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans " + RANGE + (", clean string" if cut else "")
    kept = ["doc_id", *carry]
    schema = T.StructType([docs.schema[c] for c in kept] + T.StructType.fromDDL(columns).fields)
    return docs.select("doc_id", *(c for c in carry if c != "text"), "text").mapInArrow(_mark(blocks, cut, kept, arrow_schema(schema)), schema)
