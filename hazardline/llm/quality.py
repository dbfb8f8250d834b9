"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardline.llm.arrays import NON_BLANK, Words, buffers, mix, slices
from hazardline.llm.repeats import arrow_schema

BITS = 18
#: Labelled rows to learn from, at most; the rows with the smallest hash are taken.
TRAIN_ROWS = 12_000
SHARDS = 4
#: Passes over the sample, and updates that few rows get at least.
EPOCHS, UPDATES = 3, 3_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0
#: Bytes of text whose features are computed at a time.
_SLICE = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Byte classes of a word's shape: lower, upper, digit, long code point, each other byte by itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = 0x61
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x30:0x3A] = 0x30
_SHAPE[0x80:] = 0x61


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of sorted (text << 32 | feature) keys."""
    key = np.sort(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples, by text; a text's values have length one.

    Features are hashed words, pairs of neighbours, word shapes and pairs of them, and whether neighbours are equal;
    feature 0 is the constant.
    """
    words = Words(data, offsets, NON_BLANK)
    n = len(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    h = words.hashes()
    # a shape is a word with runs of one class of bytes as one byte: its ends and its classes
    shape = Words.__new__(Words)
    shape.start, shape.end, shape.inside, shape.first = words.start, words.end, words.inside.copy(), words.first
    shape.data = _SHAPE[data]
    if len(data):
        shape.inside[1:] &= (shape.data[1:] != shape.data[:-1]) | ~words.inside[:-1]
        shape.inside[words.start] = True  # a text's first word may touch the text before it
    marks = np.add.reduceat(np.where(shape.inside, mix(np.arange(256, dtype=np.uint64))[shape.data], np.uint64(0)), words.start) if n else h
    pair = np.flatnonzero(text[1:] == text[:-1]) if n else np.zeros(0, np.int64)
    equal = (h[pair] == h[pair + 1]).astype(np.uint64)
    parts = [(text, h), (text[pair], h[pair] * _STEP + h[pair + 1]), (text, mix(marks) + _STEP), (text[pair], mix(marks[pair]) * _STEP + marks[pair + 1]), (text[pair], equal + np.uint64(77))]
    keys = [(t.astype(np.uint64) << np.uint64(32)) | ((mix(v + np.uint64(i)) >> np.uint64(64 - BITS)) | np.uint64(1)) for i, (t, v) in enumerate(parts)]
    row, feature, times = _distinct(np.concatenate(keys))
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
    value = value / norm[row]
    row, feature = np.concatenate([row, np.arange(len(offsets) - 1)]), np.concatenate([feature, np.zeros(len(offsets) - 1, np.int64)])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], np.concatenate([value, np.ones(len(offsets) - 1)])[order]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(column: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Weights after one update per example and pass."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    # what is kept of a feature takes 12 bytes, what computes it ten times that
    sizes, parts, values = [np.zeros(1, np.int64)], [], []
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", _SLICE):
        row, feature, value = features(*buffers(batch.column("text")))
        sizes.append(np.bincount(row, minlength=batch.num_rows))
        parts.append(feature.astype(np.int32))
        values.append(value)
    ends, feature, value = np.cumsum(np.concatenate(sizes)), np.concatenate(parts), np.concatenate(values)
    for _ in range(max(EPOCHS, -(-UPDATES // len(labels)))):
        for i, label in enumerate(labels):
            f, x = feature[ends[i] : ends[i + 1]], value[ends[i] : ends[i + 1]]
            w = _weights(z[f], n[f])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - step * w
            n[f] += g * g
    return _weights(z, n)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """Mean weights of ``SHARDS`` models, each trained on its part of at most ``most`` labelled rows, in hash order.

    ``labels`` (doc_id, label) with labels 0 and 1; others, nulls and rows without a document are left out. Without any
    usable row the weights are all 0, so every score is 0.5.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", "label", F.md5(F.col("doc_id").cast("string")).alias("turn"))
    sample = known.orderBy("turn", "doc_id", "label").limit(most).withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(SHARDS)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("shard", "turn", "label", F.coalesce("text", F.lit("")).alias("text"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("text", "ascending"), ("label", "ascending")]).combine_chunks()
        w = train(table.column("text").combine_chunks(), np.asarray(table.column("label"), np.int64)).astype(np.float32)
        return pa.table({"n": pa.array([table.num_rows], pa.int64()), "weights": pa.array([w.tobytes()], pa.binary())})

    models = rows.groupBy("shard").applyInArrow(one, "n long, weights binary").collect()
    total = sum(m.n for m in models)
    out = np.zeros(1 << BITS)
    for m in sorted(models, key=lambda m: (m.n, bytes(m.weights))):
        out += np.frombuffer(bytes(m.weights), np.float32) * (m.n / total)
    return out


def _score(weights, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in slices(batches, "text", _SLICE):
            row, feature, value = features(*buffers(batch.column("text")))
            score = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[feature], batch.num_rows), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema=schema)

    return run


def quality_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a score for every row: the dot product of its features with the weights, as a probability.

    A null or empty text has the constant feature only. Ids may repeat; other columns are carried along, but for one
    named score, which is replaced.
    """
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_score(shared, arrow_schema(schema)), schema)


def held_out(doc_id):
    """The rows no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
