"""Substring dedup by seed and extend: words inside any window of words that also starts elsewhere are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardline.llm.arrays import NON_BLANK, Words, buffers, covered, runs, slices
from hazardline.llm.repeats import RANGE, Shape, arrow_schema, by_frames, keyed, list_parts, output, repeated_ranges


def kept_bytes(words: Words, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of the kept words of each text, each followed by one space (but at a text's very end)."""
    text_end = offsets[1:][np.searchsorted(offsets, words.start[keep], "right") - 1]
    mask = covered(len(words.data), words.start[keep], np.minimum(words.end[keep] + 1, text_end))
    at = np.append(0, np.cumsum(mask))[offsets]
    out = words.data[mask].copy()
    out[~NON_BLANK[out]] = 0x20
    return out, at


def _cut(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            words = Words(data, offsets, NON_BLANK)
            row, ranges = list_parts(batch.column("ranges"))
            start, end = (words.first[row] + np.asarray(ranges.field(x), np.int64) for x in ("start", "end"))
            gone = covered(len(words), start, end)
            total = np.append(0, np.cumsum(gone))[words.first]
            kept, at = kept_bytes(words, offsets, ~gone)
            texts = [kept[a:b].tobytes().rstrip(b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
            a, b = runs(np.insert(gone, words.first[1:-1], False))  # a gap between texts, so that no run crosses them
            text = np.searchsorted(words.first[1:-1] + np.arange(len(words.first) - 2), a, "right")
            spans = [[] for _ in range(batch.num_rows)]
            for t, x, y in zip(text, a - words.first[text] - text, b - words.first[text] - text, strict=True):
                spans[t].append({"start": int(x), "end": int(y)})
            columns = [batch.column("doc_id"), np.diff(words.first), np.diff(total), [hashlib.sha256(x).hexdigest() for x in texts], [x.decode() for x in texts], spans]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = 35, anchor: int = 9) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_words, n_removed, kept_sha256, kept, spans).

    Words are runs of anything but space and \\t to \\r. A word goes if a window of ``window`` words over it has the
    same words as a window that starts elsewhere, in another row or the same one; windows may overlap themselves.
    ``kept`` joins the rest by one space, ``spans`` are the maximal removed runs of words. A null or empty text has no
    words and keeps the empty text; repeated rows are different places, so long ones remove each other; ids may repeat
    or be null; other columns are ignored.
    """
    texts = keyed(docs)
    ranges = repeated_ranges(texts, Shape("word", window, min(anchor, window)), by_frames)
    joined = texts.alias("t").join(ranges.alias("r"), F.expr("t.doc_id <=> r.doc_id AND t.mark = r.mark"), "left").select("t.doc_id", "t.text", "r.ranges")
    schema = output(docs, "n_words long, n_removed long, kept_sha256 string, kept string, spans " + RANGE)
    return joined.mapInArrow(_cut(arrow_schema(schema)), schema)
