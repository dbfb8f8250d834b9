"""Windows of a document that occur more than once, found by content-chosen anchors; shared by the two substring operators.

A window is ``window`` consecutive units (words or bytes) of one document. Each window picks one anchor, the run of
``anchor`` units whose hash is smallest in it (winnowing): equal windows pick the same anchor at the same place, so they
meet under its hash, the *seed*. Neighbouring windows with the same anchor form one *span*, of which only (document,
start, count, seed, hash of the span) leaves the scan, about two per ``window - anchor`` units.

A seed that occurs once is dropped. Equal spans under a seed are repeats as they stand, with no pair formed, so a passage
with a million copies costs a count. What is left are the different spans of one seed (the edges of repeats); one copy of
each goes to ``resolve``, which decides its windows one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardline.llm.arrays import NON_BLANK, Prefix, Words, buffers, byte_values, long_array, mix, slices, sliding_first_min
from hazardline.session import Staging, drop_staged, stage_table

RANGE = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Shape:
    """``unit`` is 'word' or 'byte'."""

    unit: str
    window: int
    anchor: int

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a 64-bit value for each unit, by text the range of its units)."""
        if self.unit == "byte":
            return byte_values(data), offsets
        words = Words(data, offsets, NON_BLANK)
        return words.hashes(), words.first


def spans_of(values: np.ndarray, first: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(text, start in the text, windows, seed, hash) of every span."""
    n = len(values) - shape.window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = Prefix(values)
    key = mix(prefix.grams(shape.anchor))
    at = sliding_first_min(key, shape.window - shape.anchor + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    here = np.flatnonzero(np.arange(n) + shape.window <= first[1:][text])
    if not len(here):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = at[here]
    cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    start = here[cut]
    count = np.diff(np.append(cut, len(here)))
    text = text[start]
    return text, start - first[text], count, key[at[start]], mix(prefix.of(start, start + count - 1 + shape.window))


def _scan(shape: Shape, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, start, count, seed, span = spans_of(*shape.values(*buffers(batch.column("text"))), shape)
            pick = pa.array(text)
            arrays = [batch.column("doc_id").take(pick), batch.column("mark").take(pick), long_array(seed), long_array(span)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], schema=schema)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): ids may repeat or be null, so a text's own hash completes the key."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def output(docs: DataFrame, columns: str, key: str = "doc_id") -> T.StructType:
    """The key column as it is in ``docs``, then ``columns``."""
    return T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(columns).fields])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repeated_ranges(texts: DataFrame, shape: Shape, resolve: Callable[[DataFrame, DataFrame, Shape], DataFrame]) -> DataFrame:
    """(doc_id, mark, ranges) for every text with a repeated window; the union of the ranges is what repeats cover.

    ``resolve(texts, needed, shape)`` gets the different spans of shared seeds as (doc_id, mark, spans) and returns
    (doc_id, mark, start, end) for the repeated windows among those with n = 1.
    """
    schema = output(texts, "mark long, seed long, span long, start int, count int")
    with Staging(texts.sparkSession) as scope:
        found = stage_table(texts.mapInArrow(_scan(shape, arrow_schema(schema)), schema), "spans")
        # staged, as a join can only split a hot seed if both its sides come straight from a shuffle
        shared = stage_table(found.groupBy("seed").count().where("count > 1").select("seed"), "shared")
        hits = stage_table(found.join(shared, "seed"), "hits")
        drop_staged(found, shared)
        spans = hits.groupBy("seed", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "start", "count")).alias("one"))
        spans = stage_table(spans, "kinds")
        mixed = stage_table(spans.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1").select("seed", "kinds"), "mixed")
        needed = (
            spans.join(mixed, "seed")
            .groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.mark").alias("mark"))
            .agg(F.collect_list(F.struct("seed", "span", "n", "kinds", "one.start", "one.count")).alias("spans"))
        )
        equal = hits.join(spans.where("n > 1").select("seed", "span"), ["seed", "span"])
        equal = equal.select("doc_id", "mark", "start", (F.col("start") + F.col("count") - 1 + shape.window).alias("end"))
        every = equal.unionByName(resolve(texts, needed, shape))
        ranges = every.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).cast(RANGE).alias("ranges"))
        return scope.keep(stage_table(ranges, "ranges"))


def with_text(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The needed spans beside the text they are in."""
    one_each = texts.alias("t").join(needed.alias("s"), F.expr("t.doc_id <=> s.doc_id AND t.mark = s.mark"))
    return one_each.select("s.doc_id", "s.mark", "t.text", "s.spans")


def list_parts(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each element, elements) of a list column."""
    column = column.cast(pa.list_(column.type.value_type)) if not pa.types.is_list(column.type) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _frames(shape: Shape, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, first = shape.values(*buffers(batch.column("text")))
            row, spans = list_parts(batch.column("spans"))
            field = {name: spans.field(name) for name in ("seed", "span", "n", "start", "count")}
            count = np.asarray(field["count"], np.int64)
            at = np.repeat(first[row] + np.asarray(field["start"], np.int64), count)
            at += np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            frames = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), long_array(mix(Prefix(values).of(at, at + shape.window))))
            pick = pa.array(row)
            arrays = [batch.column("doc_id").take(pick), batch.column("mark").take(pick), field["seed"], field["n"], field["start"], frames]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def by_frames(texts: DataFrame, needed: DataFrame, shape: Shape) -> DataFrame:
    """Extend each seed both ways through every window that holds it: a window whose hash comes up twice under one seed repeats."""
    schema = output(texts, "mark long, seed long, n long, start int, frames array<long>")
    frames = stage_table(with_text(texts, needed).mapInArrow(_frames(shape, arrow_schema(schema)), schema), "frames")
    each = frames.select("doc_id", "mark", "seed", "n", "start", F.posexplode("frames").alias("i", "frame"))
    again = stage_table(each.groupBy("seed", "frame").agg(F.sum("n").alias("times")).where("times > 1").select("seed", "frame"), "again")
    start = F.col("start") + F.col("i")
    return each.where("n = 1").join(again, ["seed", "frame"]).select("doc_id", "mark", start.alias("start"), (start + shape.window).alias("end"))
