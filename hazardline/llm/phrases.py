"""Phrase collocation mining by dynamic itemset counting over cyclic shard scans.

The words of every text are written once as the bytes of their hashes, dealt into shards. Each step scans one shard and
counts phrases of all lengths together: single words during the first cycle, a longer phrase from the step after both its
subphrases (all words but the last, all but the first) reached the threshold, for one full cycle. Which phrases those are
is told to the tasks by two tables of fixed size, indexed by different bits of the phrase hash, with the first and the last
step at which a phrase of that cell reached the threshold; both must agree. Phrases that share both cells can only be
counted too early or too often: a shard that was already counted for a phrase is not added again, and a phrase with a rare
subphrase is rare itself. So the counts of all phrases at the threshold are exact at any size of the tables.

With its count, a phrase carries the place (a hash from 0 to 253) of one text that holds it, and only texts of that place
spell it out for the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardline.llm.arrays import LOWER, Words, buffers, long_array, mix, slices
from hazardline.llm.repeats import arrow_schema, list_parts
from hazardline.session import drop_staged, stage_table

LONGEST = 4
SHARDS = 2
#: Cells of each table of phrases at the threshold: 4 bytes for both, 16 MB for each task.
TABLE_BITS = 22
#: Words that a task counts at a time: some 200 bytes each.
_SLICE = 1 << 18
#: Cells for the phrases that a task has spelt (8 bytes each); one that was pushed out may be spelt again.
_TOLD = 1 << 20
_NEVER = 255
#: Texts are dealt to this many places; in a table of wanted phrases, 0 is none, 1 any place and the others a place plus 2.
_PLACES = 254
_ANY = 1
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hash of each word with a zero before each piece, offsets by text, the words)."""
    data, offsets = buffers(column)
    words = Words(LOWER[data], offsets, _WORD)
    breaks = np.append(0, np.cumsum(_BREAK[data]))[words.start]
    parted = np.zeros(len(words) + 1, bool)
    parted[1:-1] = breaks[1:] != breaks[:-1]
    parted[words.first] = True
    at = np.arange(len(words)) + np.cumsum(parted[:-1])
    out = np.zeros(len(words) + int(parted[:-1].sum()), np.uint64)
    out[at] = np.maximum(words.hashes(), np.uint64(1))
    return out, np.append(at, len(out) + 1)[words.first] - 1, words


def _read(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, offsets, words = tokens(batch.column("text"))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64) * 8), pa.py_buffer(values)])
            columns = [batch.column("lang"), batch.column("salt"), batch.column("shard"), pa.array(np.diff(words.first)), packed]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def chains(words: np.ndarray, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: (length, hash of the phrase from each place, whether there is one)."""
    value, there = mix(words ^ salt), words != 0
    yield 1, value, there
    for length in range(2, LONGEST + 1):
        here = len(words) - length + 1
        if here <= 0:
            return
        value = mix(value[:here] * _K1 + words[length - 1 :])
        there = there[:here] & (words[length - 1 :] != 0)
        yield length, value, there


def second_hash(words: np.ndarray, salt: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Another hash of the phrases at some places, to make 128 bits."""
    value = salt[start]
    for j in range(length):
        value = mix(value * _K2 + words[start + j])
    return value


def places(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The place of each text, from the hashes of its words; equal texts have the same."""
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
    ends = np.searchsorted(row, np.arange(rows + 1))
    return (mix(sums[ends[1:]] - sums[ends[:-1]]) % np.uint64(_PLACES)).astype(np.uint8)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each hash, hashes) of a column of lists of hashes, or of their bytes."""
    if pa.types.is_list(column.type):
        row, values = list_parts(column)
        return row, np.asarray(values, np.int64).view(np.uint64)
    data, offsets = buffers(column)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), data.view(np.uint64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, values = _hashes(batch.column("words"))
    salt = np.asarray(batch.column("salt"), np.int64).view(np.uint64)[row]
    return values, salt, places(values, row, batch.num_rows)[row]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``_SLICE`` words, or one row if that has more: Arrow's are of 10,000 texts."""
    for batch in batches:
        words = batch.column("words")
        size = pc.list_value_length(words) if pa.types.is_list(words.type) else pc.divide(pc.binary_length(words), 8)
        ends = np.cumsum(np.asarray(pc.fill_null(size, 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + _SLICE, "right")))
            yield batch.slice(start, end - start)
            start = end


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, size = [], 0
    for batch in _cut(batches):
        held.append(_flat(batch))
        size += len(held[-1][0])
        if size >= _SLICE:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _cell(value: np.ndarray, bits: int, high: bool) -> np.ndarray:
    return (value >> np.uint64(64 - bits) if high else value & np.uint64((1 << bits) - 1)).astype(np.int64)


def _count(table, step: int, shards: int, bits: int, lengths: Sequence[int] = range(1, LONGEST + 1)) -> Callable:
    """Counts of the phrases of ``lengths`` that are due. Tables: first and last step by high bits, the same by low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [table.value[i].astype(np.uint16) | table.value[i + 1].astype(np.uint16) << 8 for i in range(0, len(table.value), 2)]
        for words, salt, place in _chunks(batches):
            for length, value, there in chains(words, salt):
                if length > max(lengths):
                    break
                wanted = np.flatnonzero(there) if length in lengths else np.zeros(0, np.int64)
                for i, known in enumerate(steps if length > 1 and len(wanted) else []):
                    known = known[_cell(before, bits, i == 0)]
                    low, high = known & 255, known >> 8
                    # counted from the step after the later of the two subphrases, for one cycle
                    due = (np.maximum(low[:-1], low[1:]) < step) & (step <= np.maximum(high[:-1], high[1:]) + shards)
                    wanted = wanted[due[wanted]]
                before = value
                key, at, times = np.unique(value[wanted], return_index=True, return_counts=True)
                if len(key):
                    at = wanted[at]
                    other = second_hash(words, salt, at, length)
                    columns = {"length": np.full(len(key), length, np.int32), "a": long_array(key), "b": long_array(other), "n": times}
                    yield pa.RecordBatch.from_pydict(columns | {"place": place[at].astype(np.int32)})

    return run


_COUNTS = "length int, a long, b long, n long, place int"


def count_phrases(words: DataFrame, threshold: int, shards: int, bits: int) -> DataFrame:
    """(length, a, b, n, place) of every phrase that was counted; exact for those with n at the threshold."""
    spark = words.sparkSession
    table = np.full((4, 1 << bits), _NEVER, np.uint8)
    table[1::2] = 0
    known, step, newest = None, 0, {}
    while step < shards or step <= max(newest.values(), default=-1) + shards:
        if step >= _NEVER:
            raise ValueError("too many shards")
        # a phrase of this length may be due only within a cycle of the last step at which one a word shorter reached the threshold
        lengths = [1] if step < shards else []
        lengths += [length + 1 for length, last in sorted(newest.items()) if step <= last + shards]
        sent = spark.sparkContext.broadcast(table.copy())
        shard = step % shards
        counts = words.where(F.col("shard") == shard).select("salt", "words").mapInArrow(_count(sent, step, shards, bits, lengths), _COUNTS)
        nil = F.lit(0).cast("long")
        # state: one more than the step at which the threshold was reached, the last step that counted the phrase, a place; the largest holds
        now = counts.select("length", "a", "b", nil.alias("n"), F.col("n").alias("add"), nil.alias("seen"), (F.lit(step << 8) + F.col("place")).alias("state"))
        both = now if known is None else now.unionByName(known.withColumn("add", nil))
        both = both.groupBy("length", "a", "b").agg(F.sum("n").alias("n"), F.sum("add").alias("add"), F.max("seen").alias("seen"), F.max("state").alias("state"))
        mark = F.lit(1 << shard).cast("long")
        fresh = F.col("seen").bitwiseAND(mark) == 0
        total = F.col("n") + F.when(fresh, F.col("add")).otherwise(0)
        merged = both.select(
            "length", "a", "b", total.alias("n"), F.when(F.col("add") > 0, F.col("seen").bitwiseOR(mark)).otherwise(F.col("seen")).alias("seen"),
            F.when((F.col("state") < 1 << 16) & (total >= threshold), F.col("state") + ((step + 1) << 16)).otherwise(F.col("state")).alias("state"),
        )
        # a rare phrase is done with if every shard was counted, or if none of a cycle's last shards had it: a cycle that is due
        # then is over, or has counted nothing yet. Words are counted in the first cycle only
        last = F.shiftright("state", 8).bitwiseAND(255)
        open_ = (F.col("seen") != (1 << shards) - 1) & (last > step + 1 - shards) & ((F.col("length") > 1) | (step < shards - 1))
        merged = merged.where(open_ | (F.col("n") >= threshold))
        merged = stage_table(merged, "counts", once=True)
        if known is not None:
            drop_staged(known)
        known = merged
        reached = known.where((F.shiftright("state", 16) == step + 1) & (F.col("length") < LONGEST))
        high, low = F.shiftrightunsigned("a", 64 - bits), F.col("a").bitwiseAND((1 << bits) - 1)
        cells = reached.select(F.explode(F.array(high.cast("int"), low.cast("int") + (1 << bits))).alias("cell")).distinct()
        cells = np.asarray(cells.toArrow().column("cell"), np.int64)
        newest |= {row["length"]: step for row in reached.select("length").distinct().collect()}
        for i, cell in ((0, cells[cells < 1 << bits]), (2, cells[cells >= 1 << bits] - (1 << bits))):
            table[i, cell] = np.minimum(table[i, cell], step)
            table[i + 1, cell] = step
        sent.unpersist()
        step += 1
    return known.select("length", "a", "b", "n", F.col("state").bitwiseAND(255).alias("place"))


def _marks(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cells of a phrase in the tables that say which phrases are wanted, one in each."""
    return [_cell(x, bits, high) for x in (a, b) for high in (True, False)]


def _here(table: np.ndarray, cell: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether a text with this mark has to spell the phrase of each cell."""
    found = table[cell]
    return (found == mark) | (found == _ANY)


def _spelt(words: Words, first: np.ndarray, length: int) -> pa.Array:
    """The ``length`` words from each of ``first`` on, joined by spaces."""
    at = (first[:, None] + np.arange(length)).ravel()
    size = words.end[at] - words.start[at]
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    place = np.arange(int(size.sum())) + np.repeat(np.arange(len(at)), size)  # a space after each word before it
    out[place] = words.data[place + np.repeat(words.start[at] - (ends - size - 1), size)]
    # a phrase ends before the space behind its last word, which is taken out again
    keep = np.ones(len(out), bool)
    keep[ends[length - 1 :: length] - 1] = False
    offsets = np.append(0, ends[length - 1 :: length]) - np.arange(len(first) + 1)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep]))


def _spell(wanted, bits: int, schema: pa.Schema) -> Callable:
    """The phrases whose cells are wanted at the place of their text, as text, most of them once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(_TOLD, np.uint64)  # the last phrase spelt in each cell
        for batch in slices(batches, "text"):
            values, offsets, words = tokens(batch.column("text"))
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            salt = np.asarray(batch.column("salt"), np.int64).view(np.uint64)[text]
            word = np.cumsum(values != 0) - 1
            mark = (places(values, text, batch.num_rows) + np.uint8(2))[text]
            for length, value, there in chains(values, salt):
                if length == 1:
                    continue
                at = np.flatnonzero(there)
                at = at[_here(wanted.value[0], _cell(value[at], bits, True), mark[at])]
                at = at[_here(wanted.value[1], _cell(value[at], bits, False), mark[at])]
                other = second_hash(values, salt, at, length)
                # another text of the slice may be the one to spell a phrase, so all tables are asked before repeats go
                right = np.ones(len(at), bool)
                for table, cells in zip(wanted.value[2:], _marks(value[at], other, bits)[2:], strict=True):
                    right &= _here(table, cells, mark[at])
                at, other = at[right], other[right]
                key, one = np.unique(value[at], return_index=True)
                at, other = at[one], other[one]
                seen = (key % np.uint64(_TOLD)).astype(np.int64)
                new = told[seen] != key
                at, key, other = at[new], key[new], other[new]
                if not len(at):
                    continue
                told[seen[new]] = key
                columns = [
                    batch.column("lang").take(pa.array(text[at])), pa.array(np.full(len(at), length)), long_array(key),
                    long_array(other), _spelt(words, word[at], length),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _parts(schema: pa.Schema) -> Callable:
    """Each phrase (length, a, b, f, salt, phrase) beside every phrase inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase"):
            values, offsets, _ = tokens(batch.column("phrase"))
            salt = np.repeat(np.asarray(batch.column("salt"), np.int64).view(np.uint64), np.diff(offsets))
            chain, size = {length: value for length, value, _ in chains(values, salt)}, np.asarray(batch.column("length"), np.int64)
            for m in range(1, LONGEST):
                for j in range(LONGEST - m + 1):
                    rows = np.flatnonzero((size > m) & (j + m <= size))
                    at = offsets[rows] + 1 + j  # each text begins with the mark of a piece
                    pick, n = pa.array(rows), len(rows)
                    columns = [batch.column(c).take(pick) for c in ("length", "a", "b", "f")] + [pa.array(np.full(n, j)), pa.array(np.full(n, m))]
                    if n:
                        columns += [long_array(chain[m][at]), long_array(second_hash(values, salt, at, m))]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _arrow(spark: SparkSession, columns: str) -> pa.Schema:
    return arrow_schema(spark.createDataFrame([], columns).schema)


def collocations(
    docs: DataFrame, threshold: int = 30, most: int = 2000, covered: int = 80, shards: int = SHARDS, table_bits: int = TABLE_BITS
) -> DataFrame:
    """The ``most`` best phrases of 2 to 4 words in each language of ``docs`` (lang, text): (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased; texts end pieces at ``. , ; : ! ?`` and line ends (\\n to \\r), words at spaces and tabs. ``a``
    counts a phrase within pieces, overlaps included, and must reach ``threshold``; ``n`` counts the words of the language.
    Of all cuts into two parts with counts ``l`` and ``r`` the one with the lowest ``score``, floor(2000000 a / (l + r)),
    counts, the first if several. A phrase inside a longer one at the threshold that has ``covered`` percent of its count or
    more is left out. Order: score and a descending, then phrase by its UTF-8 bytes.

    A null ``lang`` is ``und`` (and joins texts that say so); a null or empty text has no words. Repeated rows all count.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").withColumn("salt", F.xxhash64("lang"))
    schema = "lang string, salt long, shard int, n long, words binary"
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("salt", "text"), F.lit(shards)).cast("int"))
    words = stage_table(dealt.mapInArrow(_read(_arrow(spark, schema)), schema), "words", by="shard")
    sizes = stage_table(words.groupBy("lang").agg(F.sum("n").alias("words")), "sizes")
    counts = count_phrases(words, threshold, shards, table_bits)
    placed = stage_table(counts.where(F.col("n") >= threshold), "often")
    drop_staged(words, counts)
    often = placed.drop("place")
    # a table for each of four hashes: a rare phrase is spelt only if all its four cells are taken, any by the place of its text
    marks = [f(c) for c in ("a", "b") for f in (lambda c: F.shiftrightunsigned(c, 64 - table_bits), lambda c: F.col(c).bitwiseAND((1 << table_bits) - 1))]
    wanted = np.zeros((4, 1 << table_bits), np.uint8)
    for table, mark in zip(wanted, marks, strict=True):
        cells = placed.where("length > 1").groupBy(mark.cast("int").alias("cell")).agg(F.min("place").alias("low"), F.max("place").alias("high"))
        cells = cells.select("cell", F.when(F.col("low") == F.col("high"), F.col("low") + 2).otherwise(_ANY).cast("short").alias("mark")).toArrow()
        table[np.asarray(cells.column("cell"), np.int64)] = np.asarray(cells.column("mark"))
    spelt = "lang string, length int, a long, b long, phrase string"
    found = docs.mapInArrow(_spell(spark.sparkContext.broadcast(wanted), table_bits, _arrow(spark, spelt)), spelt)
    key = ["length", "a", "b"]
    found = found.groupBy(*key).agg(F.any_value("lang").alias("lang"), F.any_value("phrase").alias("phrase")).join(often.withColumnRenamed("n", "f"), key)
    found = stage_table(found.withColumn("salt", F.xxhash64("lang")), "candidates", once=True)
    part = "of_length int, of_a long, of_b long, f long, start int, length int, a long, b long"
    parts = found.mapInArrow(_parts(_arrow(spark, part)), part)
    parts = stage_table(parts.join(often.withColumnRenamed("n", "g"), key), "parts", once=True)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    inside = parts.where((F.col("length") > 1) & (wide("f") * 100 >= wide("g") * covered)).select(*key).distinct()
    of = ["of_length", "of_a", "of_b"]
    left = parts.where("start = 0").select(*of, "f", F.col("length").alias("k"), F.col("g").alias("l"))
    right = parts.where("start + length = of_length").select(*of, (F.col("of_length") - F.col("length")).alias("k"), F.col("g").alias("r"))
    score = F.expr("2000000BD * cast(f as decimal(20,0)) div cast(l + r as decimal(20,0))")
    cuts = left.join(right, [*of, "k"]).groupBy(*of).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    cuts = cuts.select(*(F.col(f"of_{c}").alias(c) for c in key), "cut.score", "cut.l", "cut.r")
    kept = found.drop("salt").join(inside, key, "left_anti").join(cuts, key)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).join(sizes, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("words").alias("n"), "score")
