"""N-gram Jaccard join by signature trees: sets that share a rare shingle are met node by node, not pair by pair.

Equal sets are one. Two sets at the threshold must share one of the few rarest shingles of each (the prefix bound), so a
tree is only ever built over the sets under one such shingle. Its nodes hold the OR of their sets' token bitmaps, the
range of set sizes and the most that any of its sets can still share; two nodes are left aside when not even the largest
possible overlap reaches the threshold for their smallest sets, or when all their sets are linked already. The top level
of a tree is a table: blocks of a bounded number of sets, whose pairs are joined under these bounds. What remains of
them goes to tasks in bounded groups, where the lower levels are traversed from both sides. Pairs of sets that are left
are compared exactly from their texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardline.llm.arrays import LOWER, NON_BLANK, Words, buffers, long_array, mix, slices
from hazardline.llm.near_copies import contract, unsettled
from hazardline.llm.repeats import arrow_schema, keyed, output
from hazardline.session import Staging, drop_staged, stage_table

#: Buckets of the table of shingle frequencies, which only orders shingles.
_BUCKET_BITS = 18
_LANES = 16
_FAN = 8
#: Sets in a block, rows of one task's group of block pairs, and node pairs it opens at a time.
_BLOCK, _GROUP, _OPEN = 512, 60_000, 200_000
#: Cells of text hashes by which texts are picked before they are joined.
_CELLS = 1 << 21
#: Partners of a set under one shingle that are compared in each round; all in the last.
_ROUNDS = (8, None)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Sets:
    """The distinct shingles of every text of a slice, in order of (text, hash)."""

    def __init__(self, column: pa.Array, size: int) -> None:
        data, offsets = buffers(column)
        words = Words(LOWER[data], offsets, NON_BLANK)
        h, count = words.hashes(), np.diff(words.first)
        length = np.minimum(count, size)
        shingles = np.where(count > 0, count - length + 1, 0)
        text = np.repeat(np.arange(len(count)), shingles)
        at = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[text]
        value, last = length[text].astype(np.uint64), length[text]
        for k in range(size if len(at) else 0):
            value = np.where(k < last, mix(value * _STEP + h[np.where(k < last, at + k, 0)]), value)
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        first = np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1]))[: len(text)]
        self.text, self.value = text[first], value[first]
        self.size = np.bincount(self.text, minlength=len(count))

    def bucket(self) -> np.ndarray:
        return (self.value >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)

    def bitmaps(self, rows: int) -> np.ndarray:
        """One row of 64-bit lanes for each text."""
        bits = np.zeros((rows, 64 * _LANES), bool)
        bits[self.text, (mix(self.value) >> np.uint64(54)).astype(np.int64) % (64 * _LANES)] = True
        return np.packbits(bits, axis=1).view(np.uint64)


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """In how many rows the shingles of each hash bucket occur; 1 MB at any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BUCKET_BITS, np.int64)
        for batch in slices(batches, "text", 1 << 19):
            total += np.bincount(Sets(batch.column("text"), size).bucket(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "rows": total[some]})

    found = docs.select("text").mapInArrow(count, "bucket int, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()
    out = np.zeros(1 << _BUCKET_BITS, np.int64)
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("rows"))
    return out


def _sign(rarity, size: int, percent: int, schema: pa.Schema) -> Callable:
    """(id, text hash, digest of the set, its size, tokens beyond the bits set, its rarest shingles, bitmap) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            s, rows = Sets(batch.column("text"), size), batch.num_rows
            digest = np.zeros((rows, 2), np.uint64)
            for k in range(2):
                np.add.at(digest[:, k], s.text, mix(s.value + np.uint64(k * 0x9E3779B9 + 1)))
            order = np.lexsort((s.value, rarity.value[s.bucket()], s.text))
            text = s.text[order]
            place = np.arange(len(text)) - (np.cumsum(s.size) - s.size)[text]
            # at the threshold at least percent of the larger set is common, so a common one is among these
            needed = s.size - (percent * s.size + 99) // 100 + 1
            rare = order[place < needed[text]]
            ends = np.append(0, np.cumsum(np.bincount(s.text[rare], minlength=rows))).astype(np.int32)
            keys = [d.tobytes() if n else None for d, n in zip(digest, s.size, strict=True)]
            bits = s.bitmaps(rows)
            unseen = s.size - _shared_bits(bits, bits)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(keys, pa.binary()), pa.array(s.size), pa.array(unseen), pa.ListArray.from_arrays(pa.array(ends), long_array(s.value[rare]))]
            columns += [pa.array([b.tobytes() for b in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _lanes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _LANES)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & b).sum(1, dtype=np.int64)


def _may_reach(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = _lanes(batch.column("bits_a")), _lanes(batch.column("bits_b"))
        n, m = (np.asarray(batch.column(c), np.int64) for c in ("n_a", "n_b"))
        unseen = np.minimum(n - _shared_bits(a, a), m - _shared_bits(b, b))
        keep = (100 + percent) * (unseen + _shared_bits(a, b)) >= percent * (n + m)
        yield batch.filter(pa.array(keep)).select(["copy", "leader"])


def _verify(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            a, b = Sets(batch.column("text"), size), Sets(batch.column("other"), size)
            text, value = np.concatenate([a.text, b.text]), np.concatenate([a.value, b.value])
            order = np.lexsort((value, text))
            text, value = text[order], value[order]
            common = np.bincount(text[1:][(text[1:] == text[:-1]) & (value[1:] == value[:-1])], minlength=batch.num_rows)
            linked = 100 * common >= percent * (a.size + b.size - common)
            yield pa.RecordBatch.from_arrays([batch.column("copy"), batch.column("leader"), pa.array(linked)], ["copy", "leader", "linked"])

    return run


class Forest:
    """Trees over runs of sets with equal ``owner``; level 0 are the sets, each node above has up to 8 children."""

    def __init__(self, owner: np.ndarray, n: np.ndarray, reach: np.ndarray, root: np.ndarray, bits: np.ndarray) -> None:
        level = {"owner": owner, "low": n, "high": n, "reach": reach, "unseen": n - _shared_bits(bits, bits), "first": root, "last": root, "bits": bits}
        self.levels = [level]
        while len(level["owner"]) and (level["owner"][1:] == level["owner"][:-1]).any():
            who = level["owner"]
            start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            place = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
            at = np.flatnonzero(place % _FAN == 0)
            upper = {c: f.reduceat(level[c], at) for c, f in (("low", np.minimum), ("high", np.maximum), ("reach", np.maximum), ("unseen", np.maximum), ("first", np.minimum), ("last", np.maximum))}
            upper |= {"owner": who[at], "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0), "child": at, "children": np.diff(np.append(at, len(who)))}
            self.levels.append(level := upper)

    def may_link(self, depth: int, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes can hold sets of different classes with enough in common."""
        x = self.levels[depth]
        most = np.minimum(np.minimum(x["reach"][u], x["reach"][v]), np.minimum(x["high"][u], x["high"][v]))
        least = percent * (x["low"][u] + x["low"][v])
        keep = ((100 + percent) * most >= least) & ~((x["first"][u] == x["last"][u]) & (x["first"][v] == x["last"][v]) & (x["first"][u] == x["first"][v]))
        some = np.flatnonzero(keep)
        overlap = _shared_bits(x["bits"][u[some]], x["bits"][v[some]]) + np.minimum(x["unseen"][u[some]], x["unseen"][v[some]])
        keep[some] = (100 + percent) * overlap >= least[some]
        return keep

    def meet(self, u: np.ndarray, v: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets below the pairs (u, v) of top nodes."""
        stack = [(len(self.levels) - 1, u, v)]
        while stack:
            depth, u, v = stack.pop()
            keep = self.may_link(depth, u, v, percent)
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            if not depth:
                yield u, v
                continue
            x = self.levels[depth]
            ways = x["children"][u] * x["children"][v]
            cut = np.flatnonzero(np.diff(np.cumsum(ways) // _OPEN)) + 1
            for p, q, w in zip(*(np.split(y, cut) for y in (u, v, ways)), strict=True):
                i = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                wide = np.repeat(x["children"][q], w)
                stack.append((depth - 1, np.repeat(x["child"][p], w) + i // wide, np.repeat(x["child"][q], w) + i % wide))


def _traverse(percent: int, most: int | None) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = np.asarray(table.column("side"), np.int64)
        # a block that meets itself comes once and stands on both sides
        both = np.flatnonzero(side == 2)
        rows = np.append(np.arange(len(side)), both)
        side = np.append(np.where(side == 2, 0, side), np.ones(len(both), np.int64))
        copy, root, unit, n, reach = (np.asarray(table.column(c), np.int64)[rows] for c in ("copy", "root", "unit", "n", "reach"))
        order = np.lexsort((n, root, side, unit))
        unit, side, copy = unit[order], side[order], copy[order]
        owner = np.cumsum(np.append(True, np.diff(unit) != 0) | np.append(True, np.diff(side) != 0)) - 1
        forest = Forest(owner, n[order], reach[order], root[order], _lanes(table.column("bits"))[rows[order]])
        tops, pairs, cut = len(forest.levels[-1]["owner"]), [(np.zeros(0, np.int64),) * 2], np.zeros(len(unit), bool)
        for u, v in forest.meet(np.arange(0, tops, 2), np.arange(1, tops, 2), percent):
            pairs.append((u, v))
            if most and sum(len(p[0]) for p in pairs) > 10 * _OPEN:
                pairs = [_nearest(forest, *map(np.concatenate, zip(*pairs, strict=True)), most, cut)]
        u, v = map(np.concatenate, zip(*pairs, strict=True))
        if most:
            u, v = _nearest(forest, u, v, most, cut)
        # a cut set keeps ``most`` pairs, so its unit is named by at least one of them
        left = pa.array(unit[u], mask=~cut[u])
        return pa.table({"copy": np.minimum(copy[u], copy[v]), "leader": np.maximum(copy[u], copy[v]), "unit": left})

    return run


def _nearest(forest: Forest, u: np.ndarray, v: np.ndarray, most: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` pairs of each set on the left that have the most bits in common for their sizes; ``cut`` marks sets with more."""
    x = forest.levels[0]
    gap = x["low"][u] + x["low"][v] - 2 * _shared_bits(x["bits"][u], x["bits"][v])
    order = np.lexsort((mix(v.astype(np.uint64)), gap, u))
    u, v = u[order], v[order]
    start = np.flatnonzero(np.append(True, u[1:] != u[:-1]))[: len(u)]
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
    cut[u[rank >= most]] = True
    return u[rank < most], v[rank < most]


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` with the block of each: one for a whole key, or several of bounded size under a key with more sets."""
    slot = lambda what, n: F.pmod(F.xxhash64(what), F.ceil(F.col(n) / _BLOCK))
    small = members.where(F.col("times") <= _BLOCK).withColumn("block", F.xxhash64("key"))
    hot = members.where(F.col("times") > _BLOCK)
    sizes = hot.groupBy("key", "root").agg(F.count("*").alias("of_root"))
    rest = sizes.where(F.col("of_root") <= _BLOCK).groupBy("key").agg(F.sum("of_root").alias("of_rest"))
    large = F.xxhash64("key", "root", slot("copy", "of_root"))
    block = F.when(F.col("of_root") > _BLOCK, large).otherwise(F.xxhash64("key", slot("root", "of_rest")))
    hot = hot.join(sizes, ["key", "root"]).join(rest, "key", "left").withColumn("block", block)
    return small.unionByName(hot.drop("of_root", "of_rest")).drop("times")


def by_trees(members: DataFrame, sets: DataFrame, percent: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(copy, leader), the pairs of different classes among the sets under each ``key`` of ``members`` by dual traversal, and the keys that are not done.

    ``members`` has the number of its rows under a key in ``times``. With ``most``, a set has no more partners than that
    in a block pair; keys under which some were left are not done.
    """
    # rows are dealt to blocks before they get their bitmaps, which are most of a row
    dealt = _dealt(members).join(sets.select("copy", "unseen", "bits"), "copy")
    dealt = stage_table(dealt, "dealt", once=True)
    lanes = [F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(_LANES)]
    tops = dealt.groupBy("key", "block").agg(
        F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"), F.max("unseen").alias("unseen"),
        F.min("root").alias("first"), F.max("root").alias("last"), F.array(*(F.bit_or(lane) for lane in lanes)).alias("lanes"),
    )
    tops = stage_table(tops, "tops", once=True)
    both = lambda f, c: f(F.col(f"a.{c}"), F.col(f"b.{c}"))
    common = reduce(lambda x, y: x + y, (F.bit_count(F.col("a.lanes")[i].bitwiseAND(F.col("b.lanes")[i])) for i in range(_LANES)))
    overlap = F.least(both(F.least, "reach"), both(F.least, "high"), common + both(F.least, "unseen"))
    linked = (F.col("a.first") == F.col("a.last")) & (F.col("b.first") == F.col("b.last")) & (F.col("a.first") == F.col("b.first"))
    fits = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & ~linked
    fits = fits & ((100 + percent) * overlap >= percent * (F.col("a.low") + F.col("b.low")))
    units = tops.alias("a").join(tops.alias("b"), fits).select(
        F.xxhash64("a.key", "a.block", "b.block").alias("unit"), F.col("a.key").alias("key"), F.col("a.block").alias("left"), F.col("b.block").alias("right"), (F.col("a.rows") + F.col("b.rows")).alias("rows")
    )
    units = stage_table(units, "units", once=True)
    rows = units.agg(F.sum("rows")).first()[0] or 0
    place = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("block"))
    places = F.when(F.col("left") == F.col("right"), F.array(place(2, "left"))).otherwise(F.array(place(0, "left"), place(1, "right")))
    sides = units.select("key", "unit", F.inline(places))
    sides = dealt.join(sides, ["key", "block"]).select("unit", "side", "copy", "root", "n", "reach", "bits")
    group = F.pmod(F.xxhash64("unit"), F.lit(max(1, math.ceil(rows / _GROUP))))
    found = stage_table(sides.groupBy(group.alias("group")).applyInArrow(_traverse(percent, most), "copy long, leader long, unit long"), "found", once=True)
    met = stage_table(found.select("copy", "leader").distinct(), "met", once=True)
    left = stage_table(found.where("unit IS NOT NULL").select("unit").distinct().join(units, "unit").select("key").distinct(), "left", once=True)
    drop_staged(dealt, tops, units, found)
    return met, left


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_shingles, component_id).

    Words are what blanks (space, \\t to \\r) part, with A-Z lower-cased; a text's set holds its distinct shingles of
    ``size`` words, or all words as one shingle if there are fewer. Texts are linked if 100 x common >= ``percent`` x all
    shingles of both; ``component_id`` is the smallest id that links lead to. A null text and one without words have an
    empty set and are linked to nothing. Repeated rows and ids are texts of their own, and a null id is never the
    smallest unless alone. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    with Staging(spark) as scope:
        signed, of_set = (scope.keep(table) for table in _components(spark, docs, size, percent))
    found = signed.select("doc_id", "copy", "n").join(of_set, "copy", "left")
    own = F.when(F.col("copy").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def _components(spark: SparkSession, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the rows with the digests of their sets, the component of each set)."""
    rarity = spark.sparkContext.broadcast(_frequencies(docs, size))
    schema = output(docs, "mark long, copy binary, n int, unseen int, rare array<long>, bits binary")
    signed = stage_table(docs.mapInArrow(_sign(rarity, size, percent, arrow_schema(schema)), schema), "signed")
    one = F.min(F.struct("doc_id", "mark")).alias("one")
    sets = signed.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("doc_id"), one, *(F.any_value(c).alias(c) for c in ("n", "unseen", "rare", "bits")))
    # numbers in place of digests, which would be most of every shuffle below; they are written once and then stay
    sets = stage_table(sets.withColumnRenamed("copy", "digest").withColumn("copy", F.monotonically_increasing_id()), "sets", once=True)
    rare = sets.select("copy", "n", F.posexplode("rare").alias("pos", "key")).select("key", "copy", "n", (F.col("n") - F.col("pos")).alias("reach"))
    shared = stage_table(rare.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "shared", once=True)
    under = stage_table(rare.join(shared, "key"), "under", once=True)
    drop_staged(shared)
    # a first look under each shingle at one set, so that a group of copies is one class before any tree is built
    leader = under.groupBy("key").agg(F.min(F.struct(F.xxhash64("copy", "key").alias("h"), "copy", "n", "reach")).alias("one"))
    within = (100 + percent) * F.least("reach", "one.reach") >= percent * (F.col("n") + F.col("one.n"))
    leaders = stage_table(leader, "leaders", once=True)
    first = under.join(leaders, "key").where((F.col("copy") != F.col("one.copy")) & within)
    pairs = first.select(F.least("copy", "one.copy").alias("copy"), F.greatest("copy", "one.copy").alias("leader")).distinct()
    links = _compared(pairs, docs, sets, size, percent)
    drop_staged(leaders)
    roots, checked = contract(None, links.where("linked").select("copy", "leader")), links
    # the first look settles keys of two sets; every round settles those that it leaves no pair of
    under = under.where("times > 2")
    for most in _ROUNDS:
        classed = under.join(roots.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
        classed = stage_table(classed, "classed", once=True)
        open_ = unsettled(classed, 1)
        drop_staged(classed)
        if open_.isEmpty():
            break
        met, left = by_trees(open_, sets, percent, most)
        drop_staged(open_)
        links = _compared(met.join(checked, ["copy", "leader"], "left_anti"), docs, sets, size, percent)
        roots, checked = contract(roots, links.where("linked").select("copy", "leader")), checked.unionByName(links)
        if left.isEmpty():
            break
        under = under.join(left, "key", "left_semi")
    ends = sets.join(roots.withColumnRenamed("node", "copy"), "copy", "left").select("digest", F.coalesce("root", "copy").alias("root"), "doc_id")
    ends = stage_table(ends, "ends")
    classes = stage_table(ends.groupBy("root").agg(F.min("doc_id").alias("component_id")), "classes")
    of_set = stage_table(ends.join(classes, "root").select(F.col("digest").alias("copy"), "component_id"), "of_set")
    return signed, of_set


def _compared(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(copy, leader, linked) of the pairs whose bitmaps allow the threshold."""
    a, b = (sets.select("copy", "n", "bits").toDF(key, f"n_{x}", f"bits_{x}") for key, x in (("copy", "a"), ("leader", "b")))
    able = pairs.join(a, "copy").join(b, "leader").mapInArrow(lambda batches: _may_reach(batches, percent), "copy long, leader long")
    able = stage_table(able, "able", once=True)
    needed = able.select("copy").union(able.select("leader")).distinct().join(sets.select("copy", "one"), "copy")
    # one row of each set is read, by its id as well, so a text with many copies is dealt out like any other
    needed = stage_table(needed.select("copy", F.col("one.doc_id").alias("id"), F.col("one.mark").alias("of")), "needed", once=True)
    # at most 2^21 cells go out; they keep most texts that no pair needs from the shuffle
    cell = F.pmod(F.col("mark"), F.lit(_CELLS)).alias("cell")
    cells = needed.select(F.pmod(F.col("of"), F.lit(_CELLS)).alias("cell")).distinct()
    near = docs.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi")
    texts = near.join(needed, (F.col("mark") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    # read twice, but shuffled once: both joins take the texts as they lie after the grouping
    texts = texts.groupBy("copy").agg(F.any_value("text").alias("text"))
    both = able.join(texts, "copy").join(texts.toDF("leader", "other"), "leader").select("copy", "leader", "text", "other")
    compared = stage_table(both.mapInArrow(_verify(size, percent), "copy long, leader long, linked boolean"), "compared", once=True)
    drop_staged(able, needed)
    return compared
