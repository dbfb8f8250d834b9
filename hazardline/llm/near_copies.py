"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified, and joined to classes.

Document frequencies are counted over all documents into a fixed number of hashed buckets, so the table of weights has
the same few MB at any size. A sample is the shingle with the smallest draw ``c / (y e^r)``, where y is the largest
weight below its own on a random log grid; two documents have an equal sample with the probability of their weighted
Jaccard similarity. Links count by TF-IDF or by counts, so there are as many bands of samples drawn by plain counts as
by TF-IDF. Candidates are the members of a band's bucket; each first meets the bucket's leader only, so a group of copies of any size
costs a few comparisons a member. Members of buckets that are not one class after that are grouped anew by the rarest of
their shingles: two texts that reach the threshold must share one of those, which texts that only have a common passage
rarely do, so nothing is lost. In these groups members of different classes meet more and more leaders, until each group
is one class or all have met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardline.llm.arrays import ALPHANUMERIC, LOWER, Words, buffers, long_array, mix, slices
from hazardline.llm.repeats import arrow_schema, output
from hazardline.session import Staging, stage_table

SHINGLE = 5
BUCKET_BITS = 18
#: What is left of a text from one of its shingles on, and its whole, by counts and by TF-IDF weights.
ROOM = ("left_count", "count", "left_weight", "weight")
_ID = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _gamma_table() -> np.ndarray:
    """Inverse distribution function of Gamma(2, 1) at the middles of 2^16 equal steps, by bisection."""
    want = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < want
        low, high = np.where(below, x, low), np.where(below, high, x)
    return ((low + high) / 2).astype(np.float32)


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)


class Shingles:
    """Distinct shingles of every text: (text << 48 | id) in order, and how often each occurs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        words = Words(data, offsets, ALPHANUMERIC)
        h = words.hashes()
        count = np.diff(words.first)
        size = np.minimum(count, SHINGLE)
        shingles = np.where(count > 0, count - size + 1, 0)
        text = np.repeat(np.arange(len(count)), shingles)
        at = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[text]
        value = np.zeros(len(at), np.uint64)
        last = size[text]
        for k in range(SHINGLE):
            here = k < last
            value = np.where(here, mix(value * _STEP + h[np.where(here, at + k, 0)]), value) if len(at) else value
        keys = np.sort((text.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys = keys[first]
        self.times = np.diff(np.append(np.flatnonzero(first), len(keys)))
        self.text = (self.keys >> np.uint64(48)).astype(np.int64)
        self.id = self.keys & _ID

    def bucket(self) -> np.ndarray:
        return (self.id >> np.uint64(48 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in slices(batches, "text", 1 << 19):
        total += np.bincount(Shingles(*buffers(batch.column("text"))).bucket(), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln(1 + N / df) for each of the 2^18 hashed buckets, from all documents; the table has 1 MB at any size."""
    counts = docs.select("text").mapInArrow(_count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    found = counts.toArrow()
    df = np.ones(1 << BUCKET_BITS)
    df[np.asarray(found.column("bucket"))] = np.asarray(found.column("df"))
    return np.log1p(max(docs.count(), 1) / df).astype(np.float32)


def samples(keys: np.ndarray, text: np.ndarray, ident: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th sample: (texts that have shingles, a hash of their sampled shingle and grid step)."""
    draw = mix(ident + np.uint64((k + 1) * int(_STEP) & _MASK))
    r = _GAMMA[draw & np.uint64(0xFFFF)]
    log_c = _LOG_GAMMA[(draw >> np.uint64(16)) & np.uint64(0xFFFF)]
    beta = ((draw >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
    step = np.floor(weight / r + beta)
    rank = log_c - r * (step - beta) - r
    start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    least = np.minimum.reduceat(rank, start)
    hit = np.flatnonzero(rank == np.repeat(least, np.diff(np.append(start, len(text)))))
    hit = hit[np.append(True, text[hit[1:]] != text[hit[:-1]])]
    return text[hit], mix(ident[hit] + mix(step[hit].astype(np.int64).view(np.uint64) + np.uint64(k * int(_STEP) & _MASK)))


def _sign(idf, bands: int, rows: int, schema: pa.Schema) -> Callable:
    """Adds ``bands`` band values of samples by TF-IDF weights and as many by counts, the two measures of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in slices(batches, "text", 1 << 19):
            s = Shingles(*buffers(batch.column("text")))
            out = np.zeros((batch.num_rows, 2 * bands), np.uint64)
            some = np.unique(s.text)
            if len(some):
                weights = [np.log(s.times * table[s.bucket()]).astype(np.float32), np.log(s.times).astype(np.float32)]
                for band in range(2 * bands):
                    for k in range(band * rows, band * rows + rows):
                        text, value = samples(s.keys, s.text, s.id, weights[band // bands], k)
                        out[text, band] = mix(out[text, band] * _STEP + value)
            signed = np.zeros(batch.num_rows, np.int64)
            signed[some] = 2 * bands
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(signed)).astype(np.int32)), long_array(out[some].ravel()))
            arrays = [batch.column("doc_id"), batch.column("copy"), lists]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def similarities(left: pa.Array, right: pa.Array, table: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts, the larger of the one by TF-IDF and the one by counts.

    The counts are the second weight because a group of many copies is itself frequent: its common shingles then weigh
    so little that a few edited words would part a copy from its group.
    """
    a, b = Shingles(*buffers(left)), Shingles(*buffers(right))
    keys = np.concatenate([a.keys, b.keys])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    both = np.flatnonzero(keys[1:] == keys[:-1])
    text = (keys[both] >> np.uint64(48)).astype(np.int64)
    best = np.zeros(len(left))
    for scale_a, scale_b in ((1.0, 1.0), (table[a.bucket()], table[b.bucket()])):
        wa, wb = a.times * scale_a, b.times * scale_b
        w = np.concatenate([wa, wb])[order]
        shared = np.bincount(text, np.minimum(w[both], w[both + 1]), len(left))
        total = np.bincount(a.text, wa, len(left)) + np.bincount(b.text, wb, len(left)) - shared
        best = np.maximum(best, np.divide(shared, total, out=np.zeros(len(left)), where=total > 0))
    return best


def _rarest(idf, threshold: float, schema: pa.Schema) -> Callable:
    """The shingles of each text, rarest first, down to where those left could not reach the threshold by themselves.

    The first common shingle of two texts leaves all their common weight behind it, so it is among these in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            s = Shingles(*buffers(batch.column("text")))
            weight = idf.value[s.bucket()].astype(np.float64)
            order = np.lexsort((s.id, -weight, s.text))
            text, needed, room = s.text[order], np.zeros(len(order), bool), []
            for w in (s.times.astype(np.float64), s.times * weight):
                total = np.bincount(text, w[order], batch.num_rows)
                done = np.cumsum(w[order]) - w[order] - (np.cumsum(total) - total)[text]
                room += [total[text] - done, total[text]]
                needed |= room[-2] >= (threshold - 1e-6) * room[-1]
            hit = np.flatnonzero(needed)
            arrays = [*(batch.column(c).take(pa.array(text[hit])) for c in ("copy", "root")), long_array(s.id[order][hit])]
            arrays += [pa.array(x[hit].astype(np.float32)) for x in room]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _verify(idf, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value = similarities(batch.column("text"), batch.column("other"), idf.value)
            yield pa.RecordBatch.from_arrays([batch.column("copy"), batch.column("leader"), pa.array(value)], schema=schema)

    return run


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node each node is linked to, over any number of links.

    Alternates two contractions, each one grouping and one join over the links that are left, until every node that is
    not a root has one link, to a root; hubs stay split.
    """
    edges = stage_table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = stage_table(both.groupBy("u").agg(F.min("v").alias("m")), "least").withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage_table(large.where("u <> v"), "edges")
        least = stage_table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage_table(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not ends.where("below + above > 1 and below > 0").agg(F.count("*")).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def contract(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``roots`` and further ``links`` (copy, leader), which only join whole classes."""
    if roots is None:
        return stage_table(components(links, "copy", "leader"), "roots")
    links = links.join(roots.select(F.col("node").alias("copy"), F.col("root").alias("a")), "copy", "left")
    links = links.join(roots.select(F.col("node").alias("leader"), F.col("root").alias("b")), "leader", "left")
    links = links.select(F.coalesce("a", "copy").alias("a"), F.coalesce("b", "leader").alias("b")).where("a <> b")
    links = stage_table(links.distinct(), "joins")
    if links.isEmpty():
        return roots
    joined = stage_table(components(links, "a", "b"), "joined")
    moved = roots.join(joined.toDF("root", "into"), "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    return stage_table(moved.unionByName(joined), "roots")


def in_reach(threshold: float) -> Column:
    """Whether the members ``a`` and ``b`` of a group can reach the threshold if its shingle is the first they share."""
    fits = []
    for left, whole in (ROOM[:2], ROOM[2:]):
        needed = (threshold - 1e-4) / (1 + threshold) * (F.col(f"a.{whole}") + F.col(f"b.{whole}"))
        fits.append(F.least(f"a.{left}", f"b.{left}") >= needed)
    return fits[0] | fits[1]


def unsettled(groups: DataFrame, met: int) -> DataFrame:
    """The members (key, copy, root) of groups with more than one class and more members than ``met`` leaders and one."""
    root = F.xxhash64("root")
    several = groups.groupBy("key").agg(F.min(root).alias("low"), F.max(root).alias("high"), F.count("*").alias("n"))
    several = several.where((F.col("low") < F.col("high")) & (F.col("n") > met + 1)).select("key")
    return stage_table(groups.join(several, "key"), "open")


def near_copies(docs: DataFrame, threshold: float = 0.8, bands: int = 10, rows: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, class_id, class_size, copy, root).

    Words are lower-cased runs of letters and digits, a shingle is five of them (all of them, if a text has fewer).
    Rows with the same text are one class whatever their length; different texts are linked at a similarity of
    ``threshold`` or more, and classes are what links connect. ``class_id`` is the smallest id in the class,
    ``class_size`` its rows, ``copy`` the digest of the text (16 bytes), ``root`` that of one text of the class (ids may stand in several classes). A text without words is linked to its equals only; each row
    with a null text is a class of its own. Ids may repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy"), "text")
    with Staging(spark) as scope:
        signed, of_text = (scope.keep(table) for table in _classes(spark, docs, threshold, bands, rows))
    alone = F.col("copy").isNull()
    return signed.select("doc_id", "copy").join(of_text, "copy", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).alias("class_size"), "copy", "root"
    )


def _classes(spark: SparkSession, docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(the rows with the digests of their texts, the class of each text)."""
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    schema = output(docs, "copy binary, bands array<long>")
    signed = stage_table(docs.mapInArrow(_sign(idf, bands, rows, arrow_schema(schema)), schema), "signed")
    texts = signed.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands"))
    texts = stage_table(texts, "texts")
    bucket = F.posexplode("bands").alias("band", "value")
    keys = texts.select("copy", bucket).select(F.xxhash64("band", "value").alias("key"), "copy", F.col("copy").alias("root"))
    open_ = unsettled(keys, 0)
    involved = open_.select("copy").distinct().join(texts.select("copy", F.col("doc_id").alias("id")), "copy")
    # one row of each text is fetched, by its id as well, so a text with many copies is dealt out like any other
    involved = stage_table(involved.withColumnRenamed("copy", "of"), "involved").hint("merge")
    bodies = docs.join(involved, (F.col("copy") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    bodies = stage_table(bodies.groupBy("copy").agg(F.any_value("text").alias("text")), "bodies")
    roots = checked = None
    pair = output(docs.select("copy"), "leader binary, similarity double", "copy")
    member = output(docs.select("copy"), "root binary, key long, " + ", ".join(f"{c} float" for c in ROOM), "copy")
    leading, regrouped = 1, False
    while not open_.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("copy", "key"), "copy"))
        leaders = open_.withColumn("place", place).where(F.col("place") <= leading)
        leaders = stage_table(leaders.drop("place"), "leaders")
        meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root"))
        if regrouped:
            meet = meet & in_reach(threshold)
        pairs = open_.alias("a").join(leaders.alias("b"), meet)
        pairs = pairs.select(F.least("a.copy", "b.copy").alias("copy"), F.greatest("a.copy", "b.copy").alias("leader")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["copy", "leader"], "left_anti")
        with_bodies = pairs.join(bodies, "copy").join(bodies.select(F.col("copy").alias("leader"), F.col("text").alias("other")), "leader")
        now = stage_table(with_bodies.select("copy", "leader", "text", "other").mapInArrow(_verify(idf, arrow_schema(pair)), pair), "checked")
        checked = now if checked is None else checked.unionByName(now)
        roots = contract(roots, now.where(F.col("similarity") >= threshold).select("copy", "leader"))
        classed = open_.drop("root").join(roots.withColumnRenamed("node", "copy"), "copy", "left")
        open_ = unsettled(stage_table(classed.withColumn("root", F.coalesce("root", "copy")), "classed"), leading)
        if regrouped:
            leading *= 8
        else:
            regrouped = True
            again = bodies.join(open_.select("copy", "root").distinct(), "copy").select("copy", "root", "text")
            open_ = unsettled(stage_table(again.mapInArrow(_rarest(idf, threshold, arrow_schema(member)), member), "rarest"), 0)
    if roots is None:
        ends = texts.select("copy", F.col("copy").alias("root"), "doc_id", "n")
    else:
        ends = texts.join(roots.withColumnRenamed("node", "copy"), "copy", "left").select("copy", F.coalesce("root", "copy").alias("root"), "doc_id", "n")
    ends = stage_table(ends, "ends")
    classes = stage_table(ends.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size")), "classes")
    of_text = stage_table(ends.join(classes, "root").select("copy", "class_id", "class_size", "root"), "of_text")
    return signed, of_text
