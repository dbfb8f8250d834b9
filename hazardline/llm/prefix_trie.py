"""Conversation prefix trie: every distinct opening of the conversations as a node, with what is shared below it.

A prefix of d turns is known by a 128-bit polynomial over the hashes of its turns, so a prefix's digest is a running
sum along its conversation. Turns are dealt by ranges of (conversation, turn), each task adds up its own part, and the
parts of conversations that cross a range boundary (at most two a range) are carried over, so that one conversation of
any length is never in one task.

A count-min sketch over the digests then screens them. Its cells only tell one from more; an estimate of one proves that
a prefix belongs to one conversation alone, and such a node is written where it stands. Only the prefixes that may be
shared are shuffled and grouped exactly. Each node has its smallest member as representative, whose own prefixes are the
node's ancestors, so that sums over subtrees are sums along conversations and no walk by depth is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardline.llm.arrays import long_array, mix
from hazardline.session import drop_staged, stage_table

#: The longest opening that ``opening`` may take from another conversation.
OPENING = 3
#: Cells in each row of the sketch: at least two for each prefix, up to the larger of these (16 MB a task, 2 MB broadcast).
CELLS = (12, 22)
_ROWS, _BLOCK = 4, 4096
#: Turns of one conversation that a task adds up from the deepest to the first.
_CHUNK = 4096
_BASE = 0xD1342543DE82EF95
_WORDS = r"[^\x20\x09-\x0D]+"


def power(exponent: np.ndarray) -> np.ndarray:
    """The base to each of the exponents, modulo 2^64; they may be negative."""
    inverse, e = pow(_BASE, -1, 1 << 64), np.abs(exponent)
    out = np.ones(len(e), np.uint64)
    for bit in range(int(e.max(initial=0)).bit_length()):
        step = np.where(exponent < 0, np.uint64(pow(inverse, 1 << bit, 1 << 64)), np.uint64(pow(_BASE, 1 << bit, 1 << 64)))
        out = np.where((e >> bit) & 1 == 1, out * step, out)
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).fill_null(0), np.int64)


def _hash(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).view(np.uint64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else long_array(v) for k, v in columns.items()})


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each conversation's turns in this task, with (sa, sb) and without (ra, rb) the turn itself."""
    part = TaskContext.get().partitionId()
    last, count, sums = None, 0, [np.uint64(0)] * 2
    for batch in batches:
        conv = _column(batch, "conv_id")
        n = len(conv)
        if not n:
            continue
        start = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        size = np.diff(np.append(start, n))
        goes_on = conv[0] == last
        i = np.arange(n) - np.repeat(start, size) + 1
        if goes_on:
            i[: size[0]] += count
        up, out = power(i), {}
        for k, name in enumerate("ab"):
            term = _hash(batch, name) * up
            total = np.cumsum(term)
            before = np.repeat(total[start] - term[start], size)
            total = total - before
            if goes_on:
                total[: size[0]] += sums[k]
            out |= {f"s{name}": total, f"r{name}": total - term}
            sums[k] = total[-1]
        last, count = conv[-1], int(i[-1])
        yield _batch(conv_id=conv, part=np.full(n, part), i=i, **out, words=_column(batch, "words"))


_RUNNING = "conv_id long, part long, i long, sa long, ra long, sb long, rb long, words long"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off = _column(batch, "off")
        up = power(off)
        sums = {s: _hash(batch, f"c{s[1]}") + up * _hash(batch, s) for s in ("sa", "ra", "sb", "rb")}
        yield _batch(conv_id=_column(batch, "conv_id"), pos=_column(batch, "i") + off, **sums, words=_column(batch, "words"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pos, h, k = (_column(batch, c) for c in ("pos", "h", "k"))
        up = power(k - h)
        sums = {}
        for x in "ab":
            lead, skipped = _hash(batch, f"l{x}"), _hash(batch, f"h{x}")
            sums |= {f"s{x}": lead + up * (_hash(batch, f"s{x}") - skipped), f"q{x}": lead + up * (_hash(batch, f"r{x}") - skipped)}
        last = pa.array(pos == _column(batch, "n"))
        yield _batch(conv_id=_column(batch, "conv_id"), depth=pos - h + k, sa=sums["sa"], sb=sums["sb"], qa=sums["qa"], qb=sums["qb"], words=_column(batch, "words"), last=last)


_PREFIX = "conv_id long, depth long, sa long, sb long, qa long, qb long, words long, last boolean"


def _carried(running: DataFrame) -> DataFrame:
    """(conv_id, part, off, ca, cb): what lies before each part of a conversation that has several; at most two rows a task."""
    many = running.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv_id")
    pieces = running.join(F.broadcast(many), "conv_id").groupBy("conv_id", "part")
    pieces = pieces.agg(F.max("i").alias("n"), F.max_by("sa", "i").alias("sa"), F.max_by("sb", "i").alias("sb")).collect()
    rows, last, off, sums = [], None, 0, [0, 0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for p in sorted(pieces, key=lambda p: (p.conv_id, p.part)):
        if p.conv_id != last:
            last, off, sums = p.conv_id, 0, [0, 0]
        rows.append((p.conv_id, p.part, off, *map(signed, sums)))
        up = pow(_BASE, off, 1 << 64)
        sums = [(s + up * x) % (1 << 64) for s, x in zip(sums, (p.sa, p.sb), strict=True)]
        off += p.n
    return running.sparkSession.createDataFrame(rows, "conv_id long, part long, off long, ca long, cb long")


def prefixes(turns: DataFrame, opening: tuple[Column, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest sa/sb, parent's digest qa/qb, words, last) of every prefix with a turn, (conv_id, depth) of every conversation).

    ``opening`` gives, in terms of ``conv_id``, another conversation and how many of its first turns (3 at most)
    stand in place of as many own ones.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.regexp_count(text, F.lit(_WORDS)).alias("words"),
    )
    order = ["conv_id", "turn", "role", "a", "b"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "words")
    running = stage_table(ordered.mapInArrow(_running, _RUNNING), "running")
    placed = running.join(F.broadcast(_carried(running)), ["conv_id", "part"], "left")
    placed = placed.mapInArrow(_place, "conv_id long, pos long, sa long, ra long, sb long, rb long, words long")
    head = F.when(F.col("pos") <= OPENING, F.struct("pos", "sa", "sb", "words"))
    convs = stage_table(placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("heads")), "convs")
    base, take = opening or (F.col("conv_id"), F.lit(0))
    take = F.when(base == F.col("conv_id"), 0).otherwise(F.least(take, F.lit(OPENING))).cast("int")
    others = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("theirs"))
    plan = convs.withColumn("base", base).withColumn("h", take).join(others, "base", "left")
    plan = plan.withColumn("lead", F.when(F.col("theirs").isNull(), F.slice("heads", 1, 0)).otherwise(F.slice("theirs", F.lit(1), F.col("h"))))
    plan = plan.withColumn("k", F.size("lead"))
    at = lambda list_, i, x: F.coalesce(F.get(list_, i)[x], F.lit(0))
    plan = plan.select(
        "conv_id", "n", "h", "k", "lead", *(at("lead", F.col("k") - 1, f"s{x}").alias(f"l{x}") for x in "ab"),
        *(F.when(F.col("h") > 0, at("heads", F.col("h") - 1, f"s{x}")).otherwise(0).alias(f"h{x}") for x in "ab"),
    )
    led = plan.select("conv_id", "n", "h", "k", "lead", F.posexplode("lead").alias("p", "turn")).select(
        "conv_id", (F.col("p") + 1).cast("long").alias("depth"), "turn.sa", "turn.sb", at("lead", F.col("p") - 1, "sa").alias("qa"),
        at("lead", F.col("p") - 1, "sb").alias("qb"), "turn.words", ((F.col("p") + 1 == F.col("k")) & (F.col("n") <= F.col("h"))).alias("last"),
    )
    own = placed.join(plan.drop("lead"), "conv_id").where("pos > h").mapInArrow(_rebuild, _PREFIX)
    found = stage_table(led.unionByName(own), "prefixes")
    lengths = plan.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    lengths = stage_table(lengths, "lengths")
    drop_staged(running, convs)
    return found, lengths


def cells(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each digest in every row of the sketch."""
    return np.stack([(mix(a + np.uint64(r) * (b | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(_ROWS)])


def _count_cells(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_ROWS << bits, np.uint8)
        for batch in batches:
            cell, times = np.unique(cells(_hash(batch, "sa"), _hash(batch, "sb"), bits), return_counts=True)
            seen[cell] = np.minimum(seen[cell] + np.minimum(times, 2), 2)
        blocks = seen.reshape(-1, min(_BLOCK, 1 << bits))
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_pydict({"block": pa.array(some), "seen": pa.array([blocks[i].tobytes() for i in some], pa.binary())})

    return run


def _merge_cells(table: pa.Table) -> pa.Table:
    total = np.zeros(0, np.uint8)
    for value in table.column("seen"):
        here = np.frombuffer(value.as_buffer(), np.uint8)
        total = np.minimum(total + here, 2) if len(total) else here
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})


def sketch(digests: DataFrame, bits: int) -> np.ndarray:
    """One bit for each cell of a count-min sketch of (sa, sb): whether more than one row fell into it."""
    merged = digests.select("sa", "sb").mapInArrow(_count_cells(bits), "block long, seen binary").groupBy("block").applyInArrow(_merge_cells, "block long, bits binary")
    found = merged.toArrow()
    width = min(_BLOCK, 1 << bits) // 8
    out = np.zeros((_ROWS << bits) // 8, np.uint8).reshape(-1, width)
    for block, value in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
        out[block] = np.frombuffer(value.as_buffer(), np.uint8)
    return out.ravel()


def alone(a: np.ndarray, b: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch's estimate for each digest is one; those of shared prefixes never are."""
    cell = cells(a, b, bits)
    return ((table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 0).any(0)


def _screen(table, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = alone(_hash(batch, "sa"), _hash(batch, "sb"), table.value, bits)
            parent = alone(_hash(batch, "qa"), _hash(batch, "qb"), table.value, bits) & (_column(batch, "depth") > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(parent)], [*batch.schema.names, "single", "parent_single"])

    return run


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b, ids = _column(batch, "sa"), _column(batch, "sb"), _column(batch, "conv_id")
            start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            text = [",".join(map(str, ids[i:j])) for i, j in zip(start, np.append(start[1:], len(a)), strict=True)]
            yield _batch(sa=a[start], sb=b[start], conv_id=ids[start], ids=pa.array(text))


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, hashlib.sha256()
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "ids")), strict=True):
            if (a, b) == key:
                held.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, held.hexdigest()))
            key, held = (a, b), hashlib.sha256(ids.encode())
        yield _ended(done)
    if key:
        yield _ended([(*key, held.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    a, b, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], ["sa", "sb", "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(sa, sb, ends_sha256) of (sa, sb, conv_id): the ids joined piece by piece over all tasks, then hashed as a stream."""
    order = ["sa", "sb", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_lists, "sa long, sb long, conv_id long, ids string")
    return pieces.repartition("sa", "sb").sortWithinPartitions(*order).mapInArrow(_digest_lists, "sa long, sb long, ends_sha256 string")


def _sums_along(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``below``: the sum of ``value`` over this prefix and the longer ones of its conversation, in bounded pieces."""
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / _CHUNK))
    down = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("below", F.sum(value).over(down))
    far = rows.where(F.col("chunk") > 0).groupBy("conv_id", "chunk").agg(F.sum(value).alias("far"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, 0)
    far = far.select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.sum("far").over(deeper).alias("far"))
    # a conversation of several chunks has a row in each, as all shorter prefixes of a shared one are shared
    return rows.join(far, ["conv_id", "chunk"], "left").withColumn("below", F.col("below") + F.coalesce("far", F.lit(0)))


def prefix_trie(turns: DataFrame, opening: tuple[Column, Column] | None = None, cell_bits: tuple[int, int] = CELLS) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (conv_id, turn, role, text), the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null for the root), n_convs
    (conversations that start so), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    the words of each node's last text times its members but one), ends_sha256 (SHA-256 of the ids that end here,
    ascending, comma-joined). The node's last turn is turn ``depth`` of conversation ``conv_id``.

    Turns go by ``turn``, null first; equal ones by role, then by hash of the text, so repeated rows are turns of their
    own. A null role or text is empty. Rows with a null ``conv_id`` belong to no conversation. Other columns are ignored.
    An empty table has no nodes. For ``opening`` see ``prefixes``.
    """
    spark = turns.sparkSession
    found, lengths = prefixes(turns, opening)
    total = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    bits = int(np.clip(int(2 * found.count()).bit_length(), *cell_bits))
    table = spark.sparkContext.broadcast(sketch(found, bits))
    screened = stage_table(found.mapInArrow(_screen(table, bits), _PREFIX + ", single boolean, parent_single boolean"), "screened")
    drop_staged(found)
    single, shared = screened.where("single"), screened.where("not single")
    stats = shared.groupBy("sa", "sb").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.min(c).alias(c) for c in ("depth", "qa", "qb", "words"))
    )
    stats = stage_table(stats, "stats")
    parents = stats.where("depth > 1").select("qa", "qb").union(single.where("depth > 1 and not parent_single").select("qa", "qb"))
    children = parents.groupBy(F.col("qa").alias("sa"), F.col("qb").alias("sb")).agg(F.count("*").alias("n_children"))
    stats = stage_table(stats.join(children, ["sa", "sb"], "left").fillna(0, ["n_children"]), "nodes")
    saving = stats.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves")).where("saves > 0")
    leaves = stats.where("n_children = 0").select("conv_id").union(single.where("last").select("conv_id")).withColumn("leaf", F.lit(1))
    along = shared.select("conv_id", "depth", "sa", "sb").join(saving, ["conv_id", "depth"], "left").fillna(0, ["saves"])
    along = _sums_along(along, "saves").join(leaves, "conv_id", "left")
    sums = along.groupBy("sa", "sb").agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("below").alias("saved_tokens"))
    ends = shared.where("last").select("sa", "sb", "conv_id").union(lengths.where("depth = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    ends = stage_table(id_digests(ends), "ends")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    above = stats.select(F.col("sa").alias("qa"), F.col("sb").alias("qb"), F.col("conv_id").alias("parent"))
    first = F.when(F.col("depth") == 1, F.lit(total["first"])).otherwise(F.coalesce("parent", "conv_id")).cast("long").alias("parent_conv_id")
    several = stats.join(sums, ["sa", "sb"]).join(ends, ["sa", "sb"], "left").join(above, ["qa", "qb"], "left")
    several = several.select("conv_id", "depth", first, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    own_end = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none)
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    # a parent that is known to be alone has the same single member
    tails = single.join(above, ["qa", "qb"], "left").select(
        "conv_id", "depth", first, one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), nil.alias("saved_tokens"), own_end.alias("ends_sha256"),
    )
    if not total["n"]:
        return several
    top = stats.where("depth = 1").count() + single.where("depth = 1").count()
    saved = saving.agg(F.sum("saves")).first()[0] or 0
    at_root = ends.where("sa = 0 and sb = 0").select("ends_sha256").first()
    row = (total["first"], 0, None, total["n"], top, leaves.count() if top else 1, saved, at_root[0] if at_root else hashlib.sha256(b"").hexdigest())
    root = spark.createDataFrame([row], several.schema)
    return several.unionByName(tails).unionByName(root)
