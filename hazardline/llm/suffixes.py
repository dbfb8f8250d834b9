"""Suffix-array dedup: bytes inside any long string that also starts elsewhere are removed.

Suffix arrays are built by induced sorting, in which the steps of one bucket are done for all its entries at once, and
their common prefixes in text order, where only positions whose left neighbours differ are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardline.llm.arrays import buffers, covered, runs, slices
from hazardline.llm.repeats import Shape, arrow_schema, by_frames, keyed, list_parts, output, repeated_ranges, with_text

#: Bytes of the pieces that one suffix array covers, unless one seed alone has more.
SHARD_BYTES = 1 << 20
#: Different spans of one seed that still go to one suffix array (about 300 KB); seeds beyond are decided by counting.
SHARD_KINDS = 512


def _fill(ptr: np.ndarray, sa: np.ndarray, entries: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Append entries to the buckets of their characters, in order; ``step`` -1 fills from the right."""
    if not len(entries):
        return
    order = np.argsort(chars, kind="stable")
    chars, entries = chars[order], entries[order]
    count = np.bincount(chars, minlength=len(ptr))
    rank = np.arange(len(chars)) - (np.cumsum(count) - count)[chars]
    if step > 0:
        sa[ptr[chars] + rank] = entries
        ptr += count
    else:
        sa[ptr[chars] - 1 - rank] = entries
        ptr -= count


def _induce_by_bucket(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffixes in order, given the leftmost smaller ones in order; each wave of a bucket is one array step."""
    tail = np.cumsum(size)
    head = tail - size
    sa = np.zeros(len(s), np.int64)
    lms_head = tail.copy()
    _fill(lms_head, sa, lms[::-1], s[lms[::-1]], -1)
    full = np.flatnonzero(size)
    left = head.copy()
    for c in full:
        done = head[c]
        while done < left[c]:
            wave, done = sa[done : left[c]], left[c]
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            _fill(left, sa, before, s[before], 1)
        before = sa[lms_head[c] : tail[c]] - 1
        _fill(left, sa, before, s[before], 1)
    right = tail.copy()
    for c in full[:0:-1]:
        done = tail[c]
        while done > right[c]:
            wave, done = sa[right[c] : done][::-1], right[c]
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            _fill(right, sa, before, s[before], -1)
        wave = sa[head[c] : left[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[is_s[before]]
        _fill(right, sa, before, s[before], -1)
    sa[0] = len(s) - 1
    return sa


def _induce_by_entry(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for large alphabets, where buckets hold a few entries: one step an entry."""
    text, smaller = s.tolist(), is_s.tolist()
    tail = np.cumsum(size)
    left, right = (tail - size).tolist(), tail.tolist()
    sa = [-1] * len(text)
    for i in lms[::-1].tolist():
        right[text[i]] -= 1
        sa[right[text[i]]] = i
    for k in range(len(sa)):
        i = sa[k] - 1
        if i >= 0 and not smaller[i]:
            c = text[i]
            sa[left[c]] = i
            left[c] += 1
    right = tail.tolist()
    for k in range(len(sa) - 1, 0, -1):
        i = sa[k] - 1
        if i >= 0 and smaller[i]:
            c = text[i]
            right[c] -= 1
            sa[right[c]] = i
    sa[0] = len(text) - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``s``, whose last value is 0 and occurs once."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    size = np.bincount(s)
    rise = np.diff(s.astype(np.int64))
    turn = np.where(rise != 0, np.arange(n - 1), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    is_s = np.append(rise[turn] > 0, True)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induce = _induce_by_bucket if len(size) * 32 < n else _induce_by_entry
    sa = induce(s, is_s, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(length[a] == length[b])
    new = np.ones(len(order), np.int64)
    step = 0
    while len(same):
        same = same[s[a[same] + step] == s[b[same] + step]]
        step += 1
        ended = length[a[same]] <= step
        new[same[ended] + 1] = 0
        same = same[~ended]
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(order):
        named = np.zeros(n, np.int64)
        named[order] = name
        order = lms[suffix_array(named[lms])]
    return induce(s, is_s, order, size)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, left: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Common prefix of each position with its predecessor in ``sa``, at most ``left`` (what is left of its piece).

    A position whose left neighbour equals its predecessor's has one less than that neighbour; only the others
    (and the ``first`` of each piece) are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    lead = np.ones(n, bool)
    lead[1:] = (data[:-1] != data[before[1:] - 1]) | (before[1:] == 0)
    lead[first] = True
    lead[sa[0]] = True
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded, 0, (1,))
    at = np.flatnonzero(lead)
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero((left[at] > 0) & (at != sa[0]))
    while len(live):
        i = at[live]
        differ = eight[i + length[live]] ^ eight[before[i] + length[live]]
        equal = differ == 0
        low = differ & (~differ + np.uint64(1))
        length[live] += np.where(equal, 8, np.log2(np.where(equal, 1, low).astype(np.float64)).astype(np.int64) // 8)
        live = live[equal & (length[live] < left[i])]
    length = np.minimum(length, left[at])
    reach = (length + at)[np.cumsum(lead) - 1]
    return np.maximum(reach - np.arange(n), 0)


def repeated_starts(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece, which of its windows start anywhere else in any piece."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    first = ends - lengths
    left = np.zeros(len(data), np.int64)
    left[:-1] = np.repeat(ends, lengths + 1) - np.arange(len(data) - 1)
    values = np.unique(data, return_inverse=True)[1].astype(np.uint16) + 1
    values[-1] = 0
    sa = suffix_array(values)
    with_last = permuted_prefixes(data, sa, left, first) >= window
    with_next = np.zeros(len(data), bool)
    with_next[sa[:-1]] = with_last[sa[1:]]
    flags = (with_last | with_next) & (left >= window)
    return [flags[a : max(a, b - window + 1)] for a, b in zip(first, ends, strict=True)]


def _pieces(shape: Shape, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            row, spans = list_parts(batch.column("spans"))
            start = np.asarray(spans.field("start"), np.int64)
            size = np.asarray(spans.field("count"), np.int64) + shape.window - 1
            whole = data.tobytes()
            cut = [whole[a : a + k] for a, k in zip(offsets[row] + start, size, strict=True)]
            pick = pa.array(row)
            arrays = [batch.column("doc_id").take(pick), batch.column("mark").take(pick), spans.field("seed"), spans.field("n"), spans.field("start"), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def _shards(window: int, schema: pa.Schema) -> Callable:
    def decide(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables)
        flags = repeated_starts(table.column("piece").to_pylist(), window)
        once = np.asarray(table.column("n")) == 1
        row, a, b = [], [], []
        for k in np.flatnonzero(once & np.array([f.any() for f in flags])):
            x, y = runs(flags[k])
            row.append(np.full(len(x), k))
            a.append(x)
            b.append(y)
        row, a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, a, b))
        start = np.asarray(table.column("start"), np.int64)[row]
        picked = table.select(["doc_id", "mark"]).take(pa.array(row)).combine_chunks()
        ids = [picked.column(c).combine_chunks() for c in ("doc_id", "mark")]
        ids = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in ids]
        return pa.RecordBatch.from_arrays([*ids, pa.array((start + a).astype(np.int32)), pa.array((start + b - 1 + window).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            seeds = np.asarray(batch.column("seed"), np.int64)
            if not len(seeds):
                continue
            change = np.concatenate([[0], np.flatnonzero(np.diff(seeds)) + 1, [len(seeds)]])
            bytes_to = np.append(0, np.cumsum(np.array([len(x.as_buffer()) for x in batch.column("piece")])))
            begin = 0
            for x in change[:-1]:
                if held_size(size, bytes_to[x] - bytes_to[begin]) and (x > 0 or seeds[0] != last):
                    if x > begin:
                        held.append(batch.slice(begin, x - begin))
                    yield decide(held)
                    held, size, begin = [], 0, x
            held.append(batch.slice(begin))
            size += int(bytes_to[-1] - bytes_to[begin])
            last = seeds[-1]
        if held:
            yield decide(held)

    def held_size(size: int, more: int) -> bool:
        return size + more >= SHARD_BYTES

    return run


def by_suffixes(texts: DataFrame, needed: DataFrame, shape: Shape) -> DataFrame:
    """Decide the windows of different spans by suffix arrays over shards of whole seeds.

    Seeds with very many different spans would not fit a shard: their windows are counted by hash, with the same result.
    """
    few = needed.withColumn("spans", F.expr(f"filter(spans, s -> s.kinds <= {SHARD_KINDS})")).where("size(spans) > 0")
    many = needed.withColumn("spans", F.expr(f"filter(spans, s -> s.kinds > {SHARD_KINDS})")).where("size(spans) > 0")
    schema = output(texts, "mark long, seed long, n long, start int, piece binary")
    pieces = with_text(texts, few).mapInArrow(_pieces(shape, arrow_schema(schema)), schema)
    ranges = output(texts, "mark long, start int, end int")
    found = pieces.repartition("seed").sortWithinPartitions("seed").mapInArrow(_shards(shape.window, arrow_schema(ranges)), ranges)
    return found.unionByName(by_frames(texts, many, shape))


def _cut(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            row, ranges = list_parts(batch.column("ranges"))
            gone = covered(len(data), *(offsets[row] + np.asarray(ranges.field(x), np.int64) for x in ("start", "end")))
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            first = gone.copy()
            first[1:] &= ~gone[:-1] | edge[1:-1]
            total, spans = (np.append(0, np.cumsum(x))[offsets] for x in (gone, first))
            kept, at = data[~gone], np.append(0, np.cumsum(~gone))[offsets]
            texts = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [np.diff(offsets), np.diff(total), np.diff(spans), [hashlib.sha256(x).hexdigest() for x in texts], texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, window: int = 400, anchor: int = 240) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    Texts are UTF-8 bytes. A byte goes if a string of ``window`` bytes over it also starts elsewhere, in another row
    or the same one; such strings may overlap. ``kept`` has the remaining bytes (a cut can split a code point, so it is
    binary), ``n_spans`` counts the maximal removed runs. A null text is empty; repeated rows are different places; ids
    may repeat or be null; other columns are ignored.
    """
    texts = keyed(docs)
    ranges = repeated_ranges(texts, Shape("byte", window, min(anchor, window)), by_suffixes)
    joined = texts.alias("t").join(ranges.alias("r"), F.expr("t.doc_id <=> r.doc_id AND t.mark = r.mark"), "left").select("t.doc_id", "t.text", "r.ranges")
    schema = output(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return joined.mapInArrow(_cut(arrow_schema(schema)), schema)


