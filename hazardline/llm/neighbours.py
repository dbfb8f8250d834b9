"""Approximate nearest neighbours by inner product: vantage-point trees per shard, with relaxed triangle pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


LEAF = 128
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
RELAX = 1.15


class VantageTree:
    """Points in Euclidean space, split at each node by the median distance to a vantage point."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = rows[0]
        far = np.argmax(((self.points[rows] - self.points[vantage]) ** 2).sum(1))
        vantage = rows[far]
        distance = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(1))
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        inner, outer = rows[order[:half]], rows[order[half:]]
        return (vantage, distance[order[half - 1]], distance[order[half]], self._build(inner), self._build(outer))

    def search(self, queries: np.ndarray, scan, bound, relax: float) -> None:
        """Visit leaves for all queries together, the nearer half of a node first.

        ``scan(query rows, leaf rows)`` takes candidates and ``bound()`` gives each query's largest distance still of
        use. By the triangle inequality a half whose shell is further than that from the query is skipped; a factor
        ``relax`` over one skips shells that are a little nearer, and one keeps the search exact.
        """

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                scan(q, node)
                return
            vantage, inner_most, outer_least, inner, outer = node
            d = np.sqrt(((queries[q] - self.points[vantage]) ** 2).sum(1))
            to_inner, to_outer = d - inner_most, outer_least - d
            first = to_inner <= to_outer
            slack = 1e-9 * (1 + d)
            for part, other_gap, a, b in ((q[first], to_outer[first] - slack[first], inner, outer), (q[~first], to_inner[~first] - slack[~first], outer, inner)):
                visit(a, part)
                visit(b, part[other_gap * relax <= bound()[part]])

        visit(self.root, np.arange(len(queries)))


def _smallest(ids: np.ndarray, k: int) -> np.ndarray:
    """Of ids in order, as many as leave the k smallest when all of any one id are left out."""
    first = np.append(True, ids[1:] != ids[:-1])
    start = np.flatnonzero(first)
    place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    return ids[place < k][: 2 * k]


def nearest_in_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float, top_norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's best k in the shard, ties to the smaller id.

    Largest inner product is least distance once each vector has one more component that brings it to the norm
    ``top_norm``. Equal vectors are one point that keeps the smallest ids, each at most k times, until k remain without
    any one of them.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    points, member = np.unique(vectors, axis=0, return_inverse=True)
    member = member.ravel()
    by_point = np.argsort(member, kind="stable")
    start = np.searchsorted(member[by_point], np.arange(len(points) + 1))
    held = [_smallest(ids[by_point[a:b]], k) for a, b in zip(start[:-1], start[1:], strict=True)]
    norms = (points**2).sum(1)
    tree = VantageTree(np.column_stack([points, np.sqrt(np.maximum(top_norm**2 - norms, 0))]))
    flat = np.column_stack([queries, np.zeros(len(queries))])
    lengths = (queries**2).sum(1)
    best_score = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def scan(q: np.ndarray, rows: np.ndarray) -> None:
        owner = np.concatenate([held[r] for r in rows])
        point = np.repeat(np.arange(len(rows)), [len(held[r]) for r in rows])
        for part in np.array_split(q, 1 + len(q) * len(owner) // 4_000_000):
            score = np.einsum("ij,kj->ik", queries[part], points[rows], optimize=False)[:, point]
            score = np.where(owner[None, :] == query_ids[part][:, None], -np.inf, score)
            all_scores = np.concatenate([best_score[part], score], 1)
            all_ids = np.concatenate([best_id[part], np.broadcast_to(owner, score.shape)], 1)
            pick = np.lexsort((all_ids, -all_scores))[:, :k]
            best_score[part] = np.take_along_axis(all_scores, pick, 1)
            best_id[part] = np.take_along_axis(all_ids, pick, 1)

    def bound() -> np.ndarray:
        return np.sqrt(np.maximum(lengths + top_norm**2 - 2 * best_score[:, -1], 0))

    tree.search(flat, scan, bound, relax)
    some = np.isfinite(best_score)
    return query_ids[np.nonzero(some)[0]], best_id[some], best_score[some]


def _pack(table: pa.Table, key: str) -> pa.Table:
    table = table.combine_chunks()
    ids = np.asarray(table.column("vec_id"), np.int64)
    vectors = np.array(table.column("vector").to_pylist(), np.float64)
    return pa.table({key: table.column(key).slice(0, 1), "n": pa.array([len(ids)]), "data": pa.array([ids.tobytes() + vectors.tobytes()], pa.binary())})


def _unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, -1, 8 * n).reshape(n, -1)


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, relax: float = RELAX) -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors whose ``vec_id`` is divisible by ``every``, against all others.

    ``embeddings`` (vec_id, embedding). Score is the inner product in double precision, rank 1 the largest, ties to the
    smaller id. Vectors that are null, all zero, or hold a null or non-finite component take no part, nor do rows
    without id; repeated ids are separate candidates, and a query's own id never is one. A query repeated with the same
    vector asks once; one with several vectors is ranked over the answers of all. Vectors must have one length.
    Shards hold about ``SHARD_ROWS`` vectors, so a task's memory does not grow; each block of ``BLOCK_ROWS`` queries
    meets every shard once. ``relax`` 1 is exact.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select("vec_id", vector.alias("vector")).where("vec_id is not null").where(F.coalesce(fine, F.lit(False)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, n_queries, top = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(norm)).first()
    shards, parts = 1 + n // SHARD_ROWS, 1 + n_queries // BLOCK_ROWS
    deal = F.xxhash64("vec_id", "vector")
    # repeated rows are dealt out one by one, and asked once
    number = F.xxhash64("vec_id", "vector", F.monotonically_increasing_id())
    trees = rows.withColumn("shard", F.pmod(number, F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(lambda _, t: _pack(t, "shard"), "shard int, n long, data binary")
    blocks = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("block", F.pmod(deal, F.lit(parts)).cast("int"))
    blocks = blocks.groupBy("block").applyInArrow(lambda _, t: _pack(t, "block"), "block int, n long, data binary")
    # every block meets every shard: as many rows as blocks times shards, each of bounded size
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("n").alias("asked"), F.col("data").alias("queries"))
    met = trees.join(asked, "shard").select("n", "data", "asked", "queries")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = nearest_in_shard(*_unpack(at["n"], at["data"]), *_unpack(at["asked"], at["queries"]), k, relax, top * (1 + 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
