"""Total orders at scale: hash-order ranks and cuts, cumulative sums, step look-ups.

None of these moves all rows of a group through one task. A global order is cut into value
buckets; a window runs inside each bucket, and the (bounded) table of bucket totals carries the
rest. Hash order uses the first four hex digits as the bucket, value order uses quantile edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardline.session import cut_lineage

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 1024
_ONE = "__all"
_HEX = 4


def hash_order(keys: Sequence[str], seed: int = 42, salt: str = "") -> Column:
    """md5 text of (seed, salt, key): a fixed pseudo-random order of the keys."""
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt else [])
    return F.md5(F.concat_ws("|", *parts, *[F.col(k).cast("string") for k in keys]))


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ONE, F.lit(1)), [_ONE])


def hash_cuts(df: DataFrame, keys: Sequence[str], by: Sequence[str], targets: Callable[[Column], Column], seed: int) -> DataFrame:
    """Per group of ``by``: the hash at each wanted rank, as array ``cuts`` in ascending order.

    ``targets(total)`` gives an array of 1-based ranks. Counting by hash prefix finds the prefix
    holding each rank (65,536 prefixes at most), and only rows of that prefix are then ordered.
    """
    keyed, by = _grouped(df, by)
    keyed = keyed.select(*by, hash_order(keys, seed).alias("__h")).withColumn("__p", F.substring("__h", 1, _HEX))
    counts = keyed.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*by).orderBy("__p")
    marks = (
        counts.withColumn("__upto", F.sum("__n").over(along))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(*by)))
        .withColumn("__rank", F.explode(targets(F.col("__total"))))
        .where((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__n")))
        .select(*by, "__p", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__k"))
    )
    inside = keyed.join(marks.select(*by, "__p").distinct(), [*by, "__p"], "left_semi")
    ordered = (
        inside.groupBy(*by, "__p", "__h")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by, "__p").orderBy("__h")))
    )
    found = ordered.join(marks, [*by, "__p"]).where(
        (F.col("__k") <= F.col("__upto")) & (F.col("__k") > F.col("__upto") - F.col("__n"))
    )
    return found.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias("cuts"))


def _with_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[str], most: int = 64) -> DataFrame:
    """Add each row's ``cuts``. Up to ``most`` groups they become literals, so the table is not even joined."""
    few = cuts.limit(most + 1).collect()
    if len(few) > most:
        return df.join(cuts, list(by), "left")
    chain = F.lit(None).cast("array<string>")
    for row in few:
        here = F.array(*[F.lit(h) for h in row["cuts"]])
        mine = reduce(lambda a, b: a & b, [F.col(c) == F.lit(row[c]) for c in by], F.lit(True))
        chain = F.when(mine, here).otherwise(chain)
    return df.withColumn("cuts", chain)


def stratified_split(
    df: DataFrame, key: str, stratum: str | None, share: float = 0.2, seed: int = 42, out: str = "part"
) -> DataFrame:
    """'valid' for exactly ``ceil(share * n)`` rows of each stratum in hash order, else 'train'."""
    by = [stratum] if stratum else []
    wanted = hash_cuts(df, [key], by, lambda n: F.array(F.ceil(F.round(n * F.lit(share), 9))), seed)
    joined = _with_cuts(df, wanted, by)
    is_valid = hash_order([key], seed) <= F.element_at("cuts", 1)
    return joined.withColumn(out, F.when(is_valid, "valid").otherwise("train")).drop("cuts")


def kfold_assign(df: DataFrame, key: str, folds: int = 3, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold 1..k by contiguous runs of the hash order; the first ``n mod k`` folds get one row more."""

    def ends(n: Column) -> Column:
        size, extra = F.floor(n / folds), n % folds
        return F.array(*[F.lit(i) * size + F.least(F.lit(i), extra) for i in range(1, folds)])

    joined = _with_cuts(df, hash_cuts(df, [key], [], ends, seed), [])
    h = hash_order([key], seed)
    passed = F.filter(F.coalesce("cuts", F.array().cast("array<string>")), lambda c: h > c)
    return joined.withColumn(out, (F.size(passed) + 1).cast("int")).drop("cuts")


def hash_rank(df: DataFrame, key: str, seed: int = 42, salt: str = "", out: str = "rank") -> DataFrame:
    """Exact 1..n rank of every row in hash order, by prefix offsets plus a window inside a prefix."""
    keyed = df.withColumn("__h", hash_order([key], seed, salt)).withColumn("__p", F.substring("__h", 1, _HEX))
    counts = keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn(_ONE, F.lit(1))
    before = Window.partitionBy(_ONE).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__p").orderBy("__h", key)
    return (
        keyed.withColumn("__r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__p")
        .withColumn(out, F.col("__r") + F.col("__before"))
        .drop("__h", "__p", "__r", "__before")
    )


# ---- value order -------------------------------------------------------------------------------


def even_shares(n: int, first: int = 1, last: int | None = None) -> Column:
    """Literal array ``first/n .. last/n``, parsed once instead of built value by value."""
    return F.expr("array(" + ", ".join(f"{i / n!r}D" for i in range(first, (n if last is None else last + 1))) + ")")


def value_edges(df: DataFrame, col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[list[float], list[int]]:
    """Bucket edges for ``col`` and the buckets that hold a single, very frequent value.

    The edges are approximate quantiles, which only affects balance: results downstream are exact
    for any edges. A value that fills more than one quantile gets a bucket of its own.
    """
    rows, found = df.select(F.count(col), F.percentile_approx(F.col(col).cast("double"), even_shares(MAX_BUCKETS), F.lit(20 * MAX_BUCKETS))).first()
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if buckets <= 1:
        return [], []
    return edges_from_quantiles(thinned(found, buckets))


def thinned(found: Sequence[float], buckets: int) -> list[float]:
    """The ``buckets - 1`` inner quantiles nearest to even among a finer list of them."""
    n = len(found) + 1
    return [found[max(0, round(i * n / buckets) - 1)] for i in range(1, buckets)]


def edges_from_quantiles(found: Sequence[float]) -> tuple[list[float], list[int]]:
    distinct = sorted(set(found))
    hot = {v for v in distinct if list(found).count(v) > 1}
    cuts = sorted(set(distinct) | {float(np.nextafter(v, np.inf)) for v in hot})
    return cuts, [cuts.index(v) + 1 for v in sorted(hot)]


def bucketize(df: DataFrame, col: str, edges: Sequence[float], out: str) -> DataFrame:
    """Bucket number of ``col``: how many edges are <= the value."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *edges, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="__v", outputCol=out).transform(df.withColumn("__v", F.col(col).cast("double")))
    return binned.withColumn(out, F.col(out).cast("int")).drop("__v")


class OrderedTable:
    """A table with one row per (group, order value), ready for cumulative columns over that order."""

    def __init__(
        self, df: DataFrame, order: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET, edges: Sequence[float] | None = None
    ):
        self.order, self.by = order, list(by)
        self.edges = value_edges(df, order, rows_per_bucket)[0] if edges is None else list(edges)
        self.df = bucketize(df, order, self.edges, "__b")
        if self.edges:
            # every cumulative column reads the table twice (inside and across buckets)
            self.df = cut_lineage(self.df)

    def running(self, columns: dict[str, Column], how: str = "sum", backward: bool = False) -> "OrderedTable":
        """Add columns: sum or product of each value from the start (or from the end) up to the row itself."""
        fold = {"sum": F.sum, "product": F.product}[how]

        # backward means the reverse order: a frame open at the far end would be recomputed for every row
        def along(name: str) -> Column:
            return F.desc(name) if backward else F.asc(name)

        inner = Window.partitionBy(*self.by, "__b").orderBy(along(self.order)).rowsBetween(Window.unboundedPreceding, 0)
        local = self.df.withColumns({out: fold(value).over(inner) for out, value in columns.items()})
        if self.edges:
            across = Window.partitionBy(*(self.by or [F.lit(1)])).orderBy(along("__b")).rowsBetween(Window.unboundedPreceding, -1)
            totals = self.df.groupBy(*self.by, "__b").agg(*[fold(v).alias(f"__t_{out}") for out, v in columns.items()])
            carry = totals.select(*self.by, "__b", *[fold(f"__t_{out}").over(across).alias(f"__c_{out}") for out in columns])
            local = local.join(carry, [*self.by, "__b"])
            for out in columns:
                rest = F.coalesce(f"__c_{out}", F.lit(0) if how == "sum" else F.lit(1.0))
                local = local.withColumn(out, F.col(out) + rest if how == "sum" else F.col(out) * rest).drop(f"__c_{out}")
        self.df = local
        return self

    def result(self) -> DataFrame:
        return self.df.drop("__b")


def step_lookup(
    queries: DataFrame, steps: DataFrame, at: str, value: str, rows_per_bucket: int = ROWS_PER_BUCKET, default: float | None = None
) -> DataFrame:
    """``value`` of the last step at or before each query's ``at`` (right-continuous step function).

    Only the distinct query points are ordered against the steps, so any number of rows may share
    one point; the answer is joined back by that point.
    """
    points = queries.select(at).distinct()
    both = (
        points.withColumn("__s", F.lit(None).cast("double"))
        .unionByName(steps.select(F.col(at), F.col(value).alias("__s")))
        .groupBy(at)
        .agg(F.max("__s").alias("__s"))
    )
    edges, _ = value_edges(both, at, rows_per_bucket)
    placed = bucketize(both, at, edges, "__b")
    inner = Window.partitionBy("__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("__f", F.last("__s", ignorenulls=True).over(inner))
    if edges:
        ends = placed.groupBy("__b").agg(F.max_by("__s", F.when(F.col("__s").isNotNull(), F.col(at))).alias("__e"))
        before = Window.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).drop("__e")
        local = local.join(F.broadcast(carry), "__b").withColumn("__f", F.coalesce("__f", "__c"))
    answer = F.col("__f") if default is None else F.coalesce("__f", F.lit(default))
    return queries.join(local.select(at, answer.alias(value)), at, "left")
