"""Per-subject summaries of the observation table.

Everything about one subject comes out of conditional aggregates in a single ``groupBy``: partial
aggregation runs before the shuffle, so a subject with a third of all observations costs one
partial row per input task. Entropy needs the subject total first and is a second pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardline.functions.scalars import ratio_or_zero

ENTROPY_EPS = 1e-8


def safe_name(item: str) -> str:
    """Item value as a column-name part."""
    return re.sub(r"\W", "_", item)


def value_frequencies(df: DataFrame, item: str) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(item))


def top_n_values(df: DataFrame, item: str, n: int) -> DataFrame:
    """The n most frequent non-missing values; a tie at the end goes to the smaller value."""
    return value_frequencies(df.where(F.col(item).isNotNull()), item).limit(n)


def top_n_list(df: DataFrame, item: str, n: int) -> list[str]:
    return [row[0] for row in top_n_values(df, item, n).collect()]


def basic_stats(value: str, names: Sequence[str] = ("count", "mean", "max", "std")) -> list[Column]:
    made = {
        "count": F.count(F.lit(1)).alias("obs_count"),
        "mean": F.avg(value).alias("val_mean"),
        "max": F.max(value).alias("val_max"),
        "std": F.stddev_samp(value).alias("val_std"),
    }
    return [made[n] for n in names]


def flag_columns(item: str, items: Sequence[str], prefix: str = "has_") -> list[Column]:
    """1 if the item occurs, else 0: the pivot of a constant over a fixed list."""
    return [F.max(F.coalesce((F.col(item) == v).cast("int"), F.lit(0))).alias(prefix + safe_name(v)) for v in items]


def mean_columns(item: str, value: str, items: Sequence[str], prefix: str = "mean_") -> list[Column]:
    """Mean value per item, missing where the item does not occur."""
    return [F.avg(F.when(F.col(item) == v, F.col(value))).alias(prefix + safe_name(v)) for v in items]


def _seen_members(item: str, members: Sequence[str]) -> Column:
    """How many members occur. One flag each, so that no distinct count has to expand the rows."""
    flags = [F.coalesce(F.max((F.col(item) == m).cast("int")), F.lit(0)) for m in dict.fromkeys(members)]
    return reduce(lambda a, b: a + b, flags)


SET_STATS = ("flag", "count", "mean", "fraction_distinct", "fraction_count", "interaction")


def set_columns(
    item: str,
    value: str,
    sets: Mapping[str, Sequence[str]],
    stats: Sequence[str] = SET_STATS,
    top: Sequence[str] | None = None,
    prefix: str = "set_",
) -> list[Column]:
    """Summaries of the observations inside each named set.

    ``fraction_count`` divides by the number of set members that are also in ``top`` (0 if none).
    """
    made = []
    for name, members in sets.items():
        inside = F.col(item).isin(list(members))
        count = F.coalesce(F.count_if(inside), F.lit(0))
        mean = F.coalesce(F.avg(F.when(inside, F.col(value))), F.lit(0.0))
        shared = len(set(members) & set(members if top is None else top))
        parts = {
            "flag": F.max(F.coalesce(inside, F.lit(False)).cast("int")),
            "count": count,
            "mean": mean,
            "fraction_distinct": _seen_members(item, members) / F.lit(float(len(members))),
            "fraction_count": ratio_or_zero(count, F.lit(shared)),
            "interaction": count * mean,
        }
        made += [parts[s].alias(f"{prefix}{safe_name(name)}_{s}") for s in stats]
    return made


def pair_columns(item: str, pairs: Sequence[tuple[str, str]], prefix: str = "both_") -> list[Column]:
    """1 if both items of a pair occur."""

    def seen(v: str) -> Column:
        return F.max((F.col(item) == v).cast("int"))

    return [
        F.least(F.coalesce(seen(a), F.lit(0)), F.coalesce(seen(b), F.lit(0))).alias(f"{prefix}{safe_name(a)}_{safe_name(b)}")
        for a, b in pairs
    ]


def pair_counts(obs: DataFrame, key: str, item: str, block_items: int = 256) -> DataFrame:
    """(a, b, n) with a < b: subjects in which both items occur, over all pairs of items that meet at all.

    Items are dealt to blocks of about ``block_items``; a subject's items form one row a block, and pairs are made per pair
    of blocks. Block pairs are spread by (subject, block), so a subject with very many items is the work of as many tasks
    as it has blocks, and no row holds more than a block.
    """
    used = obs.select(F.col(key).alias("k"), F.col(item).alias("item")).where("k IS NOT NULL AND item IS NOT NULL")
    blocks = max(1, math.ceil(used.agg(F.approx_count_distinct("item")).first()[0] / block_items))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    # distinct first, so that repeats of a hot subject are gone before its items are gathered
    filled = used.distinct().groupBy("k", block).agg(F.collect_list("item").alias("items"))
    listed = filled.groupBy("k").agg(F.collect_list("block").alias("blocks"))
    earlier = F.explode(F.filter("blocks", lambda b: b <= F.col("block"))).alias("first")
    others = filled.join(listed, "k").select("k", F.col("block").alias("second"), F.col("items").alias("others"), earlier)
    met = filled.withColumnRenamed("block", "first").join(others, ["k", "first"])
    one = met.select("first", "second", "others", F.explode("items").alias("x"))
    both = one.select("first", "second", "x", F.explode("others").alias("y")).where("first <> second OR x < y")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def density_column(label: str, wanted: str, length: int, out: str = "density") -> Column:
    """Observations carrying one label per unit length; the label is compared as text."""
    return (F.count_if(F.col(label).cast("string") == wanted) / F.lit(float(length))).alias(out)


def agg_distinct(item: str, out: str = "n_distinct") -> Column:
    return F.count_distinct(item).alias(out)


def summarize(obs: DataFrame, key: str, columns: Sequence[Column]) -> DataFrame:
    return obs.groupBy(key).agg(*columns)


def agg_entropy(obs: DataFrame, key: str, value: str, out: str = "entropy") -> DataFrame:
    """``-sum(p ln(p + 1e-8))`` with p the share of the subject's total; total 0 gives 0.

    The total joins back by key instead of a window, so a hot subject stays spread: its rows are
    split by the skew join and collapse again in the partial aggregate.
    """
    slim = obs.select(key, value)
    totals = slim.groupBy(key).agg(F.sum(value).alias("__total"))
    share = F.try_divide(F.col(value), F.col("__total"))
    return (
        slim.join(totals, key)
        .groupBy(key)
        .agg((-F.coalesce(F.sum(share * F.log(share + ENTROPY_EPS)), F.lit(0.0)) + F.lit(0.0)).alias(out))
    )


def align_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer alignment of two summary tables on the key."""
    return left.join(right, key, "full")


def align_with_fill(subjects: DataFrame, summary: DataFrame, key: str, fill: float = 0) -> DataFrame:
    """Summary looked up for every subject, ``fill`` where the subject has none."""
    new = [c for c in summary.columns if c != key]
    return subjects.join(summary, key, "left").fillna(fill, subset=new)


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and population variance."""
    stats = df.select(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var_pop")) for i, c in enumerate(columns)]
    return stats.select(F.inline(F.array(*rows)))


def top_k_by_variance(df: DataFrame, columns: Sequence[str], k: int = 30) -> DataFrame:
    return column_moments(df, columns).orderBy(F.desc("var_pop"), F.asc("feature")).limit(k)


def top_k_by_score(df: DataFrame, score: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(name)).limit(k)


def ensemble_mean(scores: DataFrame, key: str, score: str, out: str = "risk_score") -> DataFrame:
    """Plain mean of several models' scores, given in long form."""
    return scores.groupBy(key).agg(F.avg(score).alias(out))
