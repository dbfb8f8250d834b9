"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions; SQL only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardline.session import stage_table

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources weigh ``weights``, repeated, in code point order with null last, and share the total size; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight. With sources in the order of
    size / weight, the capped ones come first, so sums up to and after each give the one level at which all is shared.
    One row per source is all that a window here orders.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*map(F.lit, weights))[((F.row_number().over(order) - 1) % len(weights)).cast("int")]
    ranked = sizes.withColumn("weight", pick).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("source_size").over(Window.partitionBy())
    level = ((total - before) / left).alias("level")
    # the first source whose cap is above the level sets it; if there is none, every source is at its cap
    levels = ranked.select("source", "source_size", "weight", "cap", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    filled = levels.withColumn("at", F.col("level") * 0 + first["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("at", F.lit(float("inf"))))
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = SEED, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source at least) and size, source_size, target, copies, taken; one row per row.

    ``size`` counts the words of the whole text (null: 0). With r = target / source_size, a document is taken floor(r)
    times, and the rest of the target is filled by one more copy of documents in the order of md5(seed, id), as long as
    half of the next still fits: a source misses its target by half a document at most. Equal ids are ordered by text.
    Sums over the order are kept per (source, first three digits of the hash), and only the slice in which a source's
    rest ends is ordered itself. Columns of ``docs`` with one of the names above are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    turn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", "source", n_words("text").alias("size"), turn.alias("turn"), F.xxhash64("text").alias("mark"))
    # every text is split into words once; what follows reads these narrow rows
    sized = stage_table(sized.withColumn("slice", F.substring("turn", 1, 3)), "sized")
    slices = stage_table(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    goals = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), most, weights)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("whole", ratio).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("slice")
    before = F.coalesce(F.sum("slice_size").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = slices.withColumn("before", before).alias("a").join(goals.alias("b"), F.expr("a.source <=> b.source"))
    plan = plan.select("a.source", "slice", "source_size", "target", "whole", "rest", "before", (F.col("before") + F.col("slice_size")).alias("after"))
    plan = stage_table(plan, "plan")
    joined = sized.alias("a").join(plan.alias("b"), F.expr("a.source <=> b.source AND a.slice = b.slice")).select("a.*", "source_size", "target", "whole", "rest", "before", "after")
    cut = F.col("rest").between(F.col("before"), F.col("after"))
    clear = joined.where(~cut).withColumn("extra", F.when(F.col("after") < F.col("rest"), 1).otherwise(0))
    inside = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "mark", "size")
    upto = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    edge = joined.where(cut).withColumn("extra", F.when(upto <= F.col("rest"), 1).otherwise(0))
    copies = F.col("whole") + F.col("extra")
    taken = clear.unionByName(edge).select("doc_id", "mark", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    if set(docs.columns) <= {"doc_id", "source"}:
        return taken.drop("mark", "source")
    return taken


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, once each, with the columns of ``docs`` and those of ``mix_sources``."""
    taken = mix_sources(docs, **options).where("copies > 0").dropDuplicates(["doc_id", "mark", "source"])
    rest = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("mark", F.xxhash64("text"))
    at = F.expr("a.doc_id <=> b.doc_id AND a.mark = b.mark AND a.source <=> b.source")
    columns = [f"b.{c}" for c in ("size", "source_size", "target", "copies", "taken")]
    return rest.alias("a").join(taken.alias("b"), at).select("a.*", *columns).drop("mark")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM ranked),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(
    (SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap), 'inf'::DOUBLE)) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id) - size / 2 AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""
