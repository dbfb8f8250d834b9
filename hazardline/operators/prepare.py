"""Feature preparation fitted on one table and applied to any other.

What is fitted is small (one number per column, one entry per category) and comes from a single aggregate;
applying it is a projection that adds no shuffle. Only ``WideOneHot`` keeps its categories as a table and joins them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardline.operators.aggregates import safe_name
from hazardline.session import stage_table


def _seen(name: str) -> Column:
    """The column with NaN counted as missing."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


@dataclass(frozen=True)
class MeanImputer:
    means: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "MeanImputer":
        if not columns:
            return cls({})
        row = df.agg(*[F.avg(_seen(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
        empty = [c for i, c in enumerate(columns) if row[i] is None]
        if empty:
            raise ValueError(f"no value at all in column(s) {empty}: nothing to impute from")
        return cls(dict(zip(columns, row)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(_seen(c), F.lit(m)) for c, m in self.means.items()})


@dataclass(frozen=True)
class OneHot:
    column: str
    categories: list[str]
    missing_level: bool = False
    prefix: str = ""

    @classmethod
    def fit(
        cls, df: DataFrame, column: str, missing_level: bool = False, prefix: str | None = None, max_categories: int = 5000
    ) -> "OneHot":
        """Sorted categories, one column each. For more than ``max_categories`` there is ``WideOneHot``."""
        found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_categories + 1).collect()
        if len(found) > max_categories:
            raise ValueError(f"{column} has over {max_categories} categories: use WideOneHot")
        return cls(column, sorted(str(r[0]) for r in found), missing_level, column + "_" if prefix is None else prefix)

    def names(self) -> list[str]:
        return [self.prefix + safe_name(c) for c in self.categories] + ([self.prefix + "missing"] if self.missing_level else [])

    def columns(self) -> list[Column]:
        """One 0/1 column per category; an unknown or missing value is all zeros."""
        text = F.col(self.column).cast("string")
        flags = [F.coalesce(text == c, F.lit(False)).cast("int") for c in self.categories]
        flags += [F.col(self.column).isNull().cast("int")] if self.missing_level else []
        return [f.alias(n) for f, n in zip(flags, self.names())]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.columns())


@dataclass(frozen=True)
class WideOneHot:
    """Sparse 0/1 vectors over any number of categories, looked up in a written table (value, slot).

    Slots count the values in byte order from 0. With ``missing_level`` a missing value has the last slot; else it is all
    zeros, as an unknown value always is.
    """

    column: str
    table: DataFrame
    categories: int
    missing_level: bool = False

    @classmethod
    def fit(cls, df: DataFrame, column: str, missing_level: bool = False) -> "WideOneHot":
        values = df.select(F.col(f"`{column}`").cast("string").alias("value")).where("value IS NOT NULL").distinct()
        ranged = stage_table(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "categories")
        counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
        total = sum(counts.values())
        if not total and not missing_level:
            raise ValueError(f"no value at all in {column}")
        before, running = [], 0
        for part in range(max(counts, default=0) + 1):
            before.append(F.lit(running))
            running += counts.get(part, 0)
        inside = F.row_number().over(Window.partitionBy("part").orderBy("value"))
        slots = ranged.select("value", (inside - 1 + F.element_at(F.array(*before), F.col("part") + 1)).cast("int").alias("slot"))
        return cls(column, stage_table(slots, "slots"), total, missing_level)

    @property
    def size(self) -> int:
        return self.categories + int(self.missing_level)

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """Adds the sparse vector. Spark broadcasts the table if it is small, and splits frequent values if it is not."""
        # the encoder takes its width from the largest slot; one slot above it means all zeros
        widest = df.sparkSession.createDataFrame([(float(self.size - 1),)], "__slot double")
        encoder = OneHotEncoder(inputCol="__slot", outputCol=out, dropLast=True, handleInvalid="keep").fit(widest)
        own = F.col(f"`{self.column}`").cast("string")
        known = self.table.select(F.col("value").alias("__value"), F.col("slot").cast("double").alias("__slot"))
        joined = df.join(known, own == F.col("__value"), "left")
        missing = F.when(own.isNull(), F.lit(float(self.categories))) if self.missing_level else F.lit(None).cast("double")
        slot = F.coalesce("__slot", missing, F.lit(float(self.size)))
        return encoder.transform(joined.withColumn("__slot", slot)).drop("__value", "__slot")


@dataclass(frozen=True)
class Standardizer:
    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Standardizer":
        # one row for each value: a single aggregate of every column is too large a method to be compiled
        values = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("i", "v"))
        rows = values.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).collect()
        found = {r["i"]: (float(r["mean"]), float(r["std"])) for r in rows}
        return cls({c: found[i] for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / population standard deviation; a constant column becomes 0."""
        made = {}
        for c, (mean, std) in self.stats.items():
            made[c] = (F.col(f"`{c}`") - F.lit(mean)) / F.lit(std) if std > 0 else F.col(f"`{c}`") * F.lit(0.0)
        return df.withColumns(made)


def assemble_features(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """Ordered feature columns as one ``array<double>``, the names kept in the column's metadata."""
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    return df.withColumn(out, values.alias(out)).withMetadata(out, {"features": list(names)})


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    return list(df.schema[column].metadata.get("features", []))
