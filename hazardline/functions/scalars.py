"""Numeric column expressions with the reference data's missing-value rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Right-closed age bins and the low-haemoglobin limit.
AGE_EDGES = [0.0, 40.0, 60.0, 80.0, 100.0]
LOW_HB = 10.0


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold_flag(condition: Column) -> Column:
    """1 where the condition holds; a missing value never satisfies it."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def presence_indicator(col: Column | str) -> Column:
    return col_of(col).isNotNull().cast("int")


def bin_numeric(col: Column | str, edges: Sequence[float] = AGE_EDGES) -> Column:
    """Index of the right-closed bin ``(edges[i], edges[i+1]]``; NULL outside all of them."""
    value = col_of(col)
    chain = F.when(value <= edges[0], F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        chain = chain.when(value <= upper, F.lit(i))
    return chain


def column_or_default(df: DataFrame, name: str, default: float, type_: str = "double") -> Column:
    """The column if the table has it, else a constant of the same type."""
    if name in df.columns:
        return F.col(name).cast(type_)
    return F.lit(default).cast(type_)


def make_label(event: str, time: str) -> Column:
    """(event, time) pair; a negative or missing time is an error, not a label."""
    bad = F.col(event).isNull() | F.col(time).isNull() | (F.col(time) < 0)
    checked = F.when(bad, F.raise_error(F.lit("label needs an event and a time >= 0")).cast("double"))
    return F.struct(
        F.col(event).cast("boolean").alias("event"),
        checked.otherwise(F.col(time).cast("double")).alias("time"),
    )


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for a zero or missing divisor (ANSI division would raise)."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))
