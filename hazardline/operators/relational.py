"""Row and column selection, label joins and set operations, by key and by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_unlabelled(df: DataFrame, event: str, time: str) -> DataFrame:
    return df.dropna(subset=[event, time])


def filter_in_set(df: DataFrame, item: str, members: Sequence[str]) -> DataFrame:
    return df.where(F.col(item).isin(list(members)))


def filter_in_table(df: DataFrame, item: str, members: DataFrame) -> DataFrame:
    """Membership in a table of values, for sets that are themselves query results."""
    return df.join(members.select(item).distinct(), item, "left_semi")


def filter_equals(df: DataFrame, label: str, wanted: str) -> DataFrame:
    """Equality as text, so that a label column mixing numbers and letters compares as expected."""
    return df.where(F.col(label).cast("string") == wanted)


def filter_by_label(df: DataFrame, label: str, value: object) -> DataFrame:
    return df.where(F.col(label) == F.lit(value))


def derive_constant(df: DataFrame, name: str = "flag", value: object = 1) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c if c in keep else prefix + c for c in df.columns])


def select_by_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if c in keep or c.startswith(tuple(prefixes))])


def drop_if_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def project_feature_subset(df: DataFrame, names: Sequence[str], picked: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Features chosen by their index in the ordered name list."""
    return df.select(*keep, *[names[i] for i in picked])


def fill_constant(df: DataFrame, value: float | str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(columns) if columns else None)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def interaction(a: Column, b: Column) -> Column:
    return a * b


def join_labels(subjects: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return subjects.join(labels, key, "inner")


def join_left_features(subjects: DataFrame, features: DataFrame, key: str) -> DataFrame:
    return subjects.join(features, key, "left")


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersect_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values present in both one-column tables."""
    return a.intersect(b)
