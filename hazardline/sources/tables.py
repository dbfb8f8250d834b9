"""Typed readers for the cohort inputs and writers for its outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardline.sources.fixed import DOUBLE_COLUMNS, MISSING_TOKENS

SUBJECT_SCHEMA = T.StructType(
    [T.StructField("ID", T.StringType()), T.StructField("CENTER", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in DOUBLE_COLUMNS]
    + [T.StructField("CYTOGENETICS", T.StringType())]
)
OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("CHR", T.StringType()),
        T.StructField("START", T.LongType()),
        T.StructField("END", T.LongType()),
        T.StructField("REF", T.StringType()),
        T.StructField("ALT", T.StringType()),
        T.StructField("GENE", T.StringType()),
        T.StructField("PROTEIN_CHANGE", T.StringType()),
        T.StructField("EFFECT", T.StringType()),
        T.StructField("VAF", T.DoubleType()),
    ]
)
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("OS_YEARS", T.DoubleType()),
        T.StructField("OS_STATUS", T.IntegerType()),
    ]
)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Header CSV with an explicit schema.

    Columns are matched by header name, so their order in the file is free and absent optional
    ones read as NULL. Everything is read as text and cast here: a missing token becomes NULL and
    a number that does not parse raises instead of silently turning into a missing value. A quote inside quoted text is
    doubled; blanks around text stay. ``multi_line`` allows line breaks in quoted text, at the price of one task a file.
    A record with a wrong number of fields stops the read.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST")
    present = set(raw.columns)

    def typed(field: T.StructField):
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            text = F.trim(text)
        known = F.when(~text.isin(list(MISSING_TOKENS)), text)
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            # "1.0" is how a nullable integer column is usually written
            known = known.cast("double")
        return known.cast(field.dataType).alias(field.name)

    return raw.select(*[typed(f) for f in schema.fields])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columnar table; naming the columns prunes the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_scores(scores: DataFrame, path: str, key: str = "ID", risk: str = "risk_score") -> None:
    """Two-column result with a header, replacing what was there."""
    scores.select(F.col(key).alias("ID"), F.col(risk).alias("risk_score")).write.mode("overwrite").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ID string, risk_score double").csv(path, header=True)


def feature_table_sink(wide: DataFrame, path: str) -> DataFrame:
    """Persist the wide feature table and hand back a reader of it (column order kept)."""
    names = wide.columns
    wide.write.mode("overwrite").parquet(path)
    return wide.sparkSession.read.parquet(path).select(*[f"`{n}`" for n in names])
