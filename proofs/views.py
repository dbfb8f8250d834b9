"""The given tables seen as a cohort, in Spark and in SQL.

A subject is an order, its observations are its line items (some orders have none), its label is the
time to the order date with the order status as event. Whole tables, no sampling.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SET_A = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
SET_B = ["Brand#5", "Brand#6", "Brand#7", "Brand#8"]
SET_C = ["Brand#9", "Brand#10", "Brand#11"]
SET_D = ["Brand#12", "Brand#13", "Brand#14"]
SETS = {"a": SET_A, "b": SET_B, "c": SET_C, "d": SET_D}
PAIRS = [("Brand#5", "Brand#14"), ("Brand#12", "Brand#9")]
TAU = 6.0
DIM = 64


class Tables:
    """Lazy readers of one scale's folder and the cohort views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def subjects(self) -> DataFrame:
        orders, customer, nation = self.read("orders"), self.read("customer"), self.read("nation")
        key = F.col("o_orderkey")
        parts = [F.lit("46,XY")] + [
            F.when(key % n == 0, F.lit(text)) for n, text in ((7, "+8"), (5, "del(5q)"), (11, "t(8;21)(q22;q22)"), (13, "-7"))
        ]
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.cast("string").alias("id"),
                F.col("n_name").alias("center"),
                F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("x1"),
                (F.col("o_custkey") % 101).cast("double").alias("x2"),
                F.col("o_totalprice").alias("x3"),
                F.when(key % 17 != 0, F.concat_ws(",", *parts)).alias("karyo"),
            )
        )

    @cached_property
    def labels(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.read("orders").select(
            F.col("o_orderkey").cast("string").alias("id"),
            (F.datediff(F.col("o_orderdate"), F.lit("1994-12-31").cast("date")) / F.lit(365.25)).alias("time"),
            F.when(status == "F", 1).when(status == "O", 0).alias("event"),
            F.col("o_totalprice").alias("risk"),
            F.col("o_orderpriority").alias("grp"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return self.labels.where(F.col("event").isNotNull())

    @cached_property
    def obs(self) -> DataFrame:
        return (
            self.read("lineitem")
            .join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").cast("string").alias("id"),
                F.col("p_brand").alias("gene"),
                F.col("l_discount").alias("vaf"),
                F.col("l_linenumber").cast("string").alias("chr"),
            )
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


SQL_VIEWS = """
WITH subjects AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, n_name AS center,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x1,
         CAST(o_custkey % 101 AS DOUBLE) AS x2, o_totalprice AS x3,
         CASE WHEN o_orderkey % 17 <> 0 THEN concat_ws(',', '46,XY',
           CASE WHEN o_orderkey % 7 = 0 THEN '+8' END,
           CASE WHEN o_orderkey % 5 = 0 THEN 'del(5q)' END,
           CASE WHEN o_orderkey % 11 = 0 THEN 't(8;21)(q22;q22)' END,
           CASE WHEN o_orderkey % 13 = 0 THEN '-7' END) END AS karyo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
labels_s AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         date_diff('day', DATE '1994-12-31', CAST(o_orderdate AS DATE)) / CAST(365.25 AS DOUBLE) AS time,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS event,
         o_totalprice AS risk, o_orderpriority AS grp
  FROM orders),
labelled AS (SELECT * FROM labels_s WHERE event IS NOT NULL),
obs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, p_brand AS gene, l_discount AS vaf,
         CAST(l_linenumber AS VARCHAR) AS chr
  FROM lineitem JOIN part ON l_partkey = p_partkey),
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
"""
