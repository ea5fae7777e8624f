"""The test tables, and the views of them that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def line_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases of their orders: the price is expected, and what was got strays from it or is missing."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    got = F.when(F.col("l_quantity") < 3, F.lit(None)).when(F.col("l_quantity") > 45, F.col("l_extendedprice") * 1.001).otherwise(F.col("l_extendedprice") * (1 + 1e-7))
    return li.withColumnRenamed("l_orderkey", "task_id").withColumn("got_value", got).withColumn("expected_value", F.col("l_extendedprice"))


#: The same view in SQL.
LINE_CASES = """
line_cases AS (
  SELECT l_orderkey AS task_id, *, CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity > 45 THEN l_extendedprice * 1.001
    ELSE l_extendedprice * (1 + 1e-7) END AS got_value, l_extendedprice AS expected_value FROM lineitem),
scored AS (
  SELECT *, coalesce(abs(got_value - expected_value) <= greatest(1e-6 * greatest(abs(got_value), abs(expected_value)), 1e-9), false) AS passed
  FROM line_cases),
per AS (
  SELECT task_id, count(*) AS n_cases, count(*) FILTER (passed) AS n_passed, bool_and(passed) AS all_passed FROM scored GROUP BY task_id)
"""
