"""Keep-first dedup and keyed unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key. order must be total among rows of a key (dropDuplicates promises no order).

    min_by over a struct is an aggregate with partial results before the shuffle, so a key that holds most rows sends
    one row a task, where a window would sort them all in one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = df.groupBy(*[(F.col(f"`{k}`") if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def outputs_key(cases: str = "test_cases") -> Column:
    """A key of all outputs of a row's cases."""
    return F.to_json(F.transform(F.col(cases), lambda c: c["output"]))


def keyed_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows by key, later parts winning over earlier ones."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, "_part").alias("_row")).select("_row.*").drop("_part")


def bag_union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def variant_index(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with task ids '<group>:v<place in the group>'."""
    return df.withColumn("task_id", F.concat(F.col(group).cast("string"), F.lit(":v"), F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1))
