"""Checks of a dataset before it is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contamination


def validate(pool: DataFrame, hidden: DataFrame, frozen: DataFrame, expected_rows: int | None = None, key: str = "latex_expression") -> DataFrame:
    """(check, ok, n_bad): keys present, no key of a held-out set, hidden truths hidden, the number of rows as in the manifest."""
    required = ("task_id", key, "test_cases")
    missing = pool.agg(F.count_if(F.array_contains(F.array(*[F.col(c).isNull() for c in required]), True)).alias("n_bad")).select(F.lit("complete").alias("check"), "n_bad")
    clash = pool.join(frozen.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_bad")).select(F.lit("uncontaminated").alias("check"), "n_bad")
    shown = hidden.agg(F.count_if(contamination.leaked()).alias("n_bad")).select(F.lit("hidden").alias("check"), "n_bad")
    twice = pool.groupBy("task_id").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_bad")).select(F.lit("unique").alias("check"), "n_bad")
    out = missing.union(clash).union(shown).union(twice)
    if expected_rows is not None:
        out = out.union(pool.agg(F.abs(F.count("*") - expected_rows).alias("n_bad")).select(F.lit("rows").alias("check"), "n_bad"))
    return out.select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad")
