"""Families of generated problems that a user writes: Python table functions, called by lateral join, which state their own columns.

A family is an object with `columns(seed)`, the schema of its rows, and `rows(i, seed)`, which yields the rows of key i as tuples. It is asked for its columns when a query is
planned, so that a family may choose them by the seed or by what it was made with; rows are made where the keys lie, key by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class UserFamily(Protocol):
    def columns(self, seed: str) -> T.StructType: ...

    def rows(self, i: int, seed: str) -> Iterator[tuple]: ...


def function_name(name: str) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"{name!r} is no name for a family")
    return f"user_family_{name}"


def register(spark: SparkSession, name: str, family: UserFamily) -> None:
    """Makes `family` known as the table function user_family_<name>(i, seed); a name that is there already is replaced."""

    class Rows:
        @staticmethod
        def analyze(i: AnalyzeArgument, seed: AnalyzeArgument) -> AnalyzeResult:
            if seed.value is None:
                raise ValueError("the seed must be a constant")
            return AnalyzeResult(family.columns(seed.value))

        def eval(self, i: int, seed: str) -> Iterator[tuple]:
            if i is not None:
                yield from family.rows(i, seed)

    spark.udtf.register(function_name(name), udtf(Rows))


def generate(keys: DataFrame, name: str, seed: str = "0") -> DataFrame:
    """keys(i) with the rows of a registered family: one row per row that the family yields for a key; null keys give none."""
    call = f"SELECT k.i, f.* FROM {{keys}} k, LATERAL {function_name(name)}(k.i, '{seed.replace(chr(39), '')}') f"
    return keys.sparkSession.sql(call, keys=keys.select(keys["i"].cast("long").alias("i")))
