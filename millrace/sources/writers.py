"""Writers. All go through Spark's commit protocol, so that a killed job leaves no half-written table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import format_output, parse_number, repair_legacy
from millrace.functions.text import sorted_json


def jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One object a line, its keys in order. With an order, files follow each other in it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode("overwrite").json(path)


def json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """A table small enough for one file as a JSON array, a row a line. Rows stream through one task; nothing is collected."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row waits, as it takes no comma
        yield pd.DataFrame({"value": ["["]})
        for f in frames:
            if len(f := f.dropna(subset=["value"])):
                rows = ([held] if held is not None else []) + f["value"].tolist()
                held = rows.pop()
                yield pd.DataFrame({"value": pd.Series([f"{r}," for r in rows], dtype=object)})
        yield pd.DataFrame({"value": ([held] if held is not None else []) + ["]"]})

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"), *[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)])
    rows = rows.union(df.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))  # so that an empty table has a task too
    rows.repartition(1).sortWithinPartitions(*[f"_o{k}" for k in range(len(order))]).select("value").mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def run_stamp() -> Column:
    """The time of the query, as it stands in reports' names."""
    return F.date_format(F.now(), "yyyyMMdd-HHmmss")


def report(df: DataFrame, folder: str, name: str) -> str:
    """A report of one row, with its time stamp, as <folder>/<name>_<stamp>. Returns the path."""
    stamp = df.sparkSession.range(1).select(run_stamp()).first()[0]
    path = f"{folder}/{re.sub('[^A-Za-z0-9._-]', '_', name)}_{stamp}"
    df.limit(1).withColumn("timestamp", F.lit(stamp)).coalesce(1).write.mode("overwrite").json(path)
    return path


def predictions(df: DataFrame, path: str) -> None:
    """id,outputs from (task_id, outputs array): nulls stay in the JSON list."""
    df.select(F.col("task_id").alias("id"), F.to_json("outputs", {"ignoreNullFields": "false"}).alias("outputs")).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def code(df: DataFrame, path: str) -> None:
    df.select(F.col("task_id").alias("id"), "code").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def ids(df: DataFrame, path: str, key: str = "task_id") -> None:
    df.select(F.col(key).cast("string")).orderBy(key).write.mode("overwrite").text(path)


#: A row as it is published.
PUBLISHED = ("task_id", "latex_expression", "solution", "sympy_exp", "truth_code", "test_cases", "domain", "equation_type", "complexity", "output_type", "synthetic", "metadata")


def publishable(df: DataFrame) -> DataFrame:
    """Rows of one uniform shape: no null formulas, outputs in canonical form, inputs and metadata as JSON with sorted keys.

    Doubled signs of an old format are mended. An output that is no number even then stops the job.
    """
    held = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PUBLISHED])

    def canonical(text: Column) -> Column:
        z = parse_number(repair_legacy(text))
        return F.when(text.isNotNull(), F.when(z.isNull(), F.raise_error(F.concat(F.lit("output that is no number: "), text))).otherwise(format_output(z["re"], z["im"])))

    cases = F.transform("test_cases", lambda c: F.struct(F.coalesce(sorted_json(c["input"]), F.lit("{}")).alias("input"), canonical(c["output"]).alias("output")))
    meta = F.coalesce(sorted_json(F.from_json("metadata", "map<string,string>")), F.lit("{}"))
    return held.withColumn("test_cases", cases).withColumns({c: F.coalesce(c, F.lit("")) for c in ("sympy_exp", "truth_code")}).withColumn("metadata", meta)


def stage(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table, made publishable, as JSONL under a folder of its own, replacing what was there. Returns (name, n_rows)."""
    for name, df in tables.items():
        jsonl(publishable(df), f"{folder}/data/{name}", ["task_id"])
    spark = next(iter(tables.values())).sparkSession
    counts = [spark.read.text(f"{folder}/data/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in tables]
    return reduce(DataFrame.union, counts).orderBy("name")


def manifest(spark: SparkSession, pattern: str) -> dict[str, str]:
    """file -> SHA-256 of a glob of files; a row a file comes to the driver."""
    files = spark.read.format("binaryFile").load(pattern)
    return {r[0].rsplit("/", 1)[-1]: r[1] for r in files.select("path", F.sha2("content", 256)).orderBy("path").toLocalIterator()}
