"""Readers. Every JSON reader takes an explicit schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import CODE, PREDICTION, PROBLEM


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def with_row_number(df: DataFrame) -> DataFrame:
    """row_no in file order. The order within a file is that of the reader's rows, across files that of their names."""
    return df.withColumn("row_no", F.monotonically_increasing_id())


def normalise(df: DataFrame) -> DataFrame:
    """Rows as they are used: a domain of NaN is null, an output type that is missing is 'unknown'."""
    return df.withColumn("domain", F.when(F.lower("domain") != "nan", F.col("domain"))).withColumn("output_type", F.coalesce("output_type", F.lit("unknown")))


#: Keys that have columns of their own outside `metadata`.
OWN_KEYS = ("task_id", "latex_expression", "solution", "sympy_exp", "test_cases")


def with_metadata(spark: SparkSession, path: str, schema: T.StructType = PROBLEM) -> DataFrame:
    """JSONL rows whose `metadata` holds all keys but OWN_KEYS, as JSON with sorted keys; values keep their JSON form."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row, keys = F.from_json("value", schema), F.array_sort(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, OWN_KEYS))))
    # A JSON text per value: strings as they stand in the line, in quotes; the rest as it is.
    every = F.from_json("value", "map<string,variant>")
    pair = lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.coalesce(F.to_json(every[k]), F.lit("null")))
    meta = F.concat(F.lit("{"), F.array_join(F.transform(keys, pair), ","), F.lit("}"))
    return with_row_number(normalise(lines.select(row.alias("r"), meta.alias("m")).select("r.*", "m").withColumn("metadata", F.col("m")).drop("m")))


def _unzipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first JSON file of each archive."""
    for df in frames:
        texts = []
        for content in df["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                texts.append(z.read(next(n for n in z.namelist() if n.endswith(".json"))).decode())
        yield pd.DataFrame({"value": texts})


def problems(spark: SparkSession, path: str, schema: T.StructType = PROBLEM, missing_ok: bool = False) -> DataFrame:
    """Problems from .jsonl (a row a line, blank lines skipped), .zip of one JSON array, or a JSON array or {"items": [..]}.

    A file that is missing is an error, or an empty table if missing_ok.
    """
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("row_no", T.LongType())]))
        raise FileNotFoundError(path)
    if path.endswith(".jsonl"):
        return with_row_number(normalise(spark.read.schema(schema).json(path)))
    if path.endswith(".zip"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzipped, "value string")
        return with_row_number(normalise(rows.select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r")).select("r.*")))
    both = T.StructType([*schema.fields, T.StructField("items", T.ArrayType(schema))])
    df = spark.read.schema(both).option("multiLine", True).json(path)
    rows = df.where("items is null").drop("items").unionByName(df.where("items is not null").select(F.explode("items").alias("r")).select("r.*"))
    return with_row_number(normalise(rows))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, outputs array<string>) of a CSV id,outputs: a scalar is an array of one, unreadable JSON an array of one null."""
    df = spark.read.schema(PREDICTION).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    array = F.from_json("outputs", T.ArrayType(T.StringType()))
    scalar = F.trim("outputs").rlike(r'^(?:"[^"]*"|[+-]?[0-9.][0-9.eE+-]*|true|false)$')
    outputs = F.when(F.trim("outputs").startswith("["), F.coalesce(array, F.array(F.lit(None).cast("string")))).when(scalar, F.array(F.trim("outputs", F.lit('" ')))).otherwise(F.array(F.lit(None).cast("string")))
    return df.select(F.trim("id").alias("task_id"), outputs.alias("outputs"))


def code_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODE).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).select(F.col("id").alias("task_id"), "code")


def last_match(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """One row: the pattern's group in the last matching line of a log."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    return lines.where(F.col("value").rlike(pattern)).agg(F.max_by(F.regexp_extract("value", pattern, group), "n").alias("found"))


def pools(spark: SparkSession, pattern: str, exclude: str = "train_mixture", schema: T.StructType = PROBLEM) -> DataFrame:
    """All JSONL files of a glob but those whose name starts with `exclude`, with their file."""
    df = spark.read.schema(schema).json(pattern).withColumn("file", F.input_file_name())
    return df.where(~F.regexp_extract("file", r"([^/]+)$", 1).startswith(exclude))


def records(spark: SparkSession, path: str, separator: str = "=====", inner: str = "Python Solution:") -> DataFrame:
    """(problem, solution) of a delimited text file; records that don't have exactly two parts are left out."""
    parts = spark.read.text(path, lineSep=separator).select(F.split("value", inner).alias("p")).where(F.size("p") == 2)
    return parts.select(F.trim(F.col("p")[0], F.lit(" \t\n\r")).alias("problem"), F.trim(F.col("p")[1], F.lit(" \t\n\r")).alias("solution"))
