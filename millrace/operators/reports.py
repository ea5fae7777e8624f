"""Counts and tallies of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import complexity_number
from millrace.functions.text import tally_key


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(level, n) of a column taken as whole numbers, others as 0."""
    return df.groupBy(complexity_number(F.col(column).cast("string")).alias("level")).agg(F.count("*").alias("n")).orderBy("level")


def counts(df: DataFrame, column: str, missing: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def pattern_counts(df: DataFrame, text: str, patterns: dict[str, str], *groups: str) -> DataFrame:
    """(groups.., pattern, n): how many rows have each pattern, in one pass and one aggregate for all patterns."""
    sums = df.groupBy(*groups).agg(*[F.count_if(F.col(text).rlike(p)).alias(name) for name, p in patterns.items()])
    return sums.unpivot(list(groups), list(patterns), "pattern", "n")


def alignment(counted: DataFrame, group: str, one: str, other: str) -> DataFrame:
    """The share of the patterns found in group `one` that are found in `other` too."""
    mine = counted.where((F.col(group) == one) & (F.col("n") > 0)).select("pattern")
    theirs = counted.where((F.col(group) == other) & (F.col("n") > 0)).select("pattern", F.lit(1).alias("_hit"))
    both = mine.join(theirs, "pattern", "left").agg(F.count("*").alias("n_patterns"), F.count("_hit").alias("n_shared"))
    return both.withColumn("ratio", F.col("n_shared") / F.greatest("n_patterns", F.lit(1)))


def vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n_rows): in how many rows each token stands."""
    return df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("n_rows"))


def reject_tally(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(tally_key(F.col(reason)).alias("reason")).agg(F.count("*").alias("n"))


def percentage(part: Column, of: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.greatest(of, F.lit(1)), 2)


def generation_report(df: DataFrame) -> DataFrame:
    """One row from rows with `contaminated`, `accepted`."""
    return df.agg(
        F.count("*").alias("generated"), F.count_if("contaminated").alias("contamination_dropped"),
        F.count_if(~F.col("contaminated") & F.col("accepted")).alias("accepted"), F.count_if(~F.col("contaminated") & ~F.col("accepted")).alias("rejected"),
    )


def mixture_report(df: DataFrame, source: str, requested: int) -> DataFrame:
    """(source, n, percent of the requested size)."""
    return df.groupBy(source).agg(F.count("*").alias("n"), percentage(F.count("*"), F.lit(requested)).alias("percent"))


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
