"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, documents with benchmark passages go, sources are
mixed to their weights, and each row gets its shard. Each stage's result is a Parquet table that the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, jaccard, mixing, sharding, toxicity
from millrace.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the chain calls toxic. Null and empty texts are scored as empty ones, and stay unless the model calls those toxic; rows alike share
    their fate; without labels of both kinds nothing goes. Texts of any length are scored whole.
    """
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near duplicates, the row of the least doc_id; rows are known by doc_id and text, and of copies in both the first by a hash of
    the row stays. Rows without doc_id and texts without words have no links and stay. Texts of any length are compared whole.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item. Null and empty texts hold none, empty items are held by none; rows alike share their fate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times. A null source is one of its own; a row without words stays once where its source is taken
    whole; repeated and missing doc_ids don't matter.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the shard that their doc_id maps to; rows that share one, or have none, share a shard. A column `shard` is replaced."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
