"""Incremental verification: what arrives is verified once, and a run that was cut off goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that an earlier report doesn't hold."""
    return rows.join(done.select(key), key, "left_anti")


#: Parts of the target, by a hash of the key.
PARTS = 64


def part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def verify_stream(spark: SparkSession, source: str, schema: T.StructType, verify: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "task_id", everything: bool = False):
    """A query over arriving JSONL that appends verify(rows) to the Parquet table `target`, each key once.

    The target is partitioned by a hash of the key, column `_part`, and a batch looks for its keys in the partitions that it touches. A batch that is run again after a
    failure leaves out the keys that it had written, and rows that repeat a key of an earlier batch are passed over. With `everything` the query ends when what is
    there now is done; else start it with .processAllAvailable().
    """
    empty = verify(spark.createDataFrame([], schema)).withColumn("_part", F.lit(0))
    columns = T.StructType(empty.schema.fields)
    try:
        spark.read.schema(columns).parquet(target)
    except AnalysisException:  # the first start: the table is there before the first batch looks for keys in it
        empty.write.partitionBy("_part").parquet(target)

    def batch(df: DataFrame, _: int) -> None:
        df = df.dropDuplicates([key]).withColumn("_part", part(key)).persist()
        touched = [r[0] for r in df.select("_part").distinct().collect()]  # PARTS at most
        if touched:
            done = spark.read.schema(columns).parquet(target).where(F.col("_part").isin(touched))
            verify(pending(df, done, key).drop("_part")).withColumn("_part", part(key)).write.mode("append").partitionBy("_part").parquet(target)
        df.unpersist()

    writer = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if everything else writer).start()
