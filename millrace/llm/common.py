"""Shared helpers: table access, tables kept in the cluster's shared folder, distributed union-find."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Least and most words of 64 bits of a filter that spares texts without candidates a second look; a full one only saves less.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 17, 1 << 23
_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it until df has no such column (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only if that is unset and all runs on one machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if folder := spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored() tables that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for name in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bit_filter(df: DataFrame, number: Column, expected: int = 0) -> np.ndarray:
    """A filter that passes() lets df's numbers through, and few others while it isn't full.

    It has some 16 bits for each of `expected` numbers, and from 1 to 64 MiB.
    """
    words = FILTER_WORDS
    while words * 4 < expected and words < MOST_FILTER_WORDS:
        words *= 2
    place = F.pmod(number, F.lit(words * 64))
    marks = df.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    rows = marks.toArrow()  # `words` rows at most
    mask = np.zeros(words, np.int64)
    mask[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return mask


def passes(mask: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    p = np.mod(numbers.view(np.int64), len(mask) * 64)
    return (mask[p >> 6] >> (p & 63)) & 1 == 1


def maybe(spark: SparkSession, mask: np.ndarray) -> Callable[[Column], Column]:
    """passes() as a column function, which sends nothing but the numbers to Python."""
    shared = spark.sparkContext.broadcast(mask)

    @F.arrow_udf("boolean")
    def run(numbers: pa.Array) -> pa.Array:
        return pa.array(passes(shared.value, numbers.to_numpy()))

    return run


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find over links(a, b): (node, component), component the least node of the connected part.

    Alternates the large-star and small-star steps until the edge set stands still. Every step groups by
    a node only through an aggregate (min) and a join, so that a hub of any degree is never held in one task's memory.
    Each round's edges are a Parquet table in the shared folder. Nodes without links don't appear.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        # Large star: every node hands its larger neighbours to its least neighbour (or itself).
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node hands its smaller neighbours and itself to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, edges = edges, stored(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        discard(old)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        before = state
