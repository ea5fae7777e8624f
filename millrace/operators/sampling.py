"""Deterministic sampling, splitting, sharding and mixing.

The order is an MD5 of seed and key, so results don't depend on how rows are dealt out and are the same in other engines.
Never rand(): it changes with the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import hash_order


def ordered(df: DataFrame, key: str, seed: str) -> DataFrame:
    return df.withColumn("_h", hash_order(seed, F.col(key)))


def ranked(df: DataFrame, groups: list[str], key: str, into: str = "_r") -> DataFrame:
    """df (with ordered()'s _h) with each row's place in its group by _h, key: counts of 4,096 hash ranges, then places within a range.

    So no task sorts a whole group.
    """
    df = df.withColumn("_b", F.substring("_h", 1, 3))
    sizes = df.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_of"), F.coalesce(before, F.lit(0)).alias("_base"))
    place = df.withColumn("_in", F.row_number().over(W.partitionBy(*groups, "_b").orderBy("_h", key)))
    on = [F.col("_b") == F.col("_of"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]]
    return place.join(sizes, on).withColumn(into, F.col("_base") + F.col("_in")).drop("_b", "_in", "_of", "_base", *[f"_g{i}" for i in range(len(groups))])


def exact_sample(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """Exactly min(n, rows) rows. A top-n: each task keeps n rows."""
    return ordered(df, key, seed).orderBy("_h", key).limit(n).drop("_h")


def head(df: DataFrame, limit: int | None, skip: int = 0, order: str = "row_no") -> DataFrame:
    """Rows [skip, skip + limit) in file order; limit 0 or None means all."""
    out = df.orderBy(order).offset(skip) if skip else df.orderBy(order) if limit else df
    return out.limit(limit) if limit else out


def proportional(df: DataFrame, group: str, shares: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """round(n * share) rows of each group (half to even), or all it has. shares(group, share); groups without one give none."""
    take = shares.select(F.col(group), F.bround(F.lit(n) * F.col("share")).cast("long").alias("_take"))
    held = ordered(df, key, seed).join(take, group)
    return ranked(held, [group], key).where("_r <= _take").drop("_h", "_r", "_take")


def fill_up(picked: DataFrame, pool: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """picked, and rows of pool that it lacks, up to n in all."""
    rest = exact_sample(pool.join(picked.select(key), key, "left_anti"), n, key, seed)
    both = picked.withColumn("_late", F.lit(0)).unionByName(rest.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return ordered(both, key, seed).orderBy("_late", "_h", key).limit(n).drop("_late", "_h")


def stratified_split(df: DataFrame, strata: list[str], key: str, seed: str, test: int, val: int, cap: int | None = None) -> DataFrame:
    """df with `part`: 'test', 'val' or 'train'.

    Each stratum gives size * test // total rows to test, and likewise to val, in hash order; cap trims both parts.
    Strata's sizes come from an aggregate, places within a stratum from ranked().
    """
    total = df.count()
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    on = [df[s].eqNullSafe(sizes[s]) for s in strata]
    full = ordered(df.join(sizes, on).select(df["*"], "_size"), key, seed)
    full = ranked(full, strata, key)
    quota = lambda want: F.expr(f"_size * {want} div {max(1, total)}")
    part = F.when(F.col("_r") <= quota(test), "test").when(F.col("_r") <= quota(test) + quota(val), "val").otherwise("train")
    full = full.withColumn("part", part)
    if cap is not None:
        held = ranked(full.where("part <> 'train'"), ["part"], key, "_n")
        back = held.withColumn("part", F.when(F.col("_n") > cap, "train").otherwise(F.col("part"))).drop("_n")
        full = back.unionByName(full.where("part = 'train'"))
    return full.drop("_size", "_h", "_r")


def shard_ranges(df: DataFrame, workers: int, order: str) -> DataFrame:
    """df with `worker`: contiguous shares of the order, the first ones larger by one where it doesn't come out even.

    Places come from counts of ranges of rows and ranks within a range, not from one window over all rows.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    placed = ranged.join(F.broadcast(before), "_p")  # one row a partition
    i = F.col("_b") + F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    big, size = F.expr(f"_all % {workers}"), F.expr(f"_all div {workers}")
    worker = F.when(i < big * (size + 1), F.floor(i / (size + 1))).otherwise(big + F.floor(F.try_divide(i - big * (size + 1), size)))
    return placed.withColumn("worker", (worker + 1).cast("int")).drop("_p", "_b", "_all")


def weighted_choice(key_uniform, weights: dict[str, float]):
    """A label by cumulative weights from a uniform column."""
    total, low, out = sum(weights.values()), 0.0, None
    for label, w in weights.items():
        low += w
        hit = key_uniform < low / total
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(label))


def mixture(main: DataFrame, pool: DataFrame, share: float, n: int, group: str, shares: DataFrame, key: str, seed: str) -> DataFrame:
    """share of n rows from main, the rest from pool by the groups' shares, filled up from what the pool has left; in hash order."""
    a = exact_sample(main, round(n * share), key, seed)
    want = n - round(n * share)
    b = fill_up(proportional(pool, group, shares, want, key, seed), pool, want, key, f"{seed}-fill")
    return ordered(a.unionByName(b, allowMissingColumns=True), key, f"{seed}-order").orderBy("_h", key).drop("_h")
