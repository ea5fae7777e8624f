"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size: offset + j * skip. The shards take
turns, and each turn claims the shard's first slot that is still free, until the table is full. A document's
slot is a hash of its key modulo the table's size, so placing it is one lookup, the shards differ by one slot
at most, and a shard that leaves moves few documents beside its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import free_name, table

SHARDS = 16
SLOTS = 2053


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    """The first 60 bits of a text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """slot -> index of the shard that claimed it. Its size is `slots`, whatever the data."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be prime and no less than the number of shards, whose names must differ")
    offset = [_number(f"{s}:offset") % slots for s in shards]
    skip = [_number(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    owner, at = [-1] * slots, [0] * len(shards)
    for turn in range(slots):
        i = turn % len(shards)
        while owner[slot := (offset[i] + at[i] * skip[i]) % slots] >= 0:
            at[i] += 1
        owner[slot] = i
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A null key has the slot of the text 'null'."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS, into: str = "shard") -> DataFrame:
    """docs with one more column, `into` (int): the index of the shard of each row's key.

    Rows with equal keys share a shard; null keys share one too. An existing column of that name is replaced. The
    broadcast table has `slots` rows, a bound that doesn't depend on the data, so there is no shuffle and no skew.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    spark = docs.sparkSession
    slot, owner = free_name(docs, "_slot"), free_name(docs, "_shard")
    owners = spark.createDataFrame(list(enumerate(lookup_table(names, slots))), f"`{slot}` int, `{owner}` int")
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    placed = docs.withColumn(slot, slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(owners), slot, "left")
    return placed.select(*[F.col(f"`{c}`") for c in kept], F.col(owner).alias(into))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id"))


#: The same by recursion: one row a turn, carrying the slots taken so far.
ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT s, CAST('0x' || substr(md5('shard-' || s || ':offset'), 1, 15) AS BIGINT) % {SLOTS} AS o,
         CAST('0x' || substr(md5('shard-' || s || ':skip'), 1, 15) AS BIGINT) % {SLOTS - 1} + 1 AS k
  FROM range({SHARDS}) r(s)),
orders AS (SELECT s, list((o + j * k) % {SLOTS} ORDER BY j) AS slots FROM pref, range({SLOTS}) t(j) GROUP BY s),
turns(t, slot, used) AS (
  SELECT 0, (SELECT slots[1] FROM orders WHERE s = 0), [(SELECT slots[1] FROM orders WHERE s = 0)]
  UNION ALL
  SELECT t + 1, n, list_append(used, n) FROM (
    SELECT t, used, list_filter(o.slots, lambda x: NOT list_contains(used, x))[1] AS n
    FROM turns JOIN orders o ON o.s = (t + 1) % {SHARDS}) q WHERE t + 1 < {SLOTS}),
owner AS (SELECT slot, t % {SHARDS} AS shard FROM turns)
SELECT doc_id, CAST(shard AS INT) AS shard FROM documents d JOIN owner ON
  owner.slot = CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {SLOTS}
"""
