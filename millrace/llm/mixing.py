"""Mixing sources to target weights by a low-discrepancy schedule.

1. Each source gets a target number of words: the total of all sizes shared by weight, no target above `repeats` times
   its source's size, the excess reshared among the others by weight.
2. A source's stream is its documents in shuffled order, shuffled anew each time round, cut off at its target and
   divided into blocks of `block` words. The mix has 2**bits slots; slot k's point is the van der Corput
   number of k. The sources' block counts, laid end to end, divide the points, so that a source gets exactly as many
   slots as it has blocks, evenly spread; slots beyond the last source stay empty.
3. Slots are ranked per source, and the slot of rank r takes the source's block r.

Running totals and ranks are made in two levels (totals of buckets of rows, then rows within a bucket), so a source that
holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, discard, free_name, stored, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 2048
SEED = "mix"
#: Rows a bucket of a running total should hold.
BUCKET_ROWS = 2048


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight, target) of sizes(source, size); one row a source.

    Weights repeat over the sources by code point, null last. With m = repeats: the sources sorted by size / weight hit
    their cap m * size first; each other source gets weight * (what is left) / (weight left).
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    rise = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.lit(repeats) * F.col("source_size")
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("full", F.col("level") * F.col("weight") >= cap)
    )
    first_free = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)
    return per.select(
        "source", "source_size", "weight",
        F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * first_free["level"]).alias("target"),
    )


def schedule(blocks: DataFrame) -> DataFrame:
    """(slot, sid, block) of blocks(sid, n): the slots of a mix in which each source has n of them, ranked per source."""
    spark = blocks.sparkSession
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, (max(total, 1) - 1).bit_length())
    reach = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    spans = blocks.where("n > 0").withColumn("low", F.coalesce(F.sum("n").over(reach), F.lit(0)))
    # Bit-reversal of k gives its van der Corput point, in units of 2**-bits. Points lie in buckets of equal width; a
    # bucket meets the spans that overlap it, as many as there are sources at most.
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    width = max(1, 2**bits // 4096)
    slots = spark.range(2**bits).withColumnRenamed("id", "slot").withColumn("point", point).where(F.col("point") < total)
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("n") - 1) / width))))
    placed = slots.join(cells, "cell").where("point >= low and point < low + n").select("slot", "sid")
    placed = placed.withColumn("bucket", F.floor(F.col("slot") / (1 << 16)))
    counts = placed.groupBy("sid", "bucket").agg(F.count("*").alias("c"))
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("sid", "bucket").orderBy("slot")) - 1
    return placed.withColumn("r", rank).join(counts.drop("c"), ["sid", "bucket"]).select("slot", "sid", (F.col("base") + F.col("r")).alias("block"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """One row per row of docs(doc_id, source, text): doc_id, size, source_size, target, taken, first_slot.

    taken: the words that the mix takes from the row, each time round counted. first_slot: the first slot that
    holds any of it, null if none does. Null texts have size 0, and a null source is a source of its own. Rows that repeat a
    doc_id are documents of their own. Reruns agree: the order is an MD5's, then by size, and rows alike in both are alike in all.
    """
    return _mix(docs, weights, repeats, block, seed).drop("source", "row")


def _mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: str = SEED, row: str | None = None) -> DataFrame:
    """mix(), and each row's source and number: that of docs' column `row`, or one of its own."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = docs.select("doc_id", "source", number.alias("row"), F.coalesce(F.regexp_count("text", F.lit(f"({WORD})")), F.lit(0)).cast("long").alias("size"))
    sized = stored(sized, "mix-sizes")
    goal = targets(sized, weights, repeats).withColumn("words", F.round("target").cast("long"))
    goal = goal.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    goal = stored(goal.coalesce(1), "mix-targets")
    plan = schedule(goal.select("sid", F.ceil(F.col("words") / block).alias("n")))

    buckets = max(1, sized.count() // BUCKET_ROWS)
    rounds = F.when(F.col("words") > 0, F.sequence(F.lit(0), F.ceil(F.col("words") / F.col("source_size")).cast("int") - 1))
    rows = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rows = rows.withColumn("round", F.explode_outer(rounds))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("round"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    spot = ["sid", "round", "bucket"]
    totals = rows.groupBy(*spot).agg(F.sum("size").alias("t"))
    totals = totals.withColumn("base", F.coalesce(F.sum("t").over(W.partitionBy("sid").orderBy("round", "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("size").over(W.partitionBy(*spot).orderBy("key", "size", "row").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    rows = rows.withColumn("low", within).join(totals.select(*[F.col(c).alias(f"t_{c}") for c in spot], "base"), [F.col("sid") == F.col("t_sid"), F.col("round").eqNullSafe(F.col("t_round")), F.col("bucket").eqNullSafe(F.col("t_bucket"))])
    rows = rows.withColumn("low", F.col("low") + F.col("base")).withColumn("high", F.least(F.col("low") + F.col("size"), "words"))
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block)))))
    pieces = pieces.join(plan, ["sid", "block"], "left")
    part = F.when(F.col("slot").isNotNull(), F.least("high", (F.col("block") + 1) * block) - F.greatest("low", F.col("block") * block))
    done = pieces.groupBy("doc_id", "row").agg(
        F.first("source").alias("source"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.coalesce(F.sum(part), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"),
    )
    done = stored(done, "mix-done")
    discard(sized, goal)
    return done


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix's rows, with docs' columns: each row of docs once for every time round that takes a word of it, first or last.

    The document in which a source's target ends is kept whole. Rows are numbered once, in a stored copy of docs, and known by that number: repeated and missing
    doc_ids don't matter. A row without words comes once if its source's target takes in the whole source; of a source that is cut, such rows go.
    """
    row, of, times, time = (free_name(docs, c) for c in ("_row", "_of", "_times", "_time"))
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = _mix(numbered.select("doc_id", "source", "text", row), row=row, **how).where("taken > 0 or size = 0 and round(target) >= source_size")
    often = taken.select(F.col("row").alias(of), F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    rows = numbered.join(often, F.col(row) == F.col(of)).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


#: What is taken is the source's stream cut off at the target; slots follow from the blocks that it falls into.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
copies AS (SELECT *, row_number() OVER () AS row FROM sized),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
lev AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum({REPEATS} * source_size) OVER w, 0)))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM per WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, CASE WHEN level * weight >= {REPEATS} * source_size THEN CAST({REPEATS} * source_size AS DOUBLE)
    ELSE weight * (SELECT min_by(level, source_size / weight) FROM lev WHERE level * weight < {REPEATS} * source_size) END AS target
  FROM lev),
runs AS (
  SELECT c.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS words, r.round,
         sum(size) OVER (PARTITION BY c.source ORDER BY r.round,
           md5('{SEED}:' || r.round || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size, row
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high
  FROM copies c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source, range({REPEATS}) r(round)),
counts AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, CAST(ceil(CAST(round(target) AS BIGINT) / {BLOCK}) AS BIGINT) AS n FROM goal),
spans AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM counts),
digits AS (SELECT greatest(1, CAST(ceil(log2(greatest(sum(n), 1))) AS INT)) AS bits FROM counts),
slots AS (SELECT slot, CAST(list_sum(list_transform(range(0, bits), lambda i: ((slot >> i) & 1) * (1 << (bits - 1 - i)))) AS BIGINT) AS point
          FROM (SELECT bits, unnest(range(0, 1 << bits)) AS slot FROM digits) q),
ranked AS (SELECT source, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM slots JOIN spans ON point >= low AND point < low + n),
places AS (SELECT doc_id, row, min(slot) AS first_slot FROM runs r JOIN ranked k ON r.source IS NOT DISTINCT FROM k.source
           AND block BETWEEN (high - size) // {BLOCK} AND (least(high, words) - 1) // {BLOCK} WHERE least(high, words) > high - size GROUP BY doc_id, row)
SELECT r.doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(greatest(0, least(high, words) - (high - size))) AS BIGINT) AS taken, any_value(first_slot) AS first_slot
FROM runs r LEFT JOIN places p ON p.row = r.row GROUP BY r.doc_id, r.row, size
"""
