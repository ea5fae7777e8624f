"""Dedup, splitting, sampling, mixing and contamination queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import hash_uniform
from millrace.operators import contamination, dedup, sampling, training_mixture
from millrace.plans.tables import table
from millrace.streaming import resume

SEED = "42"


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf_dir, "documents", "doc_id", "text", "source"), ["text"], ["doc_id"]).select("doc_id", "source")


def dedup_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return dedup.keep_first(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"])


def keyed_union_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, with those of long documents overruled."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    ruled = table(spark, sf_dir, "documents", "doc_id", "n_chars").where("n_chars > 4000").select("doc_id", F.lit(9).alias("quality"))
    return dedup.keyed_union([labels, ruled], ["doc_id"])


def variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.variant_index(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), "n_regionkey", ["n_nationkey"]).select("task_id", "n_nationkey")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return sampling.stratified_split(c, ["c_mktsegment", "c_nationkey"], "c_custkey", SEED, 300, 150, 120).select("c_custkey", "part")


def exact_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_sample(table(spark, sf_dir, "documents", "doc_id", "source"), 100, "doc_id", SEED)


def head_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 50, 100, "o_orderkey")


def mixture_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 documents: 30 % English ones, the rest from the other languages by their shares, with a share that nothing fills."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    shares = spark.createDataFrame([("fr", 0.5), ("de", 0.25), ("es", 0.125), ("none", 0.125)], "lang string, share double")
    return sampling.mixture(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), 0.3, 120, "lang", shares, "doc_id", SEED)


SLICES = [*training_mixture.SHARES, *training_mixture.GATED_SHARES, "complex", "other"]


def mixture_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third as many rows as there are orders, from the main split (every fourth order) and generated ones, without and with the gated slices."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    case = F.struct(F.create_map(F.lit("x"), F.lit("0")).alias("input"), F.floor(k / 4).cast("string").alias("output"))
    rows = o.select(k.cast("string").alias("task_id"), F.concat(F.lit("x + "), F.floor(k / 2).cast("string")).alias("latex_expression"), F.element_at(F.array(*map(F.lit, SLICES)), (k % len(SLICES)).cast("int") + 1).alias("slice"), k.alias("row_no"), F.array(case).alias("test_cases"))
    rows = rows.withColumn("gated", F.when(F.col("slice").isin(*training_mixture.GATED_SHARES), True))
    main, made, n = rows.where("row_no % 4 = 0").drop("slice", "gated"), rows.where("row_no % 4 <> 0"), o.count() // 3
    frozen = rows.select(F.concat(F.lit("y + "), "task_id").alias("latex_expression"))
    mixed = [training_mixture.training_mixture(main, made, frozen, n, SEED, gated).select(F.lit(gated).alias("include_gated"), "task_id", "slice") for gated in (False, True)]
    return mixed[0].union(mixed[1])


def _mixture_sql() -> str:
    names, gated = ", ".join(f"'{s}'" for s in SLICES), ", ".join(f"'{s}'" for s in training_mixture.GATED_SHARES)
    shares = ", ".join(f"({str(g).lower()}, '{s}', {v})" for g in (False, True) for s, v in training_mixture.slice_shares(g).items())
    return f"""WITH n AS (SELECT count(*) // 3 AS n FROM orders),
        o AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, o_orderkey AS k, o_orderkey // 2 AS latex, o_orderkey // 4 AS output, ([{names}])[o_orderkey % {len(SLICES)} + 1] AS slice FROM orders),
        a AS (SELECT task_id FROM o WHERE k % 4 = 0 ORDER BY md5('{SEED}:' || task_id), task_id LIMIT (SELECT CAST(round_even(n * {training_mixture.MAIN_SHARE}::DOUBLE, 0) AS BIGINT) FROM n)),
        w AS (SELECT n - (SELECT count(*) FROM a) AS want FROM n),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latex, output ORDER BY k) AS place FROM o WHERE k % 4 <> 0 AND latex NOT IN (SELECT latex FROM o WHERE k % 4 = 0)) q WHERE place = 1),
        c AS (SELECT g AS include_gated, task_id, slice FROM d, (VALUES (false), (true)) v(g) WHERE g OR slice NOT IN ({gated})),
        p AS (SELECT include_gated, task_id, c.slice FROM (SELECT *, row_number() OVER (PARTITION BY include_gated, slice ORDER BY md5('{SEED}:' || task_id), task_id) AS place FROM c) c
          JOIN (VALUES {shares}) s(g, slice, share) ON s.g = include_gated AND s.slice = c.slice, w WHERE place <= round_even(want * CAST(share AS DOUBLE), 0)),
        l AS (SELECT include_gated, task_id, slice, row_number() OVER (PARTITION BY include_gated ORDER BY md5('{SEED}-fill:' || task_id), task_id) AS place FROM c ANTI JOIN p USING (include_gated, task_id)),
        f AS (SELECT l.include_gated, task_id, slice FROM l, w WHERE place <= want - (SELECT count(*) FROM p WHERE p.include_gated = l.include_gated))
        SELECT g AS include_gated, task_id, NULL AS slice FROM a, (VALUES (false), (true)) v(g) UNION ALL SELECT * FROM p UNION ALL SELECT * FROM f"""


def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shard_ranges(table(spark, sf_dir, "orders", "o_orderkey"), 7, "o_orderkey")


def weighted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = sampling.weighted_choice(hash_uniform(SEED, F.col("p_partkey")), {"vieta": 0.35, "coefficient": 0.25, "discriminant": 0.2, "resultant": 0.2})
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", kind.alias("kind"))


def contamination_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination.substring_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id")


def contamination_exact_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    held = ["src0", "src1", "src2", "src3", "src4"]
    kept, dropped = contamination.split(docs.where(~F.col("source").isin(held)), contamination.frozen_keys([docs.where(F.col("source").isin(held))], "text"), "text")
    return kept.select("doc_id", F.lit("kept").alias("verdict")).union(dropped.select("doc_id", "reason"))


def leak_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose hidden truth shows: a solution, a formula or an output."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "x").alias("solution"), F.when(F.col("o_orderkey") % 50 == 0, " ").alias("sympy_exp"),
        F.array(F.struct(F.when(F.col("o_totalprice") > 400000, F.lit("1")).alias("output"))).alias("test_cases"),
    )
    return rows.where(contamination.leaked()).select("o_orderkey")


def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "props").where(contamination.complete(["k"], F.col("props"))).agg(F.count("*").alias("n_complete"))


def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "event_type")
    return resume.pending(e, e.where("event_id % 4 = 1"), "event_id")


QUERIES = {f.__name__: f for f in (dedup_keep_first, dedup_composite, keyed_union_last_wins, variant_ids, stratified_split, exact_sample_hash, head_offset, mixture_by_slice, mixture_shares, shard_ranges, weighted_kinds, contamination_substring, contamination_exact_anti, leak_filter, complete_rows, checkpoint_resume)}

_H = "md5('42:' || {0})"
ORACLES = {
    "dedup_keep_first": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) q WHERE rn = 1",
    "dedup_composite": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate) AS rn FROM lineitem) q WHERE rn = 1",
    "keyed_union_last_wins": "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 9 ELSE quality END AS quality FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 4000) d ON l.doc_id = d.doc_id",
    "variant_ids": "SELECT n_regionkey || ':v' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS task_id, n_nationkey FROM nation",
    "stratified_split": """WITH r AS (SELECT c_custkey, md5('42:' || c_custkey) AS h, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS s,
          row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5('42:' || c_custkey), c_custkey) AS rn FROM customer),
        q AS (SELECT *, s * 300 // (SELECT count(*) FROM customer) AS qt, s * 150 // (SELECT count(*) FROM customer) AS qv FROM r),
        p AS (SELECT *, CASE WHEN rn <= qt THEN 'test' WHEN rn <= qt + qv THEN 'val' ELSE 'train' END AS part FROM q),
        c AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY h, c_custkey) AS n FROM p)
        SELECT c_custkey, CASE WHEN part <> 'train' AND n > 120 THEN 'train' ELSE part END AS part FROM c""",
    "exact_sample_hash": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "head_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "mixture_by_slice": """WITH a AS (SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY md5('42:' || doc_id), doc_id LIMIT 36),
        s AS (SELECT * FROM (VALUES ('fr', 0.5), ('de', 0.25), ('es', 0.125), ('none', 0.125)) t(lang, share)),
        r AS (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || doc_id), doc_id) AS rn, round_even(84 * share, 0) AS take
              FROM documents d JOIN s ON s.lang = d.lang WHERE d.lang <> 'en'),
        p AS (SELECT doc_id, lang FROM r WHERE rn <= take),
        f AS (SELECT doc_id, lang FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM p)
              ORDER BY md5('42-fill:' || doc_id), doc_id LIMIT (SELECT 84 - count(*) FROM p))
        SELECT * FROM a UNION ALL SELECT * FROM p UNION ALL SELECT * FROM f""",
    "mixture_shares": _mixture_sql(),
    "shard_ranges": "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INT) AS worker FROM orders",
    "weighted_kinds": """SELECT p_partkey, CASE WHEN u < 0.35 THEN 'vieta' WHEN u < 0.6 THEN 'coefficient' WHEN u < 0.8 THEN 'discriminant' ELSE 'resultant' END AS kind
        FROM (SELECT p_partkey, CAST('0x' || substr(md5('42:' || p_partkey), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM part) q""",
    "contamination_substring": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "contamination_exact_anti": """SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4')) THEN 'contaminated' ELSE 'kept' END AS verdict
        FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4')""",
    "leak_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000",
    "complete_rows": "SELECT count(*) AS n_complete FROM events WHERE list_contains(json_keys(props), 'k')",
    "checkpoint_resume": "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 1",
}
