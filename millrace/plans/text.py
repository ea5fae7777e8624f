"""Queries of reports and scalar functions over text and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import inputs, numbers
from millrace.functions import text as tx
from millrace.operators import reports
from millrace.plans.tables import table

PATTERNS = {"digits": "[0-9]+", "table": r"\|", "shout": "[A-Z]{4,}", "mail": "[a-z0-9]+@[a-z]+", "umlaut": "[äöüß]", "accent": "[éèê]", "license": "(?i)license", "double": "!!"}


def histogram_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes, some of them unreadable."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return reports.histogram(p.withColumn("c", F.when(F.col("p_partkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))), "c")


def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pattern_counts(table(spark, sf_dir, "documents", "text", "lang"), "text", PATTERNS, "lang")


def notation_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alignment(pattern_counts(spark, sf_dir), "lang", "en", "fr")


def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w != "")
    return reports.vocabulary(table(spark, sf_dir, "documents", "text"), words)


def reject_reason_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "event_id")
    return reports.reject_tally(e.withColumn("reason", F.concat("event_type", F.when(F.col("event_id") % 2 == 0, F.lit(" : ")).otherwise(F.lit("; ")), F.col("event_id").cast("string"), F.lit("; x"))), "reason")


def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "lang").withColumn("slice", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return reports.counts(d, "slice", "other")


def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return reports.generation_report(o.select((F.col("o_orderkey") % 10 == 0).alias("contaminated"), (F.col("o_totalprice") > 100000).alias("accepted")))


def mixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mixture_report(table(spark, sf_dir, "documents", "source"), "source", 1200)


def distinct_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "text", "lang").groupBy("lang").agg(F.countDistinct("text").alias("n_distinct"))


def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties through a map with sorted keys and back."""
    e = table(spark, sf_dir, "events", "event_id", "props")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", tx.sorted_json(F.map_concat(m, F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit("1"))))).alias("props"))


def parse_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in several ways, some of them no numbers."""
    li = table(spark, sf_dir, "lineitem", "l_extendedprice", "l_linenumber", "l_quantity", "l_returnflag")
    whole, q = F.floor("l_extendedprice").cast("string"), F.floor("l_quantity").cast("string")
    t = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" "), whole, F.lit(" "))).when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), whole, F.lit(".5e-2")))
        .when(F.col("l_linenumber") == 3, F.concat(whole, F.lit("+"), q, F.lit("j"))).when(F.col("l_linenumber") == 4, F.concat(whole, F.lit(" +-"), q, F.lit("j")))
        .when(F.col("l_linenumber") == 5, F.concat(whole, F.lit("d"))).when(F.col("l_linenumber") == 6, F.lit("-inf")).otherwise(F.concat(F.lit("n"), whole))
    )
    z = numbers.parse_number(t)
    return li.select(z["re"].alias("re"), z["im"].alias("im"), "l_returnflag").groupBy("l_returnflag").agg(
        F.count("re").alias("n_parsed"), F.count_if(F.col("re") == float("-inf")).alias("n_infinite"), F.count_if(F.col("im") != 0).alias("n_complex"),
        F.round(F.sum(F.when(F.abs("re") < 1e300, F.col("re"))), 1).alias("sum_re"), F.sum("im").alias("sum_im"),
    )


def complexity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_size")
    return p.groupBy(numbers.complexity_level(F.col("p_size")).alias("level")).agg(F.count("*").alias("n"))


def extract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title and the paragraphs of pages."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", tx.first_match(F.col("html"), "(?s)<title>(.*?)</title>").alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("n_paragraphs"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    code = F.concat(F.lit("text <execute>\nx="), F.col("n_nationkey").cast("string"), F.lit("\n</execute> <final_answer> "), F.col("n_nationkey").cast("string"), F.lit(" </final_answer>"))
    return n.select("n_nationkey", tx.build_prompt(F.col("n_name"), F.array(F.lit("x"), F.lit("y"))).alias("prompt"), tx.extract_code(code).alias("code"), tx.final_answer(code).alias("answer"), tx.safe_name(F.concat(F.lit("hf:"), F.col("n_name"), F.lit("/a b"))).alias("stem"))


def integer_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation", "n_name").select("n_name", tx.big_endian_seed(F.col("n_name")).cast("string").alias("seed"))


def jitter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and sizes moved by hashed draws; x and x_val move together."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    given = F.create_map(F.lit("x"), F.col("p_size").cast("string"), F.lit("x_val"), F.col("p_size").cast("string"))
    moved = inputs.jitter_inputs(given, "7", F.col("p_partkey"))
    u = tx.hash_uniform("9", F.col("p_partkey"))
    return p.select("p_partkey", moved["x"].cast("int").alias("x"), moved["x_val"].cast("int").alias("x_val"), F.round(F.col("p_retailprice") * (1 + (u * 0.3 - 0.15)), 4).alias("price"))


QUERIES = {f.__name__: f for f in (histogram_normalised, pattern_counts, notation_alignment, vocabulary_counts, reject_reason_tally, slice_counts, generation_summary, mixture_summary, distinct_latex, json_normalise, parse_number_text, complexity_levels, extract_blocks, prompts, integer_seeds, jitter_points)}

_PATTERNS = ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS \"{n}\"" for n, p in PATTERNS.items())
_COUNTED = f"c AS (UNPIVOT (SELECT lang, {_PATTERNS} FROM documents GROUP BY lang) ON {', '.join(f'{chr(34)}{n}{chr(34)}' for n in PATTERNS)} INTO NAME pattern VALUE n)"
ORACLES = {
    "histogram_normalised": "SELECT CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS level, count(*) AS n FROM part GROUP BY 1",
    "pattern_counts": f"WITH {_COUNTED} SELECT lang, pattern, n FROM c",
    "notation_alignment": f"""WITH {_COUNTED}, m AS (SELECT pattern FROM c WHERE lang = 'en' AND n > 0), t AS (SELECT pattern FROM c WHERE lang = 'fr' AND n > 0)
        SELECT count(*) AS n_patterns, count(t.pattern) AS n_shared, count(t.pattern) / CAST(greatest(count(*), 1) AS DOUBLE) AS ratio FROM m LEFT JOIN t USING (pattern)""",
    "vocabulary_counts": "SELECT token, count(*) AS n_rows FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> ''))) AS token FROM documents) q GROUP BY token",
    "reject_reason_tally": "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1",
    "slice_counts": "SELECT CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'other' END AS value, count(*) AS n FROM documents GROUP BY 1",
    "generation_summary": """SELECT count(*) AS generated, count(*) FILTER (o_orderkey % 10 = 0) AS contamination_dropped, count(*) FILTER (o_orderkey % 10 <> 0 AND o_totalprice > 100000) AS accepted,
        count(*) FILTER (o_orderkey % 10 <> 0 AND NOT o_totalprice > 100000) AS rejected FROM orders""",
    "mixture_summary": "SELECT source, count(*) AS n, round(100.0 * count(*) / 1200, 2)::DOUBLE AS percent FROM documents GROUP BY source",
    "distinct_latex": "SELECT lang, count(DISTINCT text) AS n_distinct FROM documents GROUP BY lang",
    "json_normalise": "SELECT event_id, '{\"a\":\"1\",\"k\":\"' || (props::JSON ->> 'k') || '\"}' AS props FROM events",
    "parse_number_text": """WITH t AS (SELECT l_returnflag, l_linenumber AS k, floor(l_extendedprice) AS w, floor(l_quantity) AS q FROM lineitem),
        z AS (SELECT l_returnflag, CASE WHEN k IN (1, 3, 4) THEN w WHEN k = 2 THEN -(w + 0.5) / 100 WHEN k = 6 THEN '-inf'::DOUBLE END AS re, CASE WHEN k = 3 THEN q WHEN k = 4 THEN -q WHEN k IN (1, 2, 6) THEN 0 END AS im FROM t)
        SELECT l_returnflag, count(re) AS n_parsed, count(*) FILTER (re = '-inf'::DOUBLE) AS n_infinite, count(*) FILTER (im <> 0) AS n_complex, round(sum(re) FILTER (abs(re) < 1e300), 1) AS sum_re, sum(im) AS sum_im FROM z GROUP BY 1""",
    "complexity_levels": "SELECT CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 6 THEN 2 WHEN p_size <= 12 THEN 3 WHEN p_size <= 20 THEN 4 ELSE 5 END AS level, count(*) AS n FROM part GROUP BY 1",
    "extract_blocks": "SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title>(.*?)</title>') THEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title, CAST(len(regexp_extract_all(html, '(?s)<p>(.*?)</p>')) AS INT) AS n_paragraphs FROM pages",
    "prompts": """SELECT n_nationkey, 'Write a Python function calculate for the expression ' || n_name || ' of x, y.' AS prompt, 'x=' || n_nationkey AS code, CAST(n_nationkey AS VARCHAR) AS answer,
        regexp_replace('hf:' || n_name || '/a b', '[^A-Za-z0-9._-]', '_', 'g') AS stem FROM nation""",
    "integer_seeds": "SELECT n_name, CAST(CAST('0x' || substr(sha256(n_name), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM nation",
    "jitter_points": """WITH u AS (SELECT *, CAST('0x' || substr(md5('7:' || p_partkey || ':x'), 1, 12) AS BIGINT) / 281474976710656.0 AS u7, CAST('0x' || substr(md5('9:' || p_partkey), 1, 12) AS BIGINT) / 281474976710656.0 AS u9 FROM part)
        SELECT p_partkey, CAST(p_size + floor(u7 * 7) - 3 AS INT) AS x, CAST(p_size + floor(u7 * 7) - 3 AS INT) AS x_val, round(p_retailprice * (1 + (u9 * 0.3 - 0.15)), 4) AS price FROM u""",
}
