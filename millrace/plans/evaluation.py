"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import close
from millrace.operators import bootstrap, scoring
from millrace.plans.tables import LINE_CASES, line_cases, table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = line_cases(spark, sf_dir)
    return cases.withColumn("passed", F.coalesce(close(F.col("got_value"), F.col("expected_value")), F.lit(False)))


def score_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case and problem accuracy over all line items."""
    return scoring.summary(scoring.per_problem(_scored(spark, sf_dir)))


def problem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_problem(_scored(spark, sf_dir))


def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scoring.per_problem(_scored(spark, sf_dir))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "task_id")
    return scoring.by_group(per.join(orders, "task_id"), "o_orderpriority")


def accuracy_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scoring.per_problem(_scored(spark, sf_dir))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderkey", "task_id")
    return scoring.by_group(per.join(orders, "task_id"), "o_orderstatus", {"closed": ["F", "P"]}).select("grp", "n_problems", "problems_passed")


def failures_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumnRenamed("passed", "all_passed")
    return scoring.failure_counts(rows, ["l_returnflag", "l_linestatus"])


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    problems = orders.select(F.col("o_orderkey").cast("string").alias("task_id"), F.array(F.struct(F.lit(None).cast("map<string,string>").alias("input"), F.floor("o_totalprice").cast("string").alias("output")), F.struct(F.lit(None).cast("map<string,string>").alias("input"), F.lit("1").alias("output"))).alias("test_cases"))
    made = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("task_id"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.floor("o_totalprice").cast("string"))).otherwise(F.array(F.floor("o_totalprice").cast("string"), F.lit("1.0000000001"))).alias("outputs"))
    return problems, made


def score_inner_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems without predictions leave the count; short outputs fail."""
    return scoring.summary(scoring.per_problem(scoring.score_cases(scoring.align(*_predictions(spark, sf_dir)))))


def score_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems without predictions fail."""
    return scoring.summary(scoring.per_problem(scoring.score_cases(scoring.align(*_predictions(spark, sf_dir), "fail"))))


def unmatched_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "task_id")
    return scoring.unmatched(o, table(spark, sf_dir, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "task_id")).agg(F.count("*").alias("n_unmatched"))


def first_failures_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus", "expected_value"]
    scored = _scored(spark, sf_dir).withColumn("got", F.col("got_value")).withColumn("expected", F.col("expected_value"))
    top = scoring.first_failures(scored, order)
    return top.select("task_id", F.round("first_failure.expected", 4).alias("first_expected"), F.size("failures").alias("n_shown"), F.round(F.aggregate("failures", F.lit(0.0), lambda s, x: s + x["expected"]), 3).alias("sum_expected"))


def legacy_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return scoring.legacy_accuracy(c.select(F.floor("c_acctbal").cast("string").alias("got"), F.when(F.col("c_custkey") % 4 == 0, F.lit("0.5")).otherwise(F.floor("c_acctbal").cast("string")).alias("expected")))


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the share of good labels."""
    return bootstrap.bootstrap_ci(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("all_passed")))


QUERIES = {f.__name__: f for f in (score_two_level, problem_scores, accuracy_by_group, accuracy_folded, failures_grouping_sets, score_inner_missing, score_left_default, unmatched_predictions, first_failures_topk, legacy_accuracy, bootstrap_interval)}

_SUMMARY = """count(*) AS n_problems, CAST(sum(n_cases) AS BIGINT) AS n_cases, count(*) FILTER (all_passed) AS problems_passed, CAST(sum(n_passed) AS BIGINT) AS cases_passed,
  count(*) FILTER (all_passed) / CAST(count(*) AS DOUBLE) AS problem_accuracy, sum(n_passed) / CAST(sum(n_cases) AS DOUBLE) AS case_accuracy"""
_ALIGNED = """
WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS n FROM orders),
per AS (SELECT k AS task_id, 2 AS n_cases, n AS n_passed, n = 2 AS all_passed FROM p {where})
SELECT """ + _SUMMARY + " FROM per"
ORACLES = {
    "score_two_level": f"WITH {LINE_CASES} SELECT {_SUMMARY} FROM per",
    "problem_scores": f"WITH {LINE_CASES} SELECT * FROM per",
    "accuracy_by_group": f"WITH {LINE_CASES} SELECT o_orderpriority AS grp, {_SUMMARY} FROM per JOIN orders ON o_orderkey = task_id GROUP BY 1",
    "accuracy_folded": f"WITH {LINE_CASES} SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE o_orderstatus END AS grp, count(*) AS n_problems, count(*) FILTER (all_passed) AS problems_passed FROM per JOIN orders ON o_orderkey = task_id GROUP BY 1",
    "failures_grouping_sets": f"""WITH {LINE_CASES} SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS dimension,
        coalesce(l_returnflag, l_linestatus) AS value, count(*) AS failures FROM scored WHERE NOT passed GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""",
    "score_inner_missing": _ALIGNED.format(where="WHERE k % 3 <> 0"),
    "score_left_default": _ALIGNED.format(where=""),
    "unmatched_predictions": "SELECT count(*) AS n_unmatched FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "first_failures_topk": f"""WITH {LINE_CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus, expected_value) AS rn FROM scored WHERE NOT passed)
        SELECT task_id, round(min(CASE WHEN rn = 1 THEN expected_value END), 4) AS first_expected, CAST(count(*) AS INT) AS n_shown, round(sum(expected_value), 3) AS sum_expected FROM r WHERE rn <= 3 GROUP BY task_id""",
    "legacy_accuracy": "SELECT count(*) FILTER (c_custkey % 4 <> 0) / CAST(count(*) AS DOUBLE) AS accuracy FROM customer",
}
