"""Queries that run code: sandbox, verification, rewards. SQL can't express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import outputs_match
from millrace.operators import contamination, generators, models, publishing, sandbox, scoring, verify
from millrace.plans import generation
from millrace.plans.tables import table
from millrace.sources import shared
from millrace.streaming import resume

GOOD = "def calculate(x_val, y=1.0):\n    return x_val ** 2 + y\n"
BAD = "def calculate(x_val, y=1.0):\n    return x_val ** 2 - y\n"
#: Wrong by half or more at every whole number, so that no tolerance hides it at large ones.
WRONG = "def calculate(x_val, y=1.0):\n    return 2 * x_val ** 2 - y\n"
UNSAFE = "import os\ndef calculate(x_val):\n    return os.getpid()\n"
FAILS = "def calculate(x_val):\n    return x_val / 0\n"
LONG = "def calculate(x_val, y=1.0):\n    return x_val ** 2 + y + 0 - 0 + 0\n"


def _problems(spark: SparkSession, sf_dir: str, bad: str = WRONG) -> DataFrame:
    """A problem a supplier: two cases of x^2 + 1, with good, wrong, unsafe, failing and empty solutions.

    The truth is code, an expression or both; it is missing, unreadable or nowhere defined for some.
    """
    k = F.col("k")
    s = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").cast("long").alias("k"))
    case = lambda v: F.struct(F.create_map(F.lit("x"), v.cast("string")).alias("input"), F.concat((v * v + 1).cast("string"), F.lit(".0")).alias("output"))
    code = F.when(k % 7 == 6, UNSAFE).when(k % 5 == 4, bad).when(k % 11 == 7, FAILS).when(k % 17 == 3, "").otherwise(GOOD)
    none = (k % 13).isin(5, 6, 8)
    truth = F.when(none | (k % 3 == 1), "").when(k % 19 == 2, FAILS).otherwise(GOOD)
    exp = F.when(k % 13 == 5, "").when(k % 13 == 6, "x +* 2").when(k % 13 == 8, "log(x - x)").when(k % 3 == 0, "").otherwise("x**2 + 1")
    return s.select("k", k.cast("string").alias("task_id"), code.alias("code"), code.alias("solution"), truth.alias("truth_code"), exp.alias("sympy_exp"), F.array(case(k), case(k + 1)).alias("test_cases"))


def sandbox_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sandbox.run_solutions(_problems(spark, sf_dir, BAD))


def oracle_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.oracle_verify(_problems(spark, sf_dir), n=3)


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.curate(_problems(spark, sf_dir).drop("code"), n=2).select("task_id", "accepted", "reason")


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three trajectories a task, good and bad ones side by side: one block; two blocks, of which the last counts; a final answer only; a longer block under a trace."""
    p, k = _problems(spark, sf_dir).withColumn("solution", F.lit(GOOD)), F.col("k")
    block = lambda c: F.concat(F.lit("try <execute>\n"), c, F.lit("</execute>"))
    answer = F.concat(F.lit("so <final_answer>"), F.when(k % 8 == 2, k * k + 1).otherwise(2 * k * k).cast("string"), F.lit("</final_answer>"))
    said = F.when(k % 4 == 0, block(F.col("code"))).when(k % 4 == 1, F.concat(block(F.lit(WRONG)), block(F.col("code")))).when(k % 4 == 2, answer)
    t = p.select(F.when(k % 23 == 9, "nobody").otherwise(F.col("task_id")).alias("task_id"), said.alias("trajectory"), "code")
    t = t.select("task_id", F.coalesce("trajectory", F.concat(F.lit("Traceback: "), block(F.lit(LONG)))).alias("trajectory"))
    more = [p.where(k % m == 0).select("task_id", block(F.lit(c)).alias("trajectory")) for m, c in ((1, GOOD), (2, WRONG))]
    return verify.rewards(t.union(more[0]).union(more[1]), p.drop("code", "k"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as problems: size^2 + 3 size, with some expressions missing, unreadable or undefined."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    exp = F.when(k % 11 == 0, "").when(k % 11 == 1, "x +* 2").when(k % 11 == 2, "log(x - x)").when(k % 11 == 3, "x**2 + 2*x").otherwise("x^2 + 3*x + sin(0)*sqrt(-x)")
    case = F.struct(F.create_map(F.lit("x_val"), s.cast("string")).alias("input"), (s * s + 3 * s).cast("string").alias("output"))
    floor = F.struct(F.create_map(F.lit("x_val"), s.cast("string")).alias("input"), (k % 3).cast("string").alias("output"))
    return p.select(k.cast("string").alias("task_id"), exp.alias("sympy_exp"), F.array(case, case).alias("test_cases"), F.array(floor, floor).alias("floor_cases"))


def symbolic_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.symbolic_check(_parts(spark, sf_dir))


def _calculus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose truths hold calculus, at the part's size and price; some truths are wrong, undefined or unreadable."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    k, x, y = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") / 1000
    said = (
        ("Integral(2*t + y, (t, 0, x))", x * x + x * y),
        ("Sum(k**2 + y, (k, 1, x))", x * (x + 1) * (2 * x + 1) / 6 + x * y),
        ("Product(y*k/(k + 1), (k, 1, 3)) + x", y * y * y / 4 + x),
        ("Derivative(sin(t*y)*t, t) + Derivative(x**3*y, (x, 2))", F.sin(y) + y * F.cos(y) + 6 * x * y),
        ("Integral(exp(-y*t), (t, 0, oo))", 1 / y),
        ("Sum(1, (k, 1, Sum(j, (j, 1, 3))))*y", 6 * y),
        ("Integral(y/(t - x/2), (t, 0, x))", y),
        ("Integral(2*t + y, t)", x * x),
        ("Integral(t*y, (t, 0, x))", x * x * y),
        ("Integral(1/sqrt(t), (t, 0, y)) + Sum(k, (k, 3, 2))", 2 * F.sqrt(y)),
    )
    e, out = F.lit(None), F.lit(None)
    for i, (text, value) in enumerate(said):
        e, out = F.when(k % len(said) == i, text).otherwise(e), F.when(k % len(said) == i, value).otherwise(out)
    case = F.struct(F.create_map(F.lit("x_val"), x.cast("string"), F.lit("y"), y.cast("string"), F.lit("t"), F.lit("1")).alias("input"), out.cast("string").alias("output"))
    return p.select(k.cast("string").alias("task_id"), e.alias("sympy_exp"), F.array(case).alias("test_cases"))


def calculus_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.symbolic_check(_calculus(spark, sf_dir))


def trivial_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("task_id", F.col("floor_cases").alias("test_cases"))
    return scoring.summary(scoring.per_problem(models.trivial_floor(rows))).select("n_problems", "problems_passed", "cases_passed")


def latex_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of the part size, some wrong, some of calculus, some unreadable."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    said = (
        F.when(k % 7 == 0, r"\frac{x^{2} + x}{2}").when(k % 7 == 1, r"\left(x + 1\right)^2 - 2x - 1").when(k % 7 == 2, r"\int_0^x t dt").when(k % 7 == 3, r"x^2 + \sin^{2} x + 1")
        .when(k % 7 == 4, r"\sqrt{x^4} \cdot (\sin^2 x + \cos^2 x)").when(k % 7 == 5, r"e^{2 \ln x}").otherwise(r"\frac{x^2")
    )
    case = F.struct(F.create_map(F.lit("x"), s.cast("string")).alias("input"), F.when(k % 7 == 0, s * (s + 1) / 2).otherwise((s * s).cast("double")).cast("string").alias("output"))
    rows = p.select(k.cast("string").alias("task_id"), said.alias("latex_expression"), F.array(case, case).alias("test_cases"))
    return scoring.summary(scoring.per_problem(models.latex_baseline(rows))).select("n_problems", "problems_passed", "cases_passed")


GUARDED = tuple(n for n, f in generators.FAMILIES.items() if not f.gated)


def spoilt(solution: Column) -> Column:
    """A solution that says no to everything. What it returned is bracketed, as `no or p if q else r` would spoil p only."""
    return F.regexp_replace(solution, r"return (.*)", r"return 'no' or ($1)")


def generate_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of all families that aren't gated; held-out ones dropped, the rest's solutions run on their cases: how each family's rows end."""
    keys, rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")), None
    for name in GUARDED:
        made = generators.problems(generators.with_solutions(generators.generate(keys, name, generation.SEED), name, generation.SEED), "solution").withColumn("family", F.lit(name))
        rows = made if rows is None else rows.union(made)
    rows = shared.stored(rows, "generated")
    # Every seventh solution is spoilt, and every fifth problem's texts are held out.
    number = F.regexp_extract("task_id", "_([0-9]+):", 1).cast("int")
    rows = rows.withColumn("solution", F.when(number % 7 == 3, spoilt(F.col("solution"))).otherwise(F.col("solution")))
    frozen = contamination.frozen_keys([rows.where(number % 5 == 0)], "latex_expression")
    accepted, rejected = generators.generation_run(rows, frozen)
    ends = accepted.select("family", F.lit("accepted").alias("outcome")).union(rejected.select("family", "reason"))
    return ends.groupBy("family", "outcome").agg(F.count("*").alias("n"))


def verified_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that arrive as JSONL in two rounds, the second of which repeats part of the first: each is verified once."""
    rows = _problems(spark, sf_dir)
    base = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    source, target = f"{base}/source", f"{base}/verified"
    schema = rows.drop("k").schema
    for part in (rows.where("k % 3 <> 0"), rows.where("k % 2 = 0")):
        part.drop("k").write.mode("append").json(source)
        resume.verify_stream(spark, source, schema, lambda df: verify.oracle_verify(df, n=2), target, f"{base}/marks", everything=True).awaitTermination()
    return spark.read.parquet(target).select("task_id", "accepted", "reason")


def resampled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three new cases a problem from its truth: how many there are, and whether all outputs are those of x^2 + 1."""
    done = verify.resample(_problems(spark, sf_dir).drop("code", "solution"), n=3)
    right = lambda c: outputs_match(c["output"], (F.pow(c["input"]["x"].cast("double"), F.lit(2)) + 1).cast("string"))
    return done.select("task_id", F.size("test_cases").alias("n_cases"), F.forall("test_cases", right).alias("all_right"))


def _gold():
    return lambda prompt: f"```python\n{GOOD}```"


def model_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub that always answers with the right function."""
    rows = _problems(spark, sf_dir).withColumn("latex_expression", F.lit("x^2 + 1")).drop("code")
    return scoring.summary(scoring.per_problem(models.benchmark(rows, _gold))).select("n_problems", "problems_passed", "problem_accuracy")


def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _problems(spark, sf_dir).withColumn("latex_expression", F.col("task_id"))
    frozen = rows.where("task_id in ('3', '5')")
    return publishing.validate(rows.drop("k"), rows.where("task_id < '2'").drop("k"), frozen.drop("k"), 24)


_VIEW = """WITH p AS (SELECT s_suppkey AS k FROM supplier),
  q AS (SELECT k, CASE WHEN k % 7 = 6 THEN 'unsafe' WHEN k % 5 = 4 THEN 'bad' WHEN k % 11 = 7 THEN 'fails' WHEN k % 17 = 3 THEN 'empty' ELSE 'good' END AS code,
    k % 13 NOT IN (5, 6, 8) AND k % 3 <> 1 AS coded, k % 19 = 2 AS truth_fails, k % 13 = 5 AS bare, k % 13 = 6 AS unreadable, k % 13 = 8 AS nowhere FROM p)"""
_ORACLE_REASON = """CASE WHEN code = 'empty' THEN 'empty solution' WHEN code = 'unsafe' THEN 'import of os' WHEN coded AND truth_fails THEN 'truth code failed to run'
    WHEN bare OR unreadable THEN 'no truth to compare with' WHEN code = 'fails' THEN 'candidate failed to run' WHEN nowhere THEN NULL WHEN code = 'bad' THEN 'mismatch with the truth' END"""
QUERIES = {f.__name__: f for f in (sandbox_exec, oracle_verify, curated, rewards, symbolic_truth, calculus_truth, trivial_floor, latex_baseline, generate_verified, resampled_cases, verified_stream, model_benchmark, dataset_checks)}
#: The wrong and unsafe solutions are known, so the verdicts are too.
ORACLES = {
    "symbolic_truth": """SELECT CAST(p_partkey AS VARCHAR) AS task_id, CASE p_partkey % 11 WHEN 0 THEN 'empty' WHEN 1 THEN 'parse error' WHEN 2 THEN 'undefined' ELSE 'evaluated' END AS status,
        2::BIGINT AS n_cases, CASE WHEN p_partkey % 11 > 3 THEN 2 ELSE 0 END::BIGINT AS n_passed FROM part""",
    "calculus_truth": """SELECT CAST(p_partkey AS VARCHAR) AS task_id, CASE p_partkey % 10 WHEN 5 THEN 'parse error' WHEN 6 THEN 'undefined' WHEN 7 THEN 'parse error' ELSE 'evaluated' END AS status,
        1::BIGINT AS n_cases, CASE WHEN p_partkey % 10 IN (5, 6, 7, 8) THEN 0 ELSE 1 END::BIGINT AS n_passed FROM part""",
    "trivial_floor": "SELECT count(*) AS n_problems, count(*) FILTER (p_partkey % 3 = 0) AS problems_passed, 2 * count(*) FILTER (p_partkey % 3 = 0) AS cases_passed FROM part",
    "latex_baseline": "SELECT count(*) AS n_problems, count(*) FILTER (p_partkey % 7 IN (0, 1, 4, 5)) AS problems_passed, 2 * count(*) FILTER (p_partkey % 7 IN (0, 1, 4, 5)) AS cases_passed FROM part",
    "generate_verified": f"""WITH r AS ({generation._each(GUARDED, lambda n: f"SELECT '{n}' AS family, i, latex FROM texts WHERE i IN (SELECT i FROM cases)")}),
        held AS (SELECT DISTINCT latex FROM r WHERE i % 5 = 0)
        SELECT family, CASE WHEN latex IN (SELECT latex FROM held) THEN 'contaminated' WHEN i % 7 = 3 THEN 'mismatch with a case' ELSE 'accepted' END AS outcome, count(*) AS n FROM r GROUP BY ALL""",
    "model_benchmark": "SELECT count(*) AS n_problems, count(*) AS problems_passed, 1.0::DOUBLE AS problem_accuracy FROM supplier",
    "dataset_checks": """SELECT 'complete' AS "check", true AS ok, 0::BIGINT AS n_bad UNION ALL SELECT 'uncontaminated', false, 2 UNION ALL SELECT 'hidden', false, count(*) FROM supplier WHERE CAST(s_suppkey AS VARCHAR) < '2'
        UNION ALL SELECT 'unique', true, 0 UNION ALL SELECT 'rows', count(*) = 24, abs(count(*) - 24) FROM supplier""",
    "resampled_cases": f"""{_VIEW}
        SELECT CAST(k AS VARCHAR) AS task_id, CASE WHEN coded AND truth_fails OR bare OR unreadable OR nowhere THEN 0 ELSE 3 END AS n_cases, true AS all_right FROM q""",
    "verified_stream": f"""{_VIEW}
        SELECT CAST(k AS VARCHAR) AS task_id, reason IS NULL AS accepted, reason FROM (SELECT k, {_ORACLE_REASON} AS reason FROM q WHERE k % 3 <> 0 OR k % 2 = 0) r""",
    "oracle_verify": f"""{_VIEW}
        SELECT CAST(k AS VARCHAR) AS task_id, reason IS NULL AS accepted, reason FROM (SELECT k, {_ORACLE_REASON} AS reason FROM q) r""",
    "curated": f"""{_VIEW}
        SELECT CAST(k AS VARCHAR) AS task_id, reason IS NULL AS accepted, reason FROM (SELECT k, CASE WHEN NOT bare THEN {_ORACLE_REASON}
          ELSE CASE code WHEN 'empty' THEN 'empty solution' WHEN 'unsafe' THEN 'error: import of os' WHEN 'fails' THEN 'error: ZeroDivisionError: division by zero' WHEN 'bad' THEN 'mismatch with a case' END END AS reason FROM q) r""",
    "rewards": f"""{_VIEW},
        t AS (SELECT k, code, CAST(k % 4 AS INT) AS kind, k % 23 <> 9 AS known FROM q UNION ALL SELECT k, 'good', 0, true FROM q UNION ALL SELECT k, 'bad', 0, true FROM q WHERE k % 2 = 0),
        r AS (SELECT CASE WHEN known THEN CAST(k AS VARCHAR) ELSE 'nobody' END AS task_id, known, kind, k, code, code IN ('good', 'bad') AS ran,
          NOT (k % 13 = 5 OR k % 13 NOT IN (6, 8) AND k % 3 = 0) AS has_exp FROM t),
        s AS (SELECT *, CASE WHEN NOT known THEN 0.0 WHEN kind = 2 THEN 0.0 WHEN kind = 3 THEN 1.0 WHEN kind = 1 THEN 1.0 + CASE WHEN ran THEN 1.0 ELSE -0.25 END WHEN ran THEN 1.0 ELSE -0.25 END::DOUBLE AS execution,
          known AND CASE kind WHEN 2 THEN k % 8 = 2 WHEN 3 THEN true ELSE code = 'good' END AS correct FROM r)
        SELECT task_id, CASE WHEN known AND kind <> 2 THEN 0.1 ELSE 0.0 END::DOUBLE AS tool, CASE WHEN known AND kind = 3 THEN 0.2 ELSE 0.0 END::DOUBLE AS meta, execution,
          CASE WHEN correct THEN 2.0 ELSE 0.0 END::DOUBLE AS terminal, CASE WHEN correct AND kind = 3 AND has_exp THEN -0.03 ELSE 0.0 END::DOUBLE AS complexity,
          round(CASE WHEN known AND kind <> 2 THEN 0.1 ELSE 0.0 END + CASE WHEN known AND kind = 3 THEN 0.2 ELSE 0.0 END + execution + CASE WHEN correct THEN 2.0 ELSE 0.0 END
            + CASE WHEN correct AND kind = 3 AND has_exp THEN -0.03 ELSE 0.0 END, 9)::DOUBLE AS total FROM s""",
    "sandbox_exec": f"""{_VIEW}
        SELECT CAST(k AS VARCHAR) AS task_id, CAST(i AS INT) AS case_index, CASE code WHEN 'good' THEN CAST(CAST(power(k + i, 2) + 1 AS DOUBLE) AS VARCHAR) WHEN 'bad' THEN CAST(CAST(power(k + i, 2) - 1 AS DOUBLE) AS VARCHAR) END AS got,
          CAST(CAST(power(k + i, 2) + 1 AS DOUBLE) AS VARCHAR) AS expected,
          CASE code WHEN 'unsafe' THEN 'import of os' WHEN 'empty' THEN 'no code' WHEN 'fails' THEN 'ZeroDivisionError: division by zero' END AS error FROM q, range(2) r(i)""",
}
