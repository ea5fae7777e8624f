"""Verification of solutions, curation, and the reward of a model's trajectory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import evaluate
from millrace.functions.inputs import sample_points
from millrace.functions.numbers import format_output, operation_count, outputs_match, parse_number
from millrace.functions.text import execute_blocks, final_answer
from millrace.operators import sandbox
from millrace.operators.scoring import per_problem, score_cases, summary

POINTS, REL_TOL, ABS_TOL = 8, 1e-5, 1e-8


def complex_close(a: Column, b: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """Whether two struct<re, im> agree by the modulus of their difference."""
    size = lambda z: F.hypot(z["re"], z["im"])
    gap = F.hypot(a["re"] - b["re"], a["im"] - b["im"])
    return (a == b) | (gap <= F.greatest(F.lit(rel_tol) * F.greatest(size(a), size(b)), F.lit(abs_tol)))


def _column(df: DataFrame, name: str) -> Column:
    return F.coalesce(name, F.lit("")) if name in df.columns else F.lit("")


def _once(rows: DataFrame, columns: tuple[str, ...], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that judge() finds for them. judge() gets each distinct content of `columns` once, under a task_id of its own.

    So rows that share a task_id are judged one by one, and copies are run once. The id is a hash of the content, which stays the same when a task is run again.
    """
    columns = tuple(c for c in columns if c in rows.columns)
    keyed = rows.withColumn("_content", F.sha2(F.to_json(F.struct(*columns)), 256))
    judged = judge(keyed.select(F.col("_content").alias("task_id"), *[c for c in columns if c != "task_id"]).dropDuplicates(["task_id"]))
    return keyed.join(judged.withColumnRenamed("task_id", "_judged"), F.col("_content") == F.col("_judged")).drop("_content", "_judged")


CONTENT = ("task_id", "code", "solution", "truth_code", "sympy_exp", "test_cases")


def numeric_check(problems: DataFrame, n: int = POINTS, seed: str = "0", **limits) -> DataFrame:
    """(task_id, numeric_ok, n_defined, why): code against the truth at n jittered points.

    problems(task_id, code, test_cases, and truth_code or sympy_exp or both). The truth is truth_code's result where there is one, else the value
    of sympy_exp. Points at which the truth has no finite value are skipped; if all are, the check passes with n_defined 0. It fails if
    there is no truth (or none that can be read), if either code fails at any point, and at the first output that is unreadable or off.
    """
    p = problems.select("task_id", "test_cases", "code", _column(problems, "truth_code").alias("truth_code"), _column(problems, "sympy_exp").alias("sympy_exp"))
    coded = F.trim("truth_code") != ""
    points = sample_points(p, n, seed).join(p.drop("test_cases"), "task_id")
    side = lambda name, code: F.struct(F.lit(name).alias("side"), F.col(code).alias("code"))
    sides = F.explode(F.when(coded, F.array(side("got", "code"), side("truth", "truth_code"))).otherwise(F.array(side("got", "code")))).alias("s")
    both = points.select("task_id", "point", "input", coded.alias("coded"), "sympy_exp", sides).select("task_id", "point", "input", "coded", "sympy_exp", "s.side", "s.code")
    done = sandbox.execute(both, **limits)
    ran = (F.col("run.exit_code") == 0) & F.col("run.safety_error").isNull() & ~F.col("run.timed_out")
    of = lambda name: F.max(F.when((F.col("side") == name) & ran, F.col("run.stdout"))).alias(name)
    wide = done.groupBy("task_id", "point").agg(of("got"), of("truth"), *[F.any_value(c).alias(c) for c in ("coded", "sympy_exp", "input")])
    wide = wide.withColumn("e", evaluate(F.when(~F.col("coded"), F.col("sympy_exp")), F.col("input")))
    t = F.when(F.col("coded"), parse_number(F.col("truth"))).otherwise(F.when(F.col("e.status") == "evaluated", F.struct("e.re", "e.im")))
    g = parse_number(F.col("got"))
    finite = t.isNotNull() & ~F.isnan(t["re"]) & ~F.isnan(t["im"]) & (F.abs(t["re"]) != float("inf")) & (F.abs(t["im"]) != float("inf"))
    defined = F.coalesce(finite, F.lit(False))
    at = lambda rank, why: F.struct(F.lit(rank).alias("rank"), F.lit(why).alias("why"))
    fault = (
        F.when(F.col("coded") & F.col("truth").isNull(), at(0, "truth code failed to run"))
        .when(~F.col("coded") & F.col("e.status").isin("empty", "parse error"), at(1, "no truth to compare with"))
        .when(F.col("got").isNull(), at(2, "candidate failed to run"))
        .when(defined & g.isNull(), at(3, "output is no number"))
        .when(defined & ~F.coalesce(complex_close(g, t), F.lit(False)), at(3, "mismatch with the truth"))
    )
    worst = F.min(F.when(fault.isNotNull(), F.struct(fault["rank"].alias("rank"), "point", fault["why"].alias("why"))))
    checked = wide.groupBy("task_id").agg(worst.alias("worst"), F.count_if(defined).alias("n_defined"))
    # Without cases there are no points; a truth is needed all the same.
    bare = F.when(~coded & (evaluate(F.col("sympy_exp"), F.create_map().cast("map<string,string>"))["status"].isin("empty", "parse error")), F.lit("no truth to compare with"))
    out = p.select("task_id", bare.alias("bare")).join(checked, "task_id", "left").withColumn("why", F.coalesce("worst.why", F.when(F.col("n_defined").isNull(), F.col("bare"))))
    return out.select("task_id", F.col("why").isNull().alias("numeric_ok"), F.coalesce("n_defined", F.lit(0)).alias("n_defined"), "why")


def oracle_verify(problems: DataFrame, **how) -> DataFrame:
    """(task_id, accepted, reason), a row per row: source check, then numeric check of those that pass it. Rows may share a task_id."""
    return _once(problems, CONTENT, lambda p: _oracle_verify(p, **how)).select("task_id", "accepted", "reason")


def _oracle_verify(problems: DataFrame, **how) -> DataFrame:
    """oracle_verify() of rows whose task_ids differ."""
    checked = problems.withColumn("_bad", F.when(F.trim(F.coalesce("code", F.lit(""))) == "", "empty solution").when(~F.contains("code", F.lit("def ")), "no function").otherwise(sandbox.safety("code")))
    good = numeric_check(checked.where("_bad is null").drop("_bad"), **how)
    out = checked.select("task_id", "_bad").join(good, "task_id", "left")
    reason = F.coalesce("_bad", "why")
    return out.select("task_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def verify_generated(problems: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of generated problems(task_id, solution, ..); rejected ones with their reason."""
    both = _once(problems.withColumn("code", F.col("solution")), CONTENT, lambda p: _oracle_verify(p, **how)).select(*problems.columns, "accepted", "reason")
    return both.where("accepted").drop("accepted", "reason"), both.where("not accepted").drop("accepted")


def resample(problems: DataFrame, n: int = POINTS, seed: str = "0", **limits) -> DataFrame:
    """problems(task_id, test_cases, truth_code or sympy_exp or both) with `n` new cases each: jittered inputs with the truth's outputs filled in.

    Points at which the truth fails, can't be read or has no finite value are left out; a problem without any such point, or without
    cases to jitter, has an empty array. Rows that share a task_id are resampled one by one.
    """
    return _once(problems.withColumnRenamed("test_cases", "_old"), CONTENT[:1] + ("_old",) + CONTENT[3:5], lambda p: _resample(p.withColumnRenamed("_old", "test_cases"), n, seed, **limits)).drop("_old")


def _resample(problems: DataFrame, n: int, seed: str, **limits) -> DataFrame:
    """(task_id, test_cases) of rows whose task_ids differ."""
    p = problems.select("task_id", "test_cases", _column(problems, "truth_code").alias("code"), _column(problems, "sympy_exp").alias("sympy_exp"))
    points = sample_points(p, n, seed).join(p.drop("test_cases"), "task_id")
    coded = F.trim("code") != ""
    ran = sandbox.execute(points.where(coded).select("task_id", "point", "code", "input"), **limits)
    ok = (F.col("run.exit_code") == 0) & F.col("run.safety_error").isNull() & ~F.col("run.timed_out")
    ran = ran.select("task_id", "point", "input", F.when(ok, parse_number(F.col("run.stdout"))).alias("z"))
    told = points.where(~coded).withColumn("e", evaluate(F.col("sympy_exp"), F.col("input")))
    told = told.select("task_id", "point", "input", F.when(F.col("e.status") == "evaluated", F.struct("e.re", "e.im")).alias("z"))
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = ran.union(told).where(finite(F.col("z.re")) & finite(F.col("z.im")))
    item = F.struct("point", "input", format_output(F.col("z.re"), F.col("z.im")).alias("output"))
    new = good.groupBy("task_id").agg(F.array_sort(F.collect_list(item), lambda a, b: a["point"] - b["point"]).alias("c"))  # n items at most
    new = new.select("task_id", F.transform("c", lambda c: F.struct(c["input"].alias("input"), c["output"].alias("output"))).alias("test_cases"))
    none = F.array().cast("array<struct<input:map<string,string>,output:string>>")
    return p.select("task_id").join(new, "task_id", "left").select("task_id", F.coalesce("test_cases", none).alias("test_cases"))


def gold_check(problems: DataFrame, least: float = 0.99, **limits) -> DataFrame:
    """The summary of the problems' own solutions; an error below `least`."""
    scored = score_cases(sandbox.run_solutions(problems, **limits))
    one = summary(per_problem(scored))
    return one.withColumn("problem_accuracy", F.when(F.col("problem_accuracy") < least, F.raise_error(F.concat(F.lit("gold accuracy "), F.col("problem_accuracy").cast("string")))).otherwise(F.col("problem_accuracy")))


def curate(rows: DataFrame, content: tuple[str, ...] = CONTENT[:1] + CONTENT[2:], **how) -> DataFrame:
    """rows(task_id, solution, truth_code, sympy_exp, test_cases) with accepted and reason, by the first branch that applies:

    no solution; checked against a truth, code or expression; compiled only, as there are no cases; run on all cases; all given outputs match.
    Rows may share a task_id. Rows alike in `content` are run once.
    """
    return _once(rows, content, lambda r: _curate(r, **how))


def _curate(rows: DataFrame, **how) -> DataFrame:
    """(task_id, accepted, reason) of rows whose task_ids differ."""
    base = rows.withColumn("code", F.coalesce("solution", F.lit("")))
    blank = F.trim("code") == ""
    true = (F.trim(_column(rows, "truth_code")) != "") | (F.trim(_column(rows, "sympy_exp")) != "")
    truth = _oracle_verify(base.where(~blank & true), **how)
    rest = base.where(~blank & ~true)
    bare = rest.where(F.size("test_cases") <= 0).withColumn("reason", sandbox.safety("code")).select("task_id", F.col("reason").isNull().alias("accepted"), "reason")
    ran = sandbox.run_solutions(rest.where(F.size("test_cases") > 0))
    wrong = F.col("expected").isNotNull() & ~outputs_match(F.col("got"), F.col("expected"))
    cases = ran.groupBy("task_id").agg(F.min(F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error")))).alias("e"), F.bool_or(wrong).alias("w"))
    cases = cases.select("task_id", (F.col("e").isNull() & ~F.col("w")).alias("accepted"), F.when(F.col("e").isNotNull(), F.col("e")).when(F.col("w"), "mismatch with a case").alias("reason"))
    empty = base.where(blank).select("task_id", F.lit(False).alias("accepted"), F.lit("empty solution").alias("reason"))
    verdicts = empty.union(truth).union(bare).union(cases)
    return verdicts.select("task_id", "accepted", F.left("reason", F.lit(200)).alias("reason"))


def combine_reports(partial: DataFrame, full: DataFrame, key: str = "task_id") -> DataFrame:
    """Both reports by key, the full one winning column by column of its rows."""
    a, b = partial.alias("a"), full.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    present = F.col(f"b.{key}").isNotNull()
    return both.select(*[F.when(present, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in partial.columns])


# Fixed values of the reward.
TOOL, META, BLOCK_OK, BLOCK_ERROR, TERMINAL, COMPLEXITY, COMPLEXITY_MOST = 0.1, 0.2, 1.0, -0.25, 2.0, 0.01, 5.0
TRACE = r"(?i)traceback|error:|exception"


def rewards(trajectories: DataFrame, problems: DataFrame, **limits) -> DataFrame:
    """(task_id, tool, meta, execution, terminal, complexity, total), a row per row of trajectories(task_id, trajectory).

    A task may have any number of trajectories, each judged by itself. problems(task_id, solution, sympy_exp, test_cases), a row a task. Each executed block runs on all cases; the last one's outputs are
    judged. Without a block, only the final answer can earn the terminal reward. Unknown tasks get 0 throughout.
    """
    done = _once(trajectories.select(F.col("task_id").alias("_task"), "trajectory"), ("_task", "trajectory"), lambda t: _rewards(t, problems, **limits))
    return done.select(F.col("_task").alias("task_id"), *PARTS, "total")


PARTS = ("tool", "meta", "execution", "terminal", "complexity")


def _rewards(trajectories: DataFrame, problems: DataFrame, **limits) -> DataFrame:
    """Rewards of trajectories(task_id, _task, trajectory), task_id being the trajectory's own."""
    problems = problems.select(F.col("task_id").alias("_task"), "solution", "sympy_exp", "test_cases")
    t = trajectories.join(problems.withColumn("_known", F.lit(True)), "_task", "left").withColumn("blocks", execute_blocks(F.col("trajectory")))
    runs = t.where("_known and size(blocks) > 0").select("task_id", F.posexplode("blocks").alias("block", "code"), "test_cases")
    cases = runs.select("task_id", "block", "code", F.posexplode("test_cases").alias("case_index", "c"))
    done = sandbox.execute(cases.select("task_id", "block", "case_index", F.col("c.output").alias("expected"), "code", F.col("c.input").alias("input")), **limits)
    ok = (F.col("run.exit_code") == 0) & F.col("run.safety_error").isNull()
    right = ok & F.col("expected").isNotNull() & outputs_match(F.when(ok, F.col("run.stdout")), F.col("expected"))
    per_block = done.groupBy("task_id", "block").agg(F.bool_and(ok).alias("ok"), F.bool_and(right).alias("right"))
    per_task = per_block.groupBy("task_id").agg(F.sum(F.when(F.col("ok"), BLOCK_OK).otherwise(BLOCK_ERROR)).alias("execution"), F.max_by("right", "block").alias("right"))
    j = t.join(per_task, "task_id", "left")
    used = F.size("blocks") > 0
    first = F.get("test_cases", F.lit(0))["output"]
    answered = F.coalesce(outputs_match(final_answer(F.col("trajectory")), first), F.lit(False))
    correct = F.when(used, F.coalesce("right", F.size("test_cases") == 0)).otherwise(answered)
    more = F.greatest(F.lit(0), operation_count(F.element_at("blocks", -1)) - operation_count(F.coalesce("solution", F.lit(""))))
    known = F.coalesce("_known", F.lit(False))
    part = lambda c: F.when(known, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    out = j.select(
        "task_id", part(F.when(used, F.lit(TOOL))).alias("tool"), part(F.when(F.col("trajectory").rlike(TRACE), F.lit(META))).alias("meta"),
        part(F.col("execution")).alias("execution"), part(F.when(correct, F.lit(TERMINAL))).alias("terminal"),
        part(F.when(used & correct & (F.trim(F.coalesce("sympy_exp", F.lit(""))) != ""), F.lit(0.0) - F.least(F.lit(COMPLEXITY_MOST), F.lit(COMPLEXITY) * more))).alias("complexity"),
    )
    return out.withColumn("total", F.round(F.col("tool") + F.col("meta") + F.col("execution") + F.col("terminal") + F.col("complexity"), 9))
