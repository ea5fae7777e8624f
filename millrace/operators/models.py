"""Scoring models and baselines: a back end is any callable from prompt to text, made once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import evaluate
from millrace.functions.latex import expression
from millrace.functions.numbers import format_output, outputs_match
from millrace.functions.text import build_prompt, extract_code
from millrace.operators import calculus, sandbox, scoring


def complete(prompts: DataFrame, make_backend: Callable[[], Callable[[str], str]]) -> DataFrame:
    """prompts(task_id, prompt) with `reply` and `error`. A call that fails leaves an error, not a failed task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for df in frames:
            replies, errors = [], []
            for p in df["prompt"]:
                try:
                    replies.append(backend(p)), errors.append(None)
                except Exception as e:
                    replies.append(None), errors.append(f"{type(e).__name__}: {e}"[:200])
            yield df.assign(reply=replies, error=errors)

    return prompts.select("task_id", "prompt").mapInPandas(run, "task_id string, prompt string, reply string, error string")


def benchmark(problems: DataFrame, make_backend: Callable[[], Callable[[str], str]], **limits) -> DataFrame:
    """Scored cases of a model: prompt, reply, code, run, comparison. Problems without code fail all their cases."""
    replies = complete(problems.select("task_id", build_prompt(F.col("latex_expression")).alias("prompt")), make_backend)
    coded = problems.join(replies.select("task_id", F.coalesce(extract_code(F.col("reply")), F.lit("")).alias("code")), "task_id")
    return scoring.score_cases(sandbox.run_solutions(coded.select("task_id", "code", "test_cases"), **limits))


def trivial_floor(problems: DataFrame) -> DataFrame:
    """Scored cases of the answer 0.0 to everything."""
    answers = problems.select("task_id", F.transform("test_cases", lambda c: F.lit("0.0")).alias("outputs"))
    return scoring.score_cases(scoring.align(problems, answers))


def latex_outputs(problems: DataFrame) -> DataFrame:
    """(task_id, outputs): what the formula itself gives for each case, null where it can't be read or has no value there."""
    cases = problems.select("task_id", expression(F.col("latex_expression")).alias("e"), F.posexplode("test_cases").alias("case_index", "c"))
    v = cases.select("task_id", "case_index", evaluate(F.col("e"), F.col("c.input")).alias("v"))
    text = F.when(F.col("v.status") == "evaluated", format_output(F.col("v.re"), F.col("v.im")))
    rows = v.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("case_index", text.alias("o")))).alias("o"))
    return rows.select("task_id", F.col("o.o").alias("outputs"))


def latex_baseline(problems: DataFrame) -> DataFrame:
    """Scored cases of reading the LaTeX formula and evaluating it at the inputs."""
    return scoring.score_cases(scoring.align(problems, latex_outputs(problems)))


def symbolic_check(problems: DataFrame) -> DataFrame:
    """(task_id, status, n_cases, n_passed): truth expressions against the cases' outputs.

    problems(task_id, sympy_exp, test_cases). status is empty, parse error, undefined (at some case) or evaluated; only
    evaluated rows can pass. Integral, Sum, Product and Derivative are evaluated as rows, see calculus.values.
    """
    cases = problems.select("task_id", "sympy_exp", F.explode("test_cases").alias("c"))
    cases = cases.select("task_id", "sympy_exp", F.col("c.output").alias("expected"), F.col("c.input").alias("input"))
    done = calculus.values(cases, "sympy_exp", "input").select("task_id", "expected", "v")
    im = F.when(F.col("v.im") != 0, F.concat(F.when(F.col("v.im") > 0, "+").otherwise(""), F.col("v.im").cast("string"), F.lit("j"))).otherwise("")
    ok = outputs_match(F.concat(F.col("v.re").cast("string"), im), F.col("expected"))
    worst = F.min_by("v.status", F.element_at(F.create_map(*[x for k, s in enumerate(("parse error", "empty", "undefined", "evaluated")) for x in (F.lit(s), F.lit(k))]), F.col("v.status")))
    return done.groupBy("task_id").agg(worst.alias("status"), F.count("*").alias("n_cases"), F.count_if(ok).alias("n_passed"))
