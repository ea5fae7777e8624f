"""From scored cases to problems to groups. A problem is correct if all of its cases are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import ABS_TOL, REL_TOL, outputs_match


def explode_cases(problems: DataFrame) -> DataFrame:
    """(task_id, case_index, input, expected) of problems with nested test cases."""
    return problems.select("task_id", F.posexplode("test_cases").alias("case_index", "c")).select("task_id", "case_index", F.col("c.input").alias("input"), F.col("c.output").alias("expected"))


def align(problems: DataFrame, predictions: DataFrame, missing: str = "ignore", lengths: str = "fill") -> DataFrame:
    """(task_id, case_index, got, expected): outputs beside cases by place.

    predictions(task_id, outputs array<string>). missing: 'ignore' leaves out problems without predictions, 'fail' keeps
    them with null outputs. lengths: 'fill' fills short or unreadable outputs up with nulls, which fail, and leaves out what is too many; 'error' stops
    at predictions that differ from their cases in number.
    """
    if lengths not in ("fill", "error"):
        raise ValueError("lengths is 'fill' or 'error'")
    if missing not in ("ignore", "fail"):
        raise ValueError("missing is 'ignore' or 'fail'")
    joined = problems.select("task_id", "test_cases").join(predictions, "task_id", "inner" if missing == "ignore" else "left")
    if lengths == "error":
        said = F.concat(F.lit("task "), F.col("task_id").cast("string"), F.lit(" has "), F.size("outputs").cast("string"), F.lit(" outputs for "), F.size("test_cases").cast("string"), F.lit(" cases"))
        joined = joined.withColumn("outputs", F.when(F.size("outputs") != F.size("test_cases"), F.raise_error(said).cast("array<string>")).otherwise(F.col("outputs")))
    zipped = joined.select("task_id", "outputs", F.posexplode("test_cases").alias("case_index", "c"))
    return zipped.select("task_id", "case_index", F.get("outputs", F.col("case_index")).alias("got"), F.col("c.output").alias("expected"))


def unmatched(predictions: DataFrame, problems: DataFrame) -> DataFrame:
    return predictions.join(problems.select("task_id"), "task_id", "left_anti")


def score_cases(cases: DataFrame, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> DataFrame:
    """cases(got, expected as text) with `passed`. A null expectation is an error of the data, not of the answer."""
    expected = F.when(F.col("expected").isNull(), F.raise_error(F.lit("a case without an expected output can't be scored"))).otherwise(F.col("expected"))
    return cases.withColumn("passed", outputs_match(F.col("got"), expected, rel_tol, abs_tol))


def per_problem(scored: DataFrame, *more: str) -> DataFrame:
    """One row a problem: n_cases, n_passed, all_passed. Partial sums are made before the shuffle."""
    ok = F.coalesce("passed", F.lit(False))
    return scored.groupBy("task_id", *more).agg(F.count("*").alias("n_cases"), F.count_if(ok).alias("n_passed"), F.bool_and(ok).alias("all_passed"))


def ratio(part: Column, of: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), of.cast("double")), F.lit(0.0))


def summary(problems: DataFrame) -> DataFrame:
    """One row from per_problem(): both accuracies."""
    good = F.count_if("all_passed")
    return problems.agg(
        F.count("*").alias("n_problems"), F.coalesce(F.sum("n_cases"), F.lit(0)).alias("n_cases"), good.alias("problems_passed"), F.coalesce(F.sum("n_passed"), F.lit(0)).alias("cases_passed"),
        ratio(good, F.count("*")).alias("problem_accuracy"), ratio(F.sum("n_passed"), F.sum("n_cases")).alias("case_accuracy"),
    )


def by_group(problems: DataFrame, group: str, fold: dict[str, list[str]] | None = None) -> DataFrame:
    """Accuracies of each group, most passed cases first. fold: label -> the group values that it takes in. Null is 'None'."""
    g = F.coalesce(F.col(group).cast("string"), F.lit("None"))
    for label, values in (fold or {}).items():
        g = F.when(g.isin(values), F.lit(label)).otherwise(g)
    grouped = problems.groupBy(g.alias("grp"))
    return grouped.agg(
        F.count("*").alias("n_problems"), F.sum("n_cases").alias("n_cases"), F.count_if("all_passed").alias("problems_passed"), F.sum("n_passed").alias("cases_passed"),
        ratio(F.count_if("all_passed"), F.count("*")).alias("problem_accuracy"), ratio(F.sum("n_passed"), F.sum("n_cases")).alias("case_accuracy"),
    ).orderBy(F.desc("cases_passed"), "grp")


def failure_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, failures): the failures by each key on its own, in one pass by grouping sets."""
    names = [f"_{i}" for i in range(len(keys))]
    view = rows.where("not all_passed").select(*[F.coalesce(F.col(k).cast("string"), F.lit("None")).alias(n) for k, n in zip(keys, names, strict=True)])
    sets = view.groupingSets([[n] for n in names], *names).agg(F.count("*").alias("failures"), F.grouping_id().alias("_g"))
    which = F.element_at(F.array(*map(F.lit, keys)), F.lit(0))
    for i, (k, _) in enumerate(zip(keys, names, strict=True)):
        bits = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        which = F.lit(k) if i == 0 and len(keys) == 1 else F.when(F.col("_g") == bits, F.lit(k)).otherwise(which if i else F.lit(None))
    return sets.select(which.alias("dimension"), F.coalesce(*names).alias("value"), "failures")


def first_failures(scored: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """A row a problem with failures: the first one, and the first n. order: a total order of a problem's cases."""
    item = F.struct(*order, "got", "expected")
    failed = scored.where(~F.coalesce("passed", F.lit(False)))
    # The first n by a window, so that a problem with very many failures isn't collected.
    from pyspark.sql import Window as W

    top = failed.withColumn("_r", F.row_number().over(W.partitionBy("task_id").orderBy(*order))).where(F.col("_r") <= n)
    return top.groupBy("task_id").agg(F.min_by(F.struct("got", "expected"), item).alias("first_failure"), F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["got"].alias("got"), x["expected"].alias("expected"))).alias("failures"))


def example_failures(scored: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n problems with failures, by the first one's place, with it. A top-n: each task keeps n rows."""
    item = F.struct(*order, "got", "expected")
    failed = scored.where(~F.coalesce("passed", F.lit(False))).groupBy("task_id").agg(F.min(item).alias("_f"))
    return failed.orderBy("_f", "task_id").limit(n).select("task_id", "_f.got", "_f.expected")


def by_count(counted: DataFrame, value: str = "value", n: str = "failures") -> DataFrame:
    """The most frequent first, ties by value."""
    return counted.orderBy(F.desc(n), value)


def by_value(counted: DataFrame, value: str = "value") -> DataFrame:
    return counted.orderBy(value)


def legacy_accuracy(pairs: DataFrame, rel_tol: float = 1e-9) -> DataFrame:
    """The share of rows(got, expected) that agree to a relative tolerance alone."""
    return pairs.agg(ratio(F.count_if(outputs_match(F.col("got"), F.col("expected"), rel_tol, 0.0)), F.count("*")).alias("accuracy"))
