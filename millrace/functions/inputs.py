"""Inputs of cases: binding to parameters, jitter, sample points. Maps keep numbers as text, so whole numbers stay whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import hash_uniform


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "_(val|value)$", "")


def bind(parameters: Column, inputs: Column, defaults: Column | None = None) -> Column:
    """parameter -> value: the same key, else the key without _val, else without _value, else the default; null if none."""
    look = lambda p: F.coalesce(
        F.try_element_at(inputs, p),
        F.try_element_at(inputs, F.regexp_replace(p, "_val$", "")),
        F.try_element_at(inputs, F.regexp_replace(p, "_value$", "")),
        *([F.try_element_at(defaults, p)] if defaults is not None else []),
    )
    return F.map_from_arrays(parameters, F.transform(parameters, look))


def unbound(parameters: Column, bound: Column) -> Column:
    return F.filter(parameters, lambda p: F.try_element_at(bound, p).isNull())


def jitter(value: Column, u: Column) -> Column:
    """A value (text) moved by a uniform u: whole numbers by -3..3, others by up to 15 %, the rest as they are."""
    return (
        F.when(value.rlike("^[+-]?[0-9]{1,17}$"), (value.cast("long") + F.floor(u * 7) - 3).cast("string"))
        .when(value.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?$"), (value.try_cast("double") * (1 + (u * 0.3 - 0.15))).cast("string"))
        .when(F.lower(value) == "true", "1").when(F.lower(value) == "false", "0").otherwise(value)
    )


def jitter_inputs(inputs: Column, seed: str, key: Column) -> Column:
    """Every value jittered, with one draw per base name, so that x and x_val keep one value (the first key's)."""
    keys = F.map_keys(inputs)
    first = lambda k: F.element_at(F.filter(keys, lambda x: base_name(x) == base_name(k)), 1)
    draw = lambda k: hash_uniform(seed, F.concat_ws(":", key.cast("string"), base_name(k)))
    return F.transform_values(inputs, lambda k, _: jitter(inputs[first(k)], draw(k)))


def sample_points(problems: DataFrame, n: int, seed: str) -> DataFrame:
    """(task_id, point, input): n jittered inputs a problem, its cases' inputs taken in turn as templates."""
    points = problems.where(F.size("test_cases") > 0).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    template = F.element_at("test_cases", (F.col("point") % F.size("test_cases") + 1).cast("int"))["input"]
    return points.select("task_id", "point", jitter_inputs(template, seed, F.concat_ws(":", "task_id", "point")).alias("input"))
