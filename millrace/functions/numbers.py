"""Real and complex numbers as text: parsing, tolerant comparison, formatting. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
SPECIAL = r"[+-]?(?:inf|infinity|nan)"
_PART = rf"(?:{REAL}|{SPECIAL})"

REL_TOL, ABS_TOL = 1e-6, 1e-9


def _double(text: Column) -> Column:
    low = F.lower(text)
    plain = F.regexp_replace(low, "^[+-]", "")
    sign = F.when(low.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(plain.isin("inf", "infinity"), sign * F.lit(float("inf")))
        .when(plain == "nan", F.lit(float("nan")))
        .when(low.rlike(f"^{REAL}$"), low.try_cast("double"))
    )


def parse_number(text: Column) -> Column:
    """struct<re, im>, or null where the text isn't a number. A blank before a doubled sign ('1 +-2j') is repaired."""
    t = F.regexp_replace(F.trim(text), r"\s\+-", "-")
    t = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    t = F.lower(F.regexp_replace(t, r"\s+(?=[+-])|(?<=[+-])\s+", ""))
    # An array of one makes the cleaned text a value that the branches share.
    return F.get(F.transform(F.array(t), _parsed), F.lit(0))


def _parsed(low: Column) -> Column:
    both = rf"^({_PART})([+-](?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)?)j$"
    alone = r"^([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)?)j$"
    unit = lambda s: F.when(s.isin("", "+"), F.lit(1.0)).when(s == "-", F.lit(-1.0)).otherwise(_double(s))
    pair = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    return (
        F.when(low.rlike(rf"^{_PART}$"), pair(_double(low), F.lit(0.0)))
        .when(low == "true", pair(F.lit(1.0), F.lit(0.0)))
        .when(low == "false", pair(F.lit(0.0), F.lit(0.0)))
        .when(low.rlike(alone), pair(F.lit(0.0), unit(F.regexp_extract(low, alone, 1))))
        .when(low.rlike(both), pair(_double(F.regexp_extract(low, both, 1)), unit(F.regexp_extract(low, both, 2))))
    )


def close(a: Column, b: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """Whether two doubles agree: infinities with themselves only, NaN with nothing. Null where one is null."""
    inf = float("inf")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
        .when(F.isnan(a) | F.isnan(b), F.lit(False))
        .when((F.abs(a) == inf) | (F.abs(b) == inf), a == b)
        .otherwise(F.abs(a - b) <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol)))
    )


def outputs_match(got: Column, expected: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """Whether two numbers given as text agree in both parts. Missing or unreadable ones never do."""
    x, y = parse_number(got), parse_number(expected)
    return F.coalesce(close(x["re"], y["re"], rel_tol, abs_tol) & close(x["im"], y["im"], rel_tol, abs_tol), F.lit(False))


def format_output(re: Column, im: Column) -> Column:
    """'2.0', or '2.0+3.0j' where there is an imaginary part."""
    sign = F.when(im >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(im != 0, F.concat(re.cast("string"), sign, im.cast("string"), F.lit("j"))).otherwise(re.cast("string"))


def repair_legacy(text: Column) -> Column:
    """Doubled signs of an old format, where the text doesn't parse as it is."""
    return F.when(parse_number(text).isNull(), F.regexp_replace(text, r" ?\+-", "-")).otherwise(text)


def complexity_number(text: Column) -> Column:
    """An integer, 0 where there is none."""
    return F.when(F.trim(text).rlike("^[+-]?[0-9]{1,9}$"), F.trim(text).try_cast("int")).otherwise(0)


def complexity_level(operations: Column) -> Column:
    """1 to 5 by the number of operations."""
    return F.when(operations <= 2, 1).when(operations <= 6, 2).when(operations <= 12, 3).when(operations <= 20, 4).otherwise(5)


def operation_count(code: Column) -> Column:
    """How many + - * / ^ a text has."""
    return F.length(code) - F.length(F.translate(code, "+-*/^", ""))
