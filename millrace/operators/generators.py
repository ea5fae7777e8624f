"""Verified synthetic problems from closed forms, one family a table of templates.

Row i of a family takes template i mod the number of templates and whole-number parameters a, b, c, m, n hashed from seed, family and i. Points x, y are
sampled by rejection without state: draws are numbered by attempt, and the first CASES that are accepted become the cases, possibly fewer. A draw
is accepted where the truth is finite, not too large, and no nearer to a pole than the family's margin. The truth is a closed form, printed as a native column
expression from a tree, from which the Python solution is printed too. Each problem comes in up to VARIANTS distinct notations, printed by native columns.
Rows are made by range() and explode(), without a shuffle, and don't depend on how they are dealt out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import contamination, reports, trees, verify

CASES, VARIANTS = 5, 4
#: Draws for a problem at most, and those that are tried first.
ATTEMPTS, FIRST_ATTEMPTS = 200, 8
#: Where the blocks begin in which draws are tried, and the end.
BLOCKS = (0, FIRST_ATTEMPTS, 40, ATTEMPTS)
LIMIT = 1e12
PARAMETERS = {"a": (1, 5), "b": (1, 5), "c": (1, 5), "m": (2, 8), "n": (2, 6)}
#: Points run from low to high in tenths; a Log gives magnitudes of all scales, of either sign.
POINTS = {"x": (5, 30), "y": (5, 30)}


@dataclass(frozen=True)
class Log:
    """Draws +-m * 10**e, m from 1.00 to 9.99 in hundredths, e whole from low to high."""

    low: int
    high: int


@dataclass(frozen=True)
class Template:
    kind: str
    latex: str  # <a> stands for the parameter's value
    truth: str  # SQL of both engines, unless `other` has DuckDB's
    imaginary: str = "0.0D"
    other: str | None = None
    other_imaginary: str | None = None


@dataclass(frozen=True)
class Family:
    slice: str
    templates: list[Template]
    ranges: dict[str, tuple[int, int] | Log] = field(default_factory=dict)
    gated: bool = False
    margin: float = 0.2  # how near to a pole a point may come


T = Template
_GCD = "array_max(filter(sequence(1, least({0}, {1})), d -> {0} % d = 0 AND {1} % d = 0))"
#: The largest number that the number-theory tables know.
_MOST = 200


def _arithmetic(what: str) -> list[int]:
    """An arithmetic function's values, by rule."""
    numbers = range(1, _MOST + 1)
    divisors = {m: [d for d in numbers if m % d == 0] for m in numbers}
    partitions = [1] + [0] * _MOST
    for part in numbers:
        for m in range(part, _MOST + 1):
            partitions[m] += partitions[m - part]
    mu = {1: 1}
    for m in range(2, _MOST + 1):
        mu[m] = -sum(mu[d] for d in divisors[m][:-1])
    return {
        "sigma": [sum(divisors[m]) for m in numbers], "tau": [len(divisors[m]) for m in numbers], "phi": [sum(math.gcd(k, m) == 1 for k in range(1, m + 1)) for m in numbers],
        "primes": [sum(len(divisors[p]) == 2 for p in range(1, m + 1)) for m in numbers], "mu": [mu[m] for m in numbers], "partitions": partitions[1:13],
    }[what]


def _table(what: str) -> str:
    """SQL that looks m up in a table of an arithmetic function."""
    return f"1.0D * element_at(array({', '.join(map(str, _arithmetic(what)))}), m)"


def _bell(n: int) -> list[int]:
    """The first n Bell numbers, by their triangle."""
    out, row = [], [1]
    for _ in range(n):
        out.append(row[-1])
        row = [row[-1], *row]
        for k in range(1, len(row)):
            row[k] += row[k - 1]
    return out


_LIST = "list_filter(range(1, m + 1), lambda d: m % d = 0)"
#: Ai(0) and -Ai'(0), and the two solutions of y'' = x y that start with 1 and with x.
_AIRY_AI, _AIRY_SLOPE = (repr(3 ** (-p / 3) / math.gamma(p / 3)) for p in (2, 1))
_AIRY_EVEN, _AIRY_ODD = (f"{first} * sum(prod(x * x * x / ((3.0 * j + {d}) * (3.0 * j + {d + 1})) for j in range(0, k)) for k in range(0, 25))" for first, d in (("1.0", 2), ("x", 3)))
_AIRY_SQL = "list_sum(list_transform(range(0, 61), lambda k: gamma((k + 1) / 3.0::DOUBLE) / gamma(k + 1.0::DOUBLE) * power(cbrt(3.0) * x, k) * {1})) / (pi() * power(3.0, {0}))"
_CHOOSE = "factorial({0}) / (factorial({1}) * factorial({0} - {1}))"

FAMILIES: dict[str, Family] = {
    "derivative": Family("calculus", [
        T("power", r"\frac{d}{dx} <a> x^{<n>}", "a * n * power(x, n - 1)"),
        T("sine", r"\frac{d}{dx} \sin(<a> x)", "a * cos(a * x)"),
        T("exp", r"\frac{d}{dx} e^{<a> x / <b>}", "(1.0D * a / b) * exp(a * x / b)", other="(1.0 * a / b) * exp(a * x / b)"),
        T("log", r"\frac{d}{dx} \ln(x^2 + 1)", "2 * x / (x * x + 1)"),
        T("atan", r"\frac{d}{dx} \arctan(<a> x)", "a / (1 + power(a * x, 2))"),
        T("quotient", r"\frac{d}{dx} \frac{<a>}{<b> x + <c>}", "-1.0D * a * b / power(b * x + c, 2)", other="-1.0 * a * b / power(b * x + c, 2)"),
        T("product", r"\frac{d}{dx} x e^{x}", "(1 + x) * exp(x)"),
        T("polynomial", r"\frac{d}{dx} (<a> x^{<n>} + <b> x^2 + <c> x)", "a * n * power(x, n - 1) + 2 * b * x + c"),
        T("sine_cosine", r"\frac{d}{dx} (<a> \sin x + <b> \cos x)", "a * cos(x) - b * sin(x)"),
        T("log_linear", r"\frac{d}{dx} \ln(<a> x + <b>)", "a / (a * x + b)"),
        T("hyperbolic", r"\frac{d}{dx} (\sinh(<a> x) + \cosh x)", "a * cosh(a * x) + sinh(x)", other="a * (exp(a * x) + exp(-a * x)) / 2 + (exp(x) - exp(-x)) / 2"),
        T("power_sine", r"\frac{d}{dx} x^{<n>} \sin x", "n * power(x, n - 1) * sin(x) + power(x, n) * cos(x)"),
        T("sine_of_square", r"\frac{d}{dx} \sin(<a> x^2)", "2 * a * x * cos(a * x * x)"),
        T("exp_of_sine", r"\frac{d}{dx} e^{\sin x}", "cos(x) * exp(sin(x))"),
        T("power_of_linear", r"\frac{d}{dx} (<a> x + <b>)^{<n>}", "a * n * power(a * x + b, n - 1)"),
        T("wrapped_sine", r"\frac{d}{dx} \sin(\ln(x^2 + 1))", "cos(ln(x * x + 1)) * 2 * x / (x * x + 1)"),
        T("wrapped_root", r"\frac{d}{dx} \sqrt{1 + e^{x}}", "exp(x) / (2 * sqrt(1 + exp(x)))"),
        T("wrapped_cosine", r"\frac{d}{dx} \cos(\sin(<a> x))", "-a * cos(a * x) * sin(sin(a * x))"),
    ]),
    "integration": Family("calculus", [
        T("power", r"\int_0^{x} <a> t^{<n>} dt", "a * power(x, n + 1) / (n + 1)"),
        T("sine", r"\int_0^{x} \sin(<a> t) dt", "(1 - cos(a * x)) / a"),
        T("decay", r"\int_0^{x} e^{-<a> t} dt", "(1 - exp(-a * x)) / a"),
        T("rational", r"\int_0^{x} \frac{1}{1 + t^2} dt", "atan(x)"),
        T("sine_squared", r"\int_0^{x} \sin^2 t dt", "x / 2 - sin(2 * x) / 4"),
        T("cosine", r"\int_0^{x} \cos(<a> t) dt", "sin(a * x) / a"),
        T("growth", r"\int_0^{x} e^{<a> t} dt", "(exp(a * x) - 1) / a"),
        T("linear_below", r"\int_0^{x} \frac{<a>}{<b> t + <c>} dt", "(1.0D * a / b) * ln((b * x + c) / c)", other="(1.0 * a / b) * (ln(b * x + c) - ln(c))"),
        T("half_log", r"\int_0^{x} \frac{t}{t^2 + 1} dt", "ln(x * x + 1) / 2"),
        T("parts_exp", r"\int_0^{x} t e^{t} dt", "(x - 1) * exp(x) + 1"),
        T("parts_cosine", r"\int_0^{x} t \cos t dt", "x * sin(x) + cos(x) - 1"),
        T("cosine_of_square", r"\int_0^{x} t \cos(t^2) dt", "sin(x * x) / 2"),
        T("interval", r"\int_{x}^{x + y} \frac{<a>}{t} dt", "a * ln((x + y) / x)", other="a * (ln(x + y) - ln(x))"),
        T("indefinite", r"F(x), F'(t) = <a> t + <b>, F(0) = <c>", "a * x * x / 2 + b * x + c"),
    ]),
    "ode": Family("ode", [
        T("decay", r"y' = -<a> y, y(0) = <b>", "b * exp(-a * x)"),
        T("linear", r"y' + <a> y = <b>, y(0) = <c>", "1.0D * b / a + (c - 1.0D * b / a) * exp(-a * x)", other="1.0 * b / a + (c - 1.0 * b / a) * exp(-a * x)"),
        T("gauss", r"y' + x y = 0, y(0) = <b>", "b * exp(-x * x / 2)"),
        T("oscillation", r"y'' + <a>^2 y = 0, y(0) = <b>, y'(0) = <c>", "b * cos(a * x) + c * sin(a * x) / a"),
        T("variable", r"y' + (<a> x + <b>) y = 0, y(0) = <c>", "c * exp(-(a * x * x / 2 + b * x))"),
        T("forced", r"y' + <a> y = <b> x + <c>, y(0) = 0", "1.0D * b / a * x + (1.0D * c / a - 1.0D * b / (a * a)) * (1 - exp(-a * x))", other="1.0 * b / a * x + (1.0 * c / a - 1.0 * b / (a * a)) * (1 - exp(-a * x))"),
        T("damped", r"y'' + 2 \cdot <a> y' + (<a>^2 + <b>^2) y = 0, y(0) = <c>, y'(0) = 0", "c * exp(-a * x) * (cos(b * x) + a * sin(b * x) / b)"),
        T("real_roots", r"y'' - <a>^2 y = 0, y(0) = <b>, y'(0) = <c>", "b * cosh(a * x) + c * sinh(a * x) / a", other="(b + 1.0 * c / a) / 2 * exp(a * x) + (b - 1.0 * c / a) / 2 * exp(-a * x)"),
    ]),
    "differential_c1": Family("ode", [
        T("first", r"y' + <a> y = 0, y = C_1 \ldots, C_1 = <c>", "c * exp(-a * x)"),
        T("euler", r"y' + \frac{<a>}{x} y = 0, C_1 = <c>", "c * power(x, -a)"),
        T("second", r"y'' - <a>^2 y = 0, C_1 = <b>, C_2 = <c>", "b * exp(-a * x) + c * exp(a * x)", other="b / exp(a * x) + c * power(exp(x), a)"),
        T("variable", r"y' + (<a> x + <b>) y = 0, C_1 = <c>", "c * exp(-(a * x * x / 2 + b * x))"),
        T("forced_constant", r"y' + <a> y = <b>, C_1 = <c>", "1.0D * b / a + c * exp(-a * x)", other="1.0 * b / a + c * exp(-a * x)"),
        T("forced_linear", r"y' + <a> y = <b> x, C_1 = <c>", "1.0D * b / a * x - 1.0D * b / (a * a) + c * exp(-a * x)", other="1.0 * b / a * x - 1.0 * b / (a * a) + c * exp(-a * x)"),
        T("forced_exp", r"y' + <a> y = e^{x}, C_1 = <c>", "exp(x) / (a + 1) + c * exp(-a * x)"),
    ]),
    "functions": Family("vocab", [
        T("asin", r"\arcsin(x / 4)", "asin(x / 4)"),
        T("acos", r"\arccos(x / 4)", "acos(x / 4)"),
        T("atan2", r"\operatorname{atan2}(x, <a>)", "atan2(x, a)"),
        T("floor", r"\lfloor <a> x \rfloor", "floor(a * x + 0.05D)", other="floor(a * x + 0.05)"),
        T("ceiling", r"\lceil <a> x \rceil", "ceil(a * x - 0.05D)", other="ceil(a * x - 0.05)"),
        T("absolute", r"|x - <a>|", "abs(x - a)"),
        T("log_base", r"\log_{<n>} x", "ln(x) / ln(n)"),
        T("cube_root", r"\sqrt[3]{<a> x}", "cbrt(a * x)"),
        T("factorial", r"<n>!", "1.0D * factorial(n)", other="1.0 * factorial(n)"),
        T("binomial", r"\binom{<m>}{2}", "m * (m - 1) / 2"),
        T("modulo", r"<a> x \bmod <b>", "a * x - b * floor(a * x / b + 1e-9D)", other="a * x - b * floor(a * x / b + 1e-9)"),
        T("extremes", r"\max(x, y) - \min(x, y)", "greatest(x, y) - least(x, y)"),
        T("atan", r"\arctan(<a> x)", "atan(a * x)"),
        T("sinh", r"\sinh(x)", "sinh(x)", other="(exp(x) - exp(-x)) / 2"),
        T("cosh", r"\cosh(x)", "cosh(x)", other="(exp(x) + exp(-x)) / 2"),
        T("tanh", r"\tanh(x)", "tanh(x)", other="(exp(2 * x) - 1) / (exp(2 * x) + 1)"),
        T("sign", r"\operatorname{sign}(x - <a>)", "1.0D * sign(x - a)", other="CASE WHEN x > a THEN 1.0 WHEN x < a THEN -1.0 ELSE 0.0 END"),
        T("minimum", r"\min(x, <a>)", "least(x, a)", other="CASE WHEN x < a THEN x ELSE a END"),
        T("maximum", r"\max(x, <a>)", "greatest(x, a)", other="CASE WHEN x > a THEN x ELSE a END"),
        T("root_quadratic", r"\sqrt{<a> x^2 + <b>}", "sqrt(a * x * x + b)"),
        T("exp_quadratic", r"e^{-x^2 / <a>}", "exp(-x * x / a)"),
        T("exp_linear", r"e^{x / <a> + <b>}", "exp(x / a + b)"),
        T("root_negative", r"\sqrt{-x}", "0.0D", "sqrt(x)", "0.0", "sqrt(x)"),
        T("log_negative", r"\ln(-x)", "ln(x)", "pi()"),
        T("asin_outside", r"\arcsin(1 + x / <a>)", "pi() / 2", "ln(1 + x / a + sqrt((1 + x / a) * (1 + x / a) - 1))"),
    ]),
    "elementary_ext": Family("vocab", [
        T("hyperbolic", r"\sinh(x) + \cosh(x / <a>)", "sinh(x) + cosh(x / a)"),
        T("reciprocal", r"\operatorname{sech}(x) + \coth(x)", "1 / cosh(x) + 1 / tanh(x)"),
        T("inverse", r"\operatorname{asinh}(<a> x) + \operatorname{acosh}(1 + x)", "ln(a * x + sqrt(a * a * x * x + 1)) + ln(1 + x + sqrt((1 + x) * (1 + x) - 1))"),
        T("secants", r"\sec(x / 4) + \csc(x)", "1 / cos(x / 4) + 1 / sin(x)"),
        T("nested", r"e^{\sin(<a> x)}", "exp(sin(a * x))"),
        T("roots", r"\sqrt[4]{x + <a>}", "power(x + a, 0.25D)", other="power(x + a, 0.25)"),
        T("poly2", r"<a> x^2 + <b> x + <c>", "a * x * x + b * x + c"),
        T("poly3", r"<a> x^3 - <b> x + <c>", "a * x * x * x - b * x + c"),
        T("sin", r"\sin(<a> x)", "sin(a * x)"),
        T("cos", r"\cos(<a> x)", "cos(a * x)"),
        T("exp", r"e^{x / <a>}", "exp(x / a)"),
        T("log", r"\ln(<a> x + <b>)", "ln(a * x + b)"),
        T("asin", r"\arcsin(x / 4)", "asin(x / 4)"),
        T("acos", r"\arccos(x / 4)", "acos(x / 4)", other="pi() / 2 - asin(x / 4)"),
        T("atan", r"\arctan(<a> x)", "atan(a * x)"),
        T("tanh", r"\tanh(x / <a>)", "tanh(x / a)", other="(exp(2 * x / a) - 1) / (exp(2 * x / a) + 1)"),
        T("sinh", r"\sinh(x / <a>)", "sinh(x / a)", other="(exp(x / a) - exp(-x / a)) / 2"),
        T("cosh", r"\cosh(x / <a>)", "cosh(x / a)", other="(exp(x / a) + exp(-x / a)) / 2"),
        T("sech", r"\operatorname{sech}(x)", "1 / cosh(x)", other="2 / (exp(x) + exp(-x))"),
        T("csch", r"\operatorname{csch}(x)", "1 / sinh(x)", other="2 / (exp(x) - exp(-x))"),
        T("coth", r"\coth(x)", "1 / tanh(x)", other="(exp(2 * x) + 1) / (exp(2 * x) - 1)"),
        T("asinh", r"\operatorname{asinh}(<a> x)", "ln(a * x + sqrt(a * a * x * x + 1))", other="asinh(a * x)"),
        T("acosh", r"\operatorname{acosh}(1 + x)", "ln(1 + x + sqrt((1 + x) * (1 + x) - 1))", other="acosh(1 + x)"),
        T("atanh", r"\operatorname{atanh}(x / 4)", "ln((1 + x / 4) / (1 - x / 4)) / 2", other="atanh(x / 4)"),
        T("abs", r"|<a> x - <b>|", "abs(a * x - b)"),
        T("sqrt", r"\sqrt{<a> x + <b>}", "sqrt(a * x + b)"),
        T("root3", r"\sqrt[3]{x + <a>}", "cbrt(x + a)"),
        T("root5", r"\sqrt[5]{x + <a>}", "power(x + a, 0.2D)", other="power(x + a, 0.2)"),
        T("factorial", r"<n>! x", "factorial(n) * x"),
        T("binomial", r"\binom{<m>}{3}", "m * (m - 1) * (m - 2) / 6"),
        T("atan2", r"\operatorname{atan2}(x, <a>)", "atan2(x, a)", other="atan(x / a)"),
        T("sine_of_decay", r"\sin(e^{-x})", "sin(exp(-x))"),
        T("log_of_root", r"\ln(1 + \sqrt{x})", "ln(1 + sqrt(x))"),
        T("atan_of_log", r"\arctan(\ln(x + <a>))", "atan(ln(x + a))"),
        T("root_of_square", r"\sqrt{1 + \sin^2 x}", "sqrt(1 + sin(x) * sin(x))"),
    ]),
    "complex_eval": Family("complex", [
        T("root", r"\sqrt{-<a> x}", "0.0D", "sqrt(a * x)", "0.0", "sqrt(a * x)"),
        T("log", r"\ln(-<a> x)", "ln(a * x)", "pi()"),
        T("rotation", r"e^{i <b> x}", "cos(b * x)", "sin(b * x)"),
        T("quotient", r"\frac{1}{x + <a> i}", "x / (x * x + a * a)", "-a / (x * x + a * a)"),
        T("arcsine", r"\arcsin(1 + x)", "pi() / 2", "ln(1 + x + sqrt((1 + x) * (1 + x) - 1))"),
        T("turned_sine", r"e^{i \sin(<b> x)}", "cos(sin(b * x))", "sin(sin(b * x))"),
        T("acosh_inside", r"\operatorname{acosh}(x / 4)", "0.0D", "acos(x / 4)", "0.0", "acos(x / 4)"),
        T("tanh", r"\tanh(i x / 4)", "0.0D", "tan(x / 4)", "0.0", "tan(x / 4)"),
        T("asin_reciprocal", r"\arcsin(\frac{1}{<b> x})", "asin(least(1.0D, 1 / (b * x)))", "CASE WHEN b * x < 1 THEN ln(1 / (b * x) + sqrt(1 / (b * b * x * x) - 1)) ELSE 0.0D END", "asin(least(1.0::DOUBLE, 1 / (b * x)))", "CASE WHEN b * x < 1 THEN acosh(1 / (b * x)) ELSE 0.0 END"),
        T("power_i", r"x^{i}", "cos(ln(x))", "sin(ln(x))"),
    ]),
    "multivariate": Family("multivariate", [
        T("quad_xterm", r"<a> x^2 + <b> x y + <c> y^2", "a * x * x + b * x * y + c * y * y"),
        T("diff_squares", r"(x - y)(x + y)", "x * x - y * y"),
        T("trig_cross", r"\sin(x) \cos(y)", "(sin(x + y) + sin(x - y)) / 2", other="sin(x) * cos(y)"),
        T("exp_cross", r"e^{-x y}", "exp(-x * y)"),
        T("log_prod", r"\ln(x^{<a>} y)", "a * ln(x) + ln(y)"),
        T("angle_diff", r"\sin(x - y)", "sin(x - y)"),
        T("augmented", r"\frac{<a> x + <b>}{y + <c>} e^{x / <m>}", "(a * x + b) / (y + c) * exp(x / m)", other="exp(x / m::DOUBLE) * (a * x + b) / (y + c)"),
        T("monomial_couple", r"<a> x^2 y + <b> x y", "a * x * x * y + b * x * y", other="x * y * (a * x + b)"),
    ]),
    "edge": Family("edge", [
        T("near_pole", r"\frac{1}{x - (<n> / 10 - 0.005)}", "1 / (x - (n / 10.0D - 0.005D))", other="1 / (x + 0.005::DOUBLE - n * 0.1::DOUBLE)"),
        T("log_over_root", r"\frac{\ln x}{\sqrt{x}}", "ln(x) / sqrt(x)"),
        T("root_square", r"\sqrt{(x - <a>)^2}", "abs(x - a)"),
        T("deep", r"\sin(\cos(\sin x))", "sin(cos(sin(x)))"),
        T("decay", r"e^{-<m> x^2}", "exp(-m * x * x)"),
        T("logscale_poly", r"<a> \cdot 10^{<n>} x^2 + <b>", "a * power(10, n) * x * x + b", other="a * x * x * power(10, n) + b"),
        T("logscale_ratio", r"\frac{10^{<n>} x}{10^{<n>} x + <a>}", "power(10, n) * x / (power(10, n) * x + a)", other="1 / (1 + a / (power(10, n) * x))"),
        T("nested_log_sin", r"\ln(2 + \sin(<a> x))", "ln(2 + sin(a * x))"),
    ], margin=0.0),
    "sequences": Family("sequences", [
        T("arithmetic", r"a_{<m>}, a_1 = <a>, d = <b>", "a + (m - 1) * b * 1.0D", other="a + (m - 1) * b * 1.0"),
        T("geometric", r"a_{<n>}, a_1 = <a>, r = <b>", "a * power(b, n - 1)"),
        T("triangular", r"T_{<m>}", "m * (m + 1) / 2", other="list_sum(range(1, m + 1)) * 1.0"),
        T("cubes", r"\sum_{k=1}^{<m>} k^3", "power(m * (m + 1) / 2, 2)", other="list_sum(list_transform(range(1, m + 1), lambda k: k * k * k)) * 1.0"),
        T("square", r"a_{<m>}, a_k = k^2", "1.0D * m * m", other="list_sum(list_transform(range(1, m + 1), lambda k: 2 * k - 1)) * 1.0"),
        T("quadratic", r"a_{<m>}, a_k = <a> k^2 + <b> k + <c>", "1.0D * (a * m * m + b * m + c)", other="1.0 * ((a * m + b) * m + c)"),
    ]),
    "geometry": Family("geometry", [
        T("circle", r"\pi (<a> x)^2", "pi() * power(a * x, 2)"),
        T("sphere", r"\frac{4}{3} \pi x^3", "4.0D / 3 * pi() * x * x * x", other="4.0 / 3 * pi() * x * x * x"),
        T("cone", r"\frac{1}{3} \pi x^2 y", "pi() * x * x * y / 3"),
        T("hypotenuse", r"\sqrt{x^2 + y^2}", "sqrt(x * x + y * y)"),
        T("trapezoid", r"\frac{x + y}{2} <a>", "(x + y) / 2 * a"),
        T("rectangle_area", r"A(x \times y)", "x * y"),
        T("rectangle_perimeter", r"2 (x + y)", "2 * (x + y)"),
        T("triangle", r"\frac{1}{2} x y", "x * y / 2"),
        T("square_perimeter", r"4 x", "4 * x"),
        T("box", r"x \cdot y \cdot <a>", "x * y * a"),
        T("circumference", r"2 \pi x", "2 * pi() * x"),
        T("cylinder", r"\pi x^2 y", "pi() * x * x * y"),
        T("trapezoid_height", r"\frac{x + <a>}{2} y", "(x + a) / 2 * y"),
    ]),
    "geometry_ext": Family("geometry", [
        T("distance", r"|(<a>, <b>) - (x, y)|", "sqrt(power(x - a, 2) + power(y - b, 2))"),
        T("heron", r"\triangle(3<a>, 4<a>, 5<a>)", "6.0D * a * a", other="sqrt(6.0 * a * (6 * a - 3 * a) * (6 * a - 4 * a) * (6 * a - 5 * a))"),
        T("angle", r"\angle((1, 0), (<a>, <b>))", "acos(a / sqrt(a * a + b * b))", other="atan2(b, a)"),
        T("circumference", r"2 \pi (<a> + <b>)", "2 * pi() * (a + b)"),
        T("squared_distance", r"|(<a>, <b>) - (x, y)|^2", "power(x - a, 2) + power(y - b, 2)"),
        T("triangle_points", r"A((0, 0), (<a>, <b>), (x, y))", "abs(a * y - b * x) / 2"),
        T("circle_area", r"A(\odot), r^2 = <a>^2 + <b>^2", "pi() * (a * a + b * b)"),
        T("perimeter", r"P(<a> \times <b>)", "2.0D * (a + b)", other="2.0 * (a + b)"),
        T("rectangle", r"A(<a> \times <b>)", "1.0D * a * b", other="1.0 * a * b"),
    ]),
    "summation": Family("summation", [
        T("squares", r"\sum_{k=1}^{<m>} k^2", "m * (m + 1) * (2 * m + 1) / 6", other="list_sum(list_transform(range(1, m + 1), lambda k: k * k)) * 1.0"),
        T("odd", r"\sum_{k=1}^{<m>} (2k - 1)", "1.0D * m * m", other="list_sum(list_transform(range(1, m + 1), lambda k: 2 * k - 1)) * 1.0"),
        T("powers", r"\sum_{k=0}^{<n>} 2^k", "power(2, n + 1) - 1", other="list_sum(list_transform(range(0, n + 1), lambda k: power(2, k)))"),
        T("alternating", r"\sum_{k=0}^{<n>} (-<b>)^k", "(1 - power(-b, n + 1)) / (1 + b)", other="list_sum(list_transform(range(0, n + 1), lambda k: power(-b, k)))"),
        T("product", r"\prod_{k=1}^{<n>} 2k", "aggregate(sequence(1, n), 1.0D, (p, k) -> p * 2 * k)", other="power(2, n) * factorial(n)"),
        T("telescope", r"\prod_{k=2}^{<m>} (1 - 1 / k^2)", "(m + 1) / (2.0D * m)", other="list_product(list_transform(range(2, m + 1), lambda k: 1.0 - 1.0 / (k * k)))"),
        T("first", r"\sum_{k=1}^{<m>} k", "m * (m + 1) / 2", other="list_sum(range(1, m + 1)) * 1.0"),
        T("even", r"\sum_{k=1}^{<m>} 2k", "1.0D * m * (m + 1)", other="list_sum(list_transform(range(1, m + 1), lambda k: 2 * k)) * 1.0"),
        T("geometric", r"\sum_{k=0}^{<n>} (<b> + 1)^k", "(power(b + 1, n + 1) - 1) / b", other="list_sum(list_transform(range(0, n + 1), lambda k: power(b + 1, k)))"),
        T("weighted_powers", r"\sum_{k=1}^{<m>} k 2^k", "(m - 1) * power(2, m + 1) + 2", other="list_sum(list_transform(range(1, m + 1), lambda k: k * power(2, k)))"),
        T("product_k", r"\prod_{k=1}^{<n>} k", "1.0D * factorial(n)", other="list_product(range(1, n + 1))"),
        T("product_ratio", r"\prod_{k=1}^{<m>} \frac{k}{k + 1}", "1.0D / (m + 1)", other="list_product(list_transform(range(1, m + 1), lambda k: k / (k + 1)))"),
        T("product_powers", r"\prod_{k=1}^{<n>} 2^k", "power(2, n * (n + 1) / 2)", other="list_product(list_transform(range(1, n + 1), lambda k: power(2, k)))"),
    ]),
    "limits": Family("limits", [
        T("sine", r"\lim_{t \to 0} \frac{\sin <a> t}{t}", "1.0D * a", other="1.0 * a"),
        T("cosine", r"\lim_{t \to 0} \frac{1 - \cos <a> t}{t^2}", "a * a / 2.0D", other="a * a / 2.0"),
        T("power", r"\lim_{t \to <a>} \frac{t^{<n>} - <a>^{<n>}}{t - <a>}", "n * power(a, n - 1)"),
        T("ratio", r"\lim_{t \to \infty} \frac{<a> t^2 + 1}{<b> t^2 + t}", "1.0D * a / b", other="1.0 * a / b"),
        T("compound", r"\lim_{t \to \infty} (1 + <a> / t)^t", "exp(a)"),
        T("euler", r"\lim_{t \to 0} (1 + t)^{1 / t}", "exp(1.0D)", other="exp(1.0)"),
        T("linear_ratio", r"\lim_{t \to \infty} \frac{<a> t + <b>}{<c> t + 1}", "1.0D * a / c", other="1.0 * a / c"),
        T("minus_infinity", r"\lim_{t \to -\infty} \frac{<a> t + 1}{<b> t - 1}", "1.0D * a / b", other="1.0 * a / b"),
        T("minus_infinity_root", r"\lim_{t \to -\infty} \frac{\sqrt{<a> t^2 + 1}}{t}", "-sqrt(a)"),
        T("exp_ratio", r"\lim_{t \to 0} \frac{e^{<a> t} - 1}{t}", "1.0D * a", other="1.0 * a"),
    ]),
    "series_coeff": Family("series", [
        T("exp", r"[t^{<n>}] e^{<a> t}", "power(a, n) / factorial(n)"),
        T("log", r"[t^{<n>}] \ln(1 + t)", "CASE WHEN n % 2 = 1 THEN 1.0D ELSE -1.0D END / n", other="power(-1, n + 1) / n"),
        T("geometric", r"[t^{<n>}] \frac{1}{1 - <a> t}", "power(a, n)"),
        T("binomial", r"[t^2] (1 + t)^{-<m>}", "m * (m + 1) / 2", other="(-m) * (-m - 1) / 2.0"),
        T("sin", r"[t^{<n>}] \sin(<a> t)", "CASE WHEN n % 4 = 1 THEN 1.0D WHEN n % 4 = 3 THEN -1.0D ELSE 0.0D END * power(a, n) / factorial(n)", other="round(sin(n * pi() / 2)) * power(a, n) / factorial(n)"),
        T("cos", r"[t^{<n>}] \cos(<a> t)", "CASE WHEN n % 4 = 0 THEN 1.0D WHEN n % 4 = 2 THEN -1.0D ELSE 0.0D END * power(a, n) / factorial(n)", other="round(cos(n * pi() / 2)) * power(a, n) / factorial(n)"),
        T("sinh", r"[t^{<n>}] \sinh(<a> t)", "n % 2 * power(a, n) / factorial(n)", other="(power(a, n) - power(-a, n)) / 2 / factorial(n)"),
        T("cosh", r"[t^{<n>}] \cosh(<a> t)", "(1 - n % 2) * power(a, n) / factorial(n)", other="(power(a, n) + power(-a, n)) / 2 / factorial(n)"),
        T("atan", r"[t^{<n>}] \arctan t", "CASE WHEN n % 4 = 1 THEN 1.0D WHEN n % 4 = 3 THEN -1.0D ELSE 0.0D END / n", other="round(sin(n * pi() / 2)) / n"),
        T("alternating", r"[t^{<n>}] \frac{1}{1 + t}", "CASE WHEN n % 2 = 0 THEN 1.0D ELSE -1.0D END", other="power(-1, n)"),
        T("positive_power", r"[t^2] (1 + t)^{<m>}", "m * (m - 1) / 2"),
    ]),
    "polynomial_invariants": Family("polynomial", [
        T("vieta_sum", r"sum of roots, <a> t^2 + <b> t + <c>", "-1.0D * b / a", other="-1.0 * b / a"),
        T("vieta_product", r"product of roots, <a> t^2 + <b> t + <c>", "1.0D * c / a", other="1.0 * c / a"),
        T("discriminant", r"\Delta(<a> t^2 + <b> t + <c>)", "1.0D * b * b - 4 * a * c", other="1.0 * b * b - 4 * a * c"),
        T("resultant", r"\operatorname{Res}(<a> t + <b>, <c> t + <m>)", "1.0D * a * m - b * c", other="1.0 * a * m - b * c"),
        T("coefficient", r"[t^2] (<a> + <b> t)^{<n>}", "n * (n - 1) / 2 * power(a, n - 2) * b * b"),
    ]),
    "matrix_scalars": Family("matrix", [
        T("det2", r"\det((<a>, <b>), (<c>, <m>))", "1.0D * a * m - b * c", other="1.0 * a * m - b * c"),
        T("trace", r"\operatorname{tr}((<a>, <b>), (<c>, <m>))", "1.0D * (a + m)", other="1.0 * (a + m)"),
        T("norm", r"\|(<a>, <b>; <c>, <m>)\|_F^2", "aggregate(array(a, b, c, m), 0.0D, (s, v) -> s + v * v)", other="1.0 * (a * a + b * b + c * c + m * m)"),
        T("charpoly", r"\det(\lambda I - A), \lambda = <n>", "(n - a) * (n - m) - 1.0D * b * c", other="(n - a) * (n - m) - 1.0 * b * c"),
        T("det3", r"\det of rows (<a>, <b>, <c>), (<b>, <c>, <m>), (<c>, <m>, <n>)", "1.0D * (a * (c * n - m * m) - b * (b * n - m * c) + c * (b * m - c * c))", other="1.0 * (a * c * n + 2 * b * m * c - c * c * c - a * m * m - b * b * n)"),
        T("inverse", r"(A^{-1})_{11}, A = ((<a>, <b>), (<c>, 3 <m> + 30))", "(3 * m + 30) / (1.0D * a * (3 * m + 30) - b * c)", other="1.0 / (a - 1.0 * b * c / (3 * m + 30))"),
        T("det4", r"\det(((<a>, <b>), (<c>, <m>)) \otimes ((1, <n>), (1, 1)))", "power(1.0D * a * m - b * c, 2) * power(1.0D - n, 2)", other="(a * m - b * c) * (a * m - b * c) * (1.0 - n) * (1.0 - n)"),
        T("rational", r"\det((1/<a>, 1/<b>), (1/<c>, 1/<m>))", "1.0D / (a * m) - 1.0D / (b * c)", other="1.0 / (a * m) - 1.0 / (b * c)"),
    ]),
    "numtheory": Family("numtheory", [
        T("gcd", r"\gcd(<m>, <n>)", f"1.0D * {_GCD.format('m', 'n')}", other="1.0 * gcd(m, n)"),
        T("lcm", r"\operatorname{lcm}(<m>, <n>)", f"1.0D * m * n / {_GCD.format('m', 'n')}", other="1.0 * lcm(m, n)"),
    ], {"m": (2, 200), "n": (2, 60)}),
    "ntheory_ext": Family("numtheory", [
        T("sigma", r"\sigma(<m>)", _table("sigma"), other=f"1.0 * list_sum({_LIST})"),
        T("tau", r"\tau(<m>)", _table("tau"), other=f"1.0 * len({_LIST})"),
        T("phi", r"\varphi(<m>)", _table("phi"), other="1.0 * len(list_filter(range(1, m + 1), lambda k: gcd(k, m) = 1))"),
        T("prime_count", r"\pi(<m>)", _table("primes"), other="1.0 * len(list_filter(range(2, m + 1), lambda p: len(list_filter(range(1, p + 1), lambda d: p % d = 0)) = 2))"),
        T("mu", r"\mu(<m>)", _table("mu"), other=f"CASE WHEN len(list_filter({_LIST}, lambda d: d > 1 AND m % (d * d) = 0)) > 0 THEN 0.0 ELSE power(-1, len(list_filter({_LIST}, lambda p: len(list_filter(range(1, p + 1), lambda d: p % d = 0)) = 2))) END"),
        T("partitions", r"p(<n>)", _table("partitions").replace(", m)", ", n)"), other="1.0 * [1, 2, 3, 5, 7, 11, 15, 22, 30, 42, 56, 77][n]"),
        T("inverse", r"<a>^{-1} \bmod (<a> \cdot <m> + 1)", "1.0D * (a * m + 1 - m)", other="1.0 * list_filter(range(1, a * m + 2), lambda k: (a * k) % (a * m + 1) = 1)[1]"),
        T("power_mod", r"<a>^{<n>} \bmod <m>", "aggregate(sequence(1, n), 1L, (p, k) -> p * a % m) * 1.0D", other="1.0 * (CAST(power(a, n) AS BIGINT) % m)"),
    ], {"m": (2, 200), "n": (2, 12)}),
    "combinatorics": Family("combinatorics", [
        T("catalan", r"C_{<m>}", f"{_CHOOSE.format('2 * m', 'm')} / (m + 1)", other="list_product(list_transform(range(2, m + 1), lambda k: (m + k) * 1.0 / k))"),
        T("derangement", r"!<m>", "aggregate(sequence(1, m), 1.0D, (d, k) -> d * k + CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)", other="round(factorial(m) / exp(1))"),
        T("stirling", r"S(<m>, 2)", "power(2, m - 1) - 1"),
        T("central", r"\binom{2 \cdot <m>}{<m>}", f"1.0D * {_CHOOSE.format('2 * m', 'm')}", other="list_sum(list_transform(range(0, m + 1), lambda k: power(factorial(m) / (factorial(k::INT) * factorial((m - k)::INT)), 2)))"),
        T("subsets", r"\sum_k \binom{<m>}{k}", f"aggregate(sequence(0, m), 0.0D, (s, k) -> s + {_CHOOSE.format('m', 'k')})", other="power(2, m)"),
        T("bell", r"B_{<m>}", f"1.0D * element_at(array{tuple(_bell(9))}, m)", other="round(list_sum(list_transform(range(0, 30), lambda k: power(k, m) / factorial(k::INT))) / exp(1))"),
        T("stirling3", r"S(<m>, 3)", "(power(3, m) - 3 * power(2, m) + 3) / 6"),
        T("pairs", r"\binom{<m>}{2}", "m * (m - 1) / 2"),
    ], {"m": (2, 9)}),
    "special_functions": Family("special", [
        T("legendre", r"P_2(x)", "(3 * x * x - 1) / 2"),
        T("chebyshev", r"T_{<n>}(x)", "aggregate(sequence(2, n), named_struct('p', 1.0D, 'q', x), (s, k) -> named_struct('p', s.q, 'q', 2 * x * s.q - s.p)).q", other="(power(x + sqrt(greatest(x * x - 1, 0)), n) + power(x - sqrt(greatest(x * x - 1, 0)), n)) / 2 * (x >= 1)::INT + cos(n * acos(least(x, 1))) * (x < 1)::INT"),
        T("gamma", r"\Gamma(<n>)", "1.0D * factorial(n - 1)", other="gamma(n)"),
        T("half_gamma", r"\Gamma(<n> + 1/2)", "factorial(2 * n) / (power(4, n) * factorial(n)) * sqrt(pi())", other="gamma(n + 0.5)"),
        T("beta", r"B(<n>, <a>)", "1.0D * factorial(n - 1) * factorial(a - 1) / factorial(n + a - 1)", other="gamma(n) * gamma(a) / gamma(n + a)"),
        T("legendre3", r"P_3(x)", "(5 * x * x * x - 3 * x) / 2"),
        T("hermite", r"H_3(x)", "8 * x * x * x - 12 * x", other="2 * x * (4 * x * x - 2) - 8 * x"),
        T("zeta2", r"\zeta(2)", "pi() * pi() / 6", other="list_sum(list_transform(range(1, 1001), lambda k: 1.0::DOUBLE / (k * k))) + 1 / 1000.5::DOUBLE"),
        T("zeta3", r"\zeta(3)", "1.2020569031595942D", other="list_sum(list_transform(range(1, 1001), lambda k: 1.0::DOUBLE / (k * k * k))) + 0.5 / power(1000.5, 2)"),
        T("erf", r"\operatorname{erf}(x)", "aggregate(sequence(1, 70), named_struct('t', x, 's', x), (z, k) -> named_struct('t', z.t * (-x * x) / k, 's', z.s + z.t * (-x * x) / k / (2 * k + 1))).s * 2 / sqrt(pi())", other="exp(-x * x) * list_sum(list_transform(range(0, 60), lambda k: power(x, 2 * k + 1) / gamma(k + 1.5)))"),
        T("bessel_j0", r"J_0(x)", "aggregate(sequence(1, 30), named_struct('t', 1.0D, 's', 1.0D), (z, k) -> named_struct('t', z.t * (-x * x / 4) / (k * k), 's', z.s + z.t * (-x * x / 4) / (k * k))).s", other="list_sum(list_transform(range(0, 30), lambda k: power(-1, k) * power(x / 2, 2 * k) / power(gamma(k + 1), 2)))"),
        T("bessel_j1", r"J_1(x)", "aggregate(sequence(1, 30), named_struct('t', x / 2, 's', x / 2), (z, k) -> named_struct('t', z.t * (-x * x / 4) / (k * (k + 1)), 's', z.s + z.t * (-x * x / 4) / (k * (k + 1)))).s", other="list_sum(list_transform(range(0, 30), lambda k: power(-1, k) * power(x / 2, 2 * k + 1) / gamma(k + 1) / gamma(k + 2)))"),
        # SQL takes the expansion in gamma values instead.
        T("airy_ai", r"\operatorname{Ai}(x)", f"{_AIRY_AI} * {_AIRY_EVEN} - {_AIRY_SLOPE} * {_AIRY_ODD}", other=_AIRY_SQL.format("2.0 / 3", "sin(2 * pi() * (k + 1) / 3)")),
        T("airy_bi", r"\operatorname{Bi}(x)", f"sqrt(3.0) * ({_AIRY_AI} * {_AIRY_EVEN} + {_AIRY_SLOPE} * {_AIRY_ODD})", other=_AIRY_SQL.format("1.0 / 6", "abs(sin(2 * pi() * (k + 1) / 3))")),
    ], {"n": (3, 6)}, True),
    "stats_moments": Family("stats", [
        T("uniform_mean", r"E[U(<a>, <a> + <b>)]", "a + b / 2.0D", other="a + b / 2.0"),
        T("uniform_var", r"Var[U(<a>, <a> + <b>)]", "b * b / 12.0D", other="b * b / 12.0"),
        T("exponential_square", r"E[X^2], X \sim Exp(<a>)", "2.0D / (a * a)", other="2.0 / (a * a)"),
        T("binomial_var", r"Var[B(<m>, 1/<n>)]", "m * (n - 1.0D) / (n * n)", other="m * (n - 1.0) / (n * n)"),
        T("poisson_square", r"E[X^2], X \sim Poisson(<a>)", "1.0D * a + a * a", other="1.0 * a + a * a"),
        T("beta_mean", r"E[Beta(<a>, <b>)]", "1.0D * a / (a + b)", other="1.0 * a / (a + b)"),
        T("normal_square", r"E[X^2], X \sim N(<a>, <b>^2)", "1.0D * a * a + b * b", other="1.0 * (a * a + b * b)"),
        T("normal_mean", r"E[N(<a>, <b>^2)]", "1.0D * a", other="1.0 * a"),
        T("normal_var", r"Var[N(<a>, <b>^2)]", "1.0D * b * b", other="1.0 * (a * a + b * b) - a * a"),
        T("uniform_square", r"E[X^2], X \sim U(<a>, <a> + <b>)", "a * a + a * b + b * b / 3.0D", other="(power(a + b, 3) - power(a, 3)) / (3 * b)"),
        T("exponential_mean", r"E[Exp(<a>)]", "1.0D / a", other="1.0 / a"),
        T("exponential_var", r"Var[Exp(<a>)]", "1.0D / (a * a)", other="1.0 / (a * a)"),
        T("binomial_mean", r"E[B(<m>, 1/<n>)]", "1.0D * m / n", other="1.0 * m / n"),
        T("binomial_square", r"E[X^2], X \sim B(<m>, 1/<n>)", "m * (n - 1.0D + m) / (n * n)", other="m * (n - 1.0) / (n * n) + power(1.0 * m / n, 2)"),
        T("poisson_mean", r"E[Poisson(<a>)]", "1.0D * a", other="1.0 * a"),
        T("poisson_var", r"Var[Poisson(<a>)]", "1.0D * a", other="1.0 * a"),
        T("beta_var", r"Var[Beta(<a>, <b>)]", "1.0D * a * b / ((a + b) * (a + b) * (a + b + 1))", other="1.0 * a * (a + 1) / ((a + b) * (a + b + 1)) - power(1.0 * a / (a + b), 2)"),
        T("beta_square", r"E[X^2], X \sim Beta(<a>, <b>)", "1.0D * a * (a + 1) / ((a + b) * (a + b + 1))", other="1.0 * a / (a + b) * (a + 1) / (a + b + 1)"),
    ], {}, True),
    "sets_cardinality": Family("sets", [
        T("overlap", r"|[<a>, <a> + <m>] \cap [<b>, <b> + <n>]|", "1.0D * greatest(0, least(a + m, b + n) - greatest(a, b))", other="1.0 * len(list_intersect(range(a, a + m), range(b, b + n)))"),
        T("union", r"|\{1..<m>\} \cup \{<n>..<n> + <a>\}|", "1.0D * size(array_union(sequence(1, m), sequence(n, n + a)))", other="1.0 * len(list_distinct(list_concat(range(1, m + 1), range(n, n + a + 1))))"),
        T("member", r"1_{[<a>, <m>]}(<b>)", "CASE WHEN b BETWEEN a AND m THEN 1.0D ELSE 0.0D END", other="CASE WHEN b >= a AND b <= m THEN 1.0 ELSE 0.0 END"),
        T("interval_union", r"|[<a>, <a> + <m>] \cup [<b>, <b> + <n>]|", "1.0D * (m + n - greatest(0, least(a + m, b + n) - greatest(a, b)))", other="1.0 * len(list_distinct(list_concat(range(a, a + m), range(b, b + n))))"),
        T("intersection", r"|\{1..<m>\} \cap \{<n>..<n> + <a>\}|", "1.0D * size(array_intersect(sequence(1, m), sequence(n, n + a)))", other="1.0 * greatest(0, least(m, n + a) - n + 1)"),
    ], {}, True),
    "solving_scalarized": Family("algebraic", [
        T("linear", r"<a> t + <b> = 0", "-1.0D * b / a", other="-1.0 * b / a"),
        T("double_root", r"t^2 - 2 \cdot <n> t + <n>^2 = 0", "1.0D * n", other="(2 * n + sqrt(4.0 * n * n - 4 * n * n)) / 2"),
        T("system", r"t + u = <m>, t - u = <n>", "(m + n) / 2.0D", other="(m + n) / 2.0"),
        T("system2", r"t: <a> t + <b> u = <c>, <b> t - <a> u = <m>", "(1.0D * a * c + b * m) / (a * a + b * b)", other="(1.0 * a * c + b * m) / (a * a + b * b)"),
        T("quadratic", r"larger t: t^2 - <n> t - <m> = 0", "(n + sqrt(n * n + 4.0D * m)) / 2", other="(n + sqrt(n * n + 4.0 * m)) / 2"),
    ], {}, True),
}


#: Python of the truths whose SQL isn't plain arithmetic; lists by rule are tuples.
CODE = {
    ("functions", "sign"): "1.0 if x > a else -1.0 if x < a else 0.0",
    ("complex_eval", "asin_reciprocal"): "complex(asin(least(1.0, 1 / (b * x))), ln(1 / (b * x) + sqrt(1 / (b * b * x * x) - 1)) if b * x < 1 else 0.0)",
    ("summation", "product"): "prod(2 * k for k in range(1, n + 1))",
    ("series_coeff", "log"): "(1.0 if n % 2 == 1 else -1.0) / n",
    ("series_coeff", "sin"): "(1.0 if n % 4 == 1 else -1.0 if n % 4 == 3 else 0.0) * power(a, n) / factorial(n)",
    ("series_coeff", "cos"): "(1.0 if n % 4 == 0 else -1.0 if n % 4 == 2 else 0.0) * power(a, n) / factorial(n)",
    ("series_coeff", "atan"): "(1.0 if n % 4 == 1 else -1.0 if n % 4 == 3 else 0.0) / n",
    ("series_coeff", "alternating"): "1.0 if n % 2 == 0 else -1.0",
    ("matrix_scalars", "norm"): "1.0 * (a * a + b * b + c * c + m * m)",
    ("numtheory", "gcd"): "1.0 * gcd(m, n)",
    ("numtheory", "lcm"): "1.0 * m * n / gcd(m, n)",
    ("ntheory_ext", "sigma"): "sum(d for d in range(1, m + 1) if m % d == 0)",
    ("ntheory_ext", "tau"): "sum(1 for d in range(1, m + 1) if m % d == 0)",
    ("ntheory_ext", "phi"): "sum(1 for k in range(1, m + 1) if gcd(k, m) == 1)",
    ("ntheory_ext", "prime_count"): "sum(1 for p in range(2, m + 1) if sum(1 for d in range(1, p + 1) if p % d == 0) == 2)",
    ("ntheory_ext", "mu"): "0.0 if sum(1 for d in range(2, m + 1) if m % (d * d) == 0) > 0 else power(-1.0, sum(1 for p in range(2, m + 1) if m % p == 0 and sum(1 for d in range(1, p + 1) if p % d == 0) == 2))",
    ("ntheory_ext", "partitions"): f"1.0 * {tuple(_arithmetic('partitions'))}[n - 1]",
    ("ntheory_ext", "power_mod"): "1.0 * (power(a, n) % m)",
    ("combinatorics", "derangement"): "sum(power(-1.0, k) * factorial(m) / factorial(k) for k in range(0, m + 1))",
    ("combinatorics", "subsets"): "sum(factorial(m) / (factorial(k) * factorial(m - k)) for k in range(0, m + 1))",
    ("combinatorics", "bell"): f"1.0 * {tuple(_bell(9))}[m - 1]",
    ("special_functions", "chebyshev"): "sum(power(-1.0, k) * n / 2 * factorial(n - k - 1) / (factorial(k) * factorial(n - 2 * k)) * power(2 * x, n - 2 * k) for k in range(0, n // 2 + 1))",
    ("special_functions", "erf"): "erf(x)",  # Python alone has it; Spark's truth is the series
    ("special_functions", "bessel_j0"): "sum(power(-1.0, k) * power(x / 2, 2 * k) / power(factorial(k), 2) for k in range(0, 20))",
    ("special_functions", "bessel_j1"): "sum(power(-1.0, k) * power(x / 2, 2 * k + 1) / (factorial(k) * factorial(k + 1)) for k in range(0, 20))",
    ("sets_cardinality", "union"): "sum(1 for k in range(1, m + n + a + 1) if k <= m or n <= k <= n + a)",
    ("sets_cardinality", "member"): "1.0 if a <= b <= m else 0.0",
    ("sets_cardinality", "intersection"): "sum(1 for k in range(1, m + 1) if n <= k <= n + a)",
}


def tree(name: str, t: Template) -> trees.Tree:
    """A template's truth as a tree; complex(re, im) where it isn't real."""
    if code := CODE.get((name, t.kind)):
        return trees.parse(code)
    return trees.parse(t.truth if t.imaginary == "0.0D" else f"complex({t.truth}, {t.imaginary})")


def truth(name: str, t: Template) -> tuple[str, str]:
    """Spark's SQL of a template's truth: real and imaginary part. Where the tree is only Python's way to it, the template has the shorter SQL."""
    if (name, t.kind) in CODE:
        return t.truth, t.imaginary
    try:
        return tuple(map(trees.sql, trees.parts(tree(name, t))))
    except trees.Unprintable:
        return t.truth, t.imaginary


def latex_parts(latex: str) -> list[str]:
    """Pieces of text and parameter names in turn."""
    return re.split(r"<([abcmn])>", latex)


def hashed(seed: str, name: str, parameter: str, key: Column, low: int, high: int) -> Column:
    text = F.md5(F.concat(F.lit(f"{seed}:{name}:{parameter}:"), key.cast("string")))
    return F.lit(low) + F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.lit(high - low + 1)).cast("int")


def draw_sql(seed: str, name: str, variable: str, key: str, domain: tuple[int, int] | Log) -> str:
    """SQL of a point's coordinate, a pure function of its key (SQL too)."""
    text = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def whole(tag: str, low: int, high: int) -> str:
        return f"({low} + CAST(pmod(CAST(conv(substring(md5(concat({text(f'{seed}:{name}:{tag}:')}, {key})), 1, 8), 16, 10) AS BIGINT), {high - low + 1}L) AS INT))"

    if isinstance(domain, tuple):
        return f"({whole(variable, *domain)} / 10.0D)"
    scales = ", ".join(f"{float(f'1e{e}')!r}D" for e in range(domain.low, domain.high + 1))
    sign, size, scale = whole(f"{variable}-sign", 0, 1), whole(f"{variable}-size", 100, 999), whole(f"{variable}-scale", 1, domain.high - domain.low + 1)
    return f"((CASE WHEN {sign} = 0 THEN -1.0D ELSE 1.0D END) * ({size} / 100.0D) * element_at(array({scales}), {scale}))"


def case_of(f: Family, what: Callable[[Template], str]) -> str:
    return "CASE _t " + " ".join(f"WHEN {k} THEN {what(t)}" for k, t in enumerate(f.templates)) + " END"


def family_of(family: str | tuple[str, Family], include_gated: bool) -> tuple[str, Family]:
    name, f = (family, FAMILIES[family]) if isinstance(family, str) else family
    if f.gated and not include_gated:
        raise ValueError(f"{name} is gated")
    return name, f


def kept(df: DataFrame) -> DataFrame:
    """df, its columns computed once: behind a generator they aren't written out again wherever they are used, filters that Spark infers included."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("o")).select("o.*")


def spread(keys: DataFrame) -> DataFrame:
    """keys(i), dealt over the cores: a table's keys are a few bytes a row, so that one task would read them and do all the work."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, "i")


def objects(keys: DataFrame, name: str, f: Family, seed: str) -> DataFrame:
    """(i, _t, a, b, c, m, n): each key's template and parameters."""
    ranges = PARAMETERS | f.ranges
    df = spread(keys.select(F.col("i").cast("long").alias("i"))).withColumn("_t", F.pmod(F.col("i"), F.lit(len(f.templates))).cast("int"))
    return kept(df.withColumns({p: hashed(seed, name, p, F.col("i"), *ranges[p]) for p in PARAMETERS}))


def with_points(df: DataFrame, name: str, f: Family, seed: str, cases: int = CASES) -> DataFrame:
    """objects()'s rows with `_points`, an array of struct<x, y, re, im>: the accepted points with the truth's value, in the order of their attempts.

    Attempts are numbered, and a draw depends on its number alone. They are tried block by block until there are enough. A truth without points is computed
    once a row, and a coordinate that the truth doesn't use is drawn for accepted points only.
    """
    domains = POINTS | f.ranges
    used = [set().union(*(trees.names(part) for part in trees.parts(tree(name, t)))) for t in f.templates]
    fixed = [k for k, u in enumerate(used) if not u & set(POINTS)]
    only = lambda ks, what: "CASE _t " + " ".join(f"WHEN {k} THEN {what(k)}" for k in ks) + " END" if ks else "NULL"
    part = lambda p: lambda k: truth(name, f.templates[k])[p]
    df = kept(df.withColumns({c: F.expr(f"CAST({only(fixed, part(p))} AS DOUBLE)") for p, c in enumerate(("_re", "_im"))}))
    moving = [k for k in range(len(f.templates)) if k not in fixed]
    value = lambda p, c: f"CAST({only(moving, part(p))} AS DOUBLE)" if not fixed else f"CASE WHEN _t IN ({', '.join(map(str, fixed))}) THEN {c} ELSE CAST({only(moving, part(p))} AS DOUBLE) END"
    drawn = lambda v, k: draw_sql(seed, name, v, f"concat(CAST(i AS STRING), ':', CAST({k} AS STRING))", domains[v])

    def coordinates(v: str) -> str:
        needed = [str(k) for k, u in enumerate(used) if v in u]
        one = f"CASE WHEN _t IN ({', '.join(needed)}) THEN {drawn(v, '_k')} END" if needed else "CAST(NULL AS DOUBLE)"
        return f"transform(sequence(_b.low, _b.high), _k -> {one})"

    tried = f"""zip_with({coordinates('x')}, {coordinates('y')}, (x, y) -> named_struct('x', x, 'y', y, 're', {value(0, '_re')}, 'im', {value(1, '_im')},
      'near', {case_of(f, lambda t: near_pole(name, f, t))}))"""
    good = f"filter(transform({tried}, (_e, _j) -> named_struct('k', _b.low + _j, 'e', _e)), _p -> NOT _p.e.near AND abs(_p.e.re) <= {LIMIT}D AND abs(_p.e.im) <= {LIMIT}D)"
    blocks = ", ".join(f"named_struct('low', {low}, 'high', {high - 1})" for low, high in pairwise(BLOCKS))
    none = "CAST(array() AS ARRAY<STRUCT<k: INT, e: STRUCT<x: DOUBLE, y: DOUBLE, re: DOUBLE, im: DOUBLE, near: BOOLEAN>>>)"
    found = f"aggregate(array({blocks}), {none}, (_s, _b) -> CASE WHEN size(_s) >= {cases} THEN _s ELSE slice(concat(_s, {good}), 1, {cases}) END)"
    whole = f"transform({found}, _p -> named_struct('x', coalesce(_p.e.x, {drawn('x', '_p.k')}), 'y', coalesce(_p.e.y, {drawn('y', '_p.k')}), 're', _p.e.re, 'im', _p.e.im))"
    return df.withColumn("_points", F.expr(whole)).drop("_re", "_im")


def sampled(df: DataFrame, name: str, f: Family, seed: str, cases: int = CASES) -> DataFrame:
    """objects()'s rows with case_index, x, y, expected and expected_im of each accepted point."""
    df = kept(with_points(df, name, f, seed, cases))
    return df.select("i", "_t", *PARAMETERS, F.posexplode("_points").alias("case_index", "p")).select("i", "_t", *PARAMETERS, "case_index", "p.x", "p.y", F.col("p.re").alias("expected"), F.col("p.im").alias("expected_im"))


def near_pole(name: str, f: Family, t: Template, spark: bool = True) -> str:
    """SQL: whether x or y is nearer to a pole of the truth than the family's margin."""
    found = [trees.near_pole(part, v, f.margin, spark) for part in trees.parts(tree(name, t)) for v in POINTS] if f.margin else []
    return " OR ".join(x for x in dict.fromkeys(found) if x != "false") or "false"


def notations(f: Family, engine: str, style: str) -> str:
    """SQL of a problem's text in the notation that `style`, 32 hexadecimal digits, chooses."""
    return case_of(f, lambda t: trees.text_sql(trees.written(t.latex)[0], style, engine))


def standard(f: Family, engine: str) -> str:
    """SQL of a problem's text as the template has it."""
    return case_of(f, lambda t: trees.text_sql((t.latex,), "", engine))


def generate(keys: DataFrame, family: str | tuple[str, Family], seed: str = "0", include_gated: bool = False) -> DataFrame:
    """Rows of a family for keys(i): task_id, slice, kind, latex, variant, case_index, x, y, expected, expected_im.

    family: a name in FAMILIES, or a name and a Family. A gated family needs include_gated. Problems without an accepted point give no row. Variant 0
    is the template's own text; others are printed by choices hashed from seed, family, i and variant, and equal prints are dropped.
    """
    name, f = family_of(family, include_gated)
    df = objects(keys, name, f, seed)
    styles = F.transform(F.sequence(F.lit(1), F.lit(VARIANTS - 1)), lambda v: F.md5(F.concat(F.lit(f"{seed}:{name}:style:"), F.col("i").cast("string"), F.lit(":"), v.cast("string"))))
    df = with_points(df, name, f, seed).withColumn("_styles", styles)
    df = df.withColumn("_texts", F.expr(f"array_distinct(concat(array({standard(f, 'spark')}), transform(_styles, style -> {notations(f, 'spark', 'style')})))"))
    df = kept(df.select("i", F.expr(case_of(f, lambda t: f"'{t.kind}'")).alias("kind"), "_points", "_texts"))
    df = df.select("i", "kind", "_points", F.posexplode("_texts").alias("variant", "latex")).select("i", "kind", "variant", "latex", F.posexplode("_points").alias("case_index", "p"))
    return df.select(
        F.concat(F.lit(f"{name}_"), F.col("i"), F.lit(":v"), F.col("variant")).alias("task_id"), F.lit(f.slice).alias("slice"), "kind",
        "latex", "variant", "case_index", "p.x", "p.y", F.col("p.re").alias("expected"), F.col("p.im").alias("expected_im"),
    )


#: What the truths' functions are called in Python.
_PRELUDE = """from math import acos, acosh, asin, asinh, atan, atan2, ceil, cos, cosh, erf, exp, factorial, floor, gcd, pi as _pi, prod, sin, sinh, sqrt, tan, tanh, log as ln
power, least, greatest, cbrt, pi = pow, min, max, (lambda v: v ** (1 / 3)), (lambda: _pi)
"""


def solution(name: str, t: Template) -> str:
    """Python code of a template's truth, printed from its tree, with <a> for its parameters."""
    return f"{_PRELUDE}def calculate(x, y):\n    return {trees.python(tree(name, t))}\n"


def with_solutions(cases: DataFrame, family: str | tuple[str, Family], seed: str = "0") -> DataFrame:
    """generate()'s rows of a family with a `solution` in Python."""
    name, f = family_of(family, True)
    ranges = PARAMETERS | f.ranges
    i = F.regexp_extract("task_id", "_([0-9]+):", 1).cast("long")
    out = F.lit(None).cast("string")
    for t in f.templates:
        text = F.concat(*[hashed(seed, name, p, i, *ranges[p]).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(latex_parts(solution(name, t)))])
        out = F.when(F.col("kind") == t.kind, text).otherwise(out)
    return cases.withColumn("solution", out)


def generation_run(rows: DataFrame, frozen: DataFrame, key: str = "latex_expression") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of generated rows(task_id, solution, test_cases, ..): rejected ones have the column `reason`.

    Held-out keys are dropped, the rest's solutions run on their cases. Notations of one problem share its solution and cases, which run once.
    """
    kept, dropped = contamination.split(rows, frozen, key)
    judged = verify.curate(kept, content=("solution", "test_cases"))
    return judged.where("accepted").drop("accepted", "reason"), judged.where("not accepted").drop("accepted").unionByName(dropped)


def generation_report(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: how many were generated, dropped as held out, accepted and rejected."""
    held = F.col("reason") == "contaminated"
    return reports.generation_report(accepted.select(F.lit(False).alias("contaminated"), F.lit(True).alias("accepted")).union(rejected.select(held, F.lit(False))))


def problems(cases: DataFrame, *more: str) -> DataFrame:
    """Generated cases as problems with nested test cases; more: columns that a problem's rows share."""
    inputs = F.create_map(F.lit("x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string"))
    im = F.col("expected_im")
    output = F.when(im == 0, F.col("expected").cast("string")).otherwise(F.concat(F.col("expected").cast("string"), F.when(im > 0, "+").otherwise(""), im.cast("string"), F.lit("j")))
    item = F.struct("case_index", inputs.alias("input"), output.alias("output"))
    grouped = cases.groupBy("task_id", "slice", "kind", F.col("latex").alias("latex_expression"), *more).agg(F.array_sort(F.collect_list(item), lambda p, q: p["case_index"] - q["case_index"]).alias("c"))
    return grouped.select("task_id", "latex_expression", "slice", "kind", *more, F.transform("c", lambda c: F.struct(c["input"].alias("input"), c["output"].alias("output"))).alias("test_cases"), F.lit(True).alias("synthetic"))


def pool(spark: SparkSession, count: int, seed: str = "0", families: list[str] | None = None, include_gated: bool = False) -> DataFrame:
    """All families' rows, `count` problems each."""
    names = families or [n for n, f in FAMILIES.items() if include_gated or not f.gated]
    keys = spark.range(count).withColumnRenamed("id", "i")
    out = generate(keys, names[0], seed, include_gated)
    for n in names[1:]:
        out = out.union(generate(keys, n, seed, include_gated))
    return out
