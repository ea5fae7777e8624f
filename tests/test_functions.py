import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import inputs, numbers, text

INF = float("inf")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("144328315.93417865", (144328315.93417865, 0.0)), ("-10.096475+88.331647j", (-10.096475, 88.331647)), ("42", (42.0, 0.0)), (" 1e-6 ", (1e-6, 0.0)), ("1 +-2j", (1.0, -2.0)),
        ("-inf", (-INF, 0.0)), ("3j", (0.0, 3.0)), ("-j", (0.0, -1.0)), ("(1+2j)", (1.0, 2.0)), ("True", (1.0, 0.0)), (".5", (0.5, 0.0)),
        ("1.0+-2.0j", None), ("not a number", None), ("1.5d", None), ("", None), (None, None),
    ],
)
def test_parse_number(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(numbers.parse_number(F.col("t")).alias("z")).first().z
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("got", "expected", "want"),
    [
        ("0.1", "0.10000000000000002", True), ("1+2j", "(1+2j)", True), ("1.0000001", "1.0", True), ("1.0", "1.001", False), (None, "1.0", False), ("garbage", "1.0", False),
        ("-inf", "-inf", True), ("inf", "-inf", False), ("inf", "1e300", False), ("nan", "nan", False), ("1e-10", "0", True), ("1", None, False),
    ],
)
def test_outputs_match(spark, got, expected, want):
    df = spark.createDataFrame([(got, expected)], "g string, e string")
    assert df.select(numbers.outputs_match(F.col("g"), F.col("e")).alias("m")).first().m is want


def test_format_output(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 3.0), (2.0, -3.0)], "re double, im double")
    assert [r[0] for r in df.select(numbers.format_output(F.col("re"), F.col("im"))).collect()] == ["2.0", "2.0+3.0j", "2.0-3.0j"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a ```python\nx = 1\n``` b", "x = 1"), ("<execute> y </execute> ```python\nx\n```", "y"), ("Sure:\ndef f(x):\n    y = x\n    return y\nand so on", "def f(x):\n    y = x\n    return y"),
        ("nothing here", None), (None, None),
    ],
)
def test_extract_code(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.extract_code(F.col("t")).alias("c")).first().c == want


def test_small_text_functions(spark):
    df = spark.createDataFrame([(r"\frac{x + a}{y} \sin(z) + e",)], "t string")
    row = df.select(
        text.final_answer(F.lit("stuff <final_answer>42.0</final_answer>")).alias("a"), text.final_answer(F.lit("none")).alias("b"), text.safe_name(F.lit("hf:Qwen/Qwen2.5-Math-7B")).alias("s"),
        text.latex_variables(F.col("t")).alias("v"), text.latex_variables(F.lit("2 + 3")).alias("w"), text.latex_functions(F.col("t"), ["sin", "cos"]).alias("f"), text.tally_key(F.lit("bad thing: x; y")).alias("k"),
        numbers.operation_count(F.lit("a**2 + b")).alias("o"),
    ).first()
    assert (row.a, row.b, row.s, row.v, row.w, row.f, row.k, row.o) == ("42.0", None, "hf_Qwen_Qwen2.5-Math-7B", ["a", "x", "y", "z"], ["x"], ["sin"], "bad thing", 3)


def test_jitter_moves_aliases_together(spark):
    df = spark.createDataFrame([({"x": "5", "x_val": "5", "y": "2.5", "z": "1+2j", "b": "true"},)] * 20, "m map<string,string>").withColumn("k", F.monotonically_increasing_id())
    rows = [r.j for r in df.select(inputs.jitter_inputs(F.col("m"), "1", F.col("k")).alias("j")).collect()]
    assert all(r["x"] == r["x_val"] and 2 <= int(r["x"]) <= 8 and abs(float(r["y"]) / 2.5 - 1) <= 0.15 and r["z"] == "1+2j" and r["b"] == "1" for r in rows)
    assert len({r["x"] for r in rows}) > 2
    again = [r.j for r in df.repartition(3).select(inputs.jitter_inputs(F.col("m"), "1", F.col("k")).alias("j")).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_bind(spark):
    df = spark.createDataFrame([(["x_val", "y", "k_value"], {"x": "1", "y": "2", "k": "3"})], "p array<string>, m map<string,string>")
    assert df.select(inputs.bind(F.col("p"), F.col("m")).alias("b")).first().b == {"x_val": "1", "y": "2", "k_value": "3"}


@pytest.mark.parametrize(
    ("text_", "want"),
    [
        ("x**2 + 1", ("evaluated", 10.0, 0.0)), ("sqrt(-x)", ("evaluated", 0.0, 3**0.5)), ("log(x - 3)", ("undefined", None, None)), ("binomial(4, 2) + gcd(12, 18)", ("evaluated", 12.0, 0.0)), ("__import__('os')", ("parse error", None, None)),
        ("x.y", ("parse error", None, None)), ("[1]", ("parse error", None, None)), ("", ("empty", None, None)), (None, ("empty", None, None)), ("1/(x - 3)", ("undefined", None, None)), ("y", ("undefined", None, None)), ("2 + 3*I", ("evaluated", 2.0, 3.0)),
    ],
)
def test_evaluate(spark, text_, want):
    from millrace.functions.expressions import evaluate

    df = spark.createDataFrame([(text_, {"x_val": "3"})], "t string, m map<string,string>")
    v = df.select(evaluate(F.col("t"), F.col("m")).alias("v")).first().v
    assert v.status == want[0] and (want[1] is None and v.re is None or math.isclose(v.re, want[1], abs_tol=1e-12) and math.isclose(v.im, want[2]))


@pytest.mark.parametrize(
    ("latex", "want"),
    [
        (r"2x^2 + 3x - 1", 13.0), (r"\frac{1}{x}", 0.5), (r"-x^2", -4.0), (r"\sin^{2}(x) + \cos^2 x", 1.0), (r"\sqrt[3]{4x}", 2.0), (r"|1 - x| \cdot 3", 3.0), (r"e^{\ln x}", 2.0), (r"\left(x + 1\right)\left(x - 1\right)", 3.0),
        (r"\log_{2} 8", 3.0), (r"x!", 2.0), (r"2^{-x}", 0.25), (r"\lfloor \pi \rfloor", 3.0), (r"\operatorname{asinh}(0) + x y", 6.0), (r"\tan^{-1}(0) + \frac12", 0.5), (r"\sin 0 \cos 0 + 3\pi/\pi", 3.0), (r"x(y+1)", 8.0),
        (r"\int_0^x t dt", None), (r"\frac{1", None), ("", None), (r"\sum_{k=1}^3 k", None), (None, None), ("x +", None),
    ],
)
def test_latex(latex, want):
    from millrace.functions import expressions, latex as reader

    got = reader.read(latex)
    assert (got is None) == (want is None)
    if want is not None:
        assert abs(expressions.compiled(got)({"x": 2 + 0j, "y": 3 + 0j}) - want) < 1e-9, got
