"""Integrals, sums, products and derivatives inside truth expressions, evaluated as rows.

An expression is cut at its outermost calculus terms; each becomes rows, one a node or term, on which the body is evaluated like any
expression; the rows are added up before they meet in a shuffle, and the expression is evaluated with the terms' values put in. Integral, Sum
and Product take `(x, low, high)`, Derivative `x` or `(x, n)`, each any number of them, the first innermost.
"""

from __future__ import annotations

import ast
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import evaluate

KINDS = ("Integral", "Sum", "Product", "Derivative")
#: Step of the double exponential rule; every second node gives the coarse value that an integral is checked against.
STEP = 1 / 32
#: How far the two values of an integral or derivative may be apart, relative beyond 1. An integral's fine value has about twice as many right digits as the coarse one.
AGREE = {"Integral": 1e-6, "Derivative": 1e-8}
#: Derivatives take the central nodes -REACH .. REACH at each of these scales, times the greater of 1 and |x|.
REACH = 4
SCALES = (0.2, 0.05, 0.0125, 0.003)
MOST_ORDER = 4
#: Terms of a sum come in blocks of this many, so that no array grows with the bounds.
BLOCK = 4096

_PART = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "body", "var", "low", "high")] + [T.StructField("order", T.IntegerType())])
_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("parts", T.ArrayType(_PART))])


def has_calculus(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"\b({'|'.join(KINDS)})\s*\("), F.lit(False))


def cut(text: str) -> tuple[str, list[tuple]]:
    """The expression with names c0_, c1_, .. for its outermost calculus terms, and these; ValueError where it can't be read."""
    parts: list[tuple] = []

    def limit(kind: str, node: ast.expr) -> tuple:
        match kind, node:
            case "Derivative", ast.Name(id=x):
                return x, None, None, 1
            case "Derivative", ast.Tuple(elts=[ast.Name(id=x), ast.Constant(value=int() as n)]) if 0 < n <= MOST_ORDER:
                return x, None, None, n
            case ("Integral" | "Sum" | "Product"), ast.Tuple(elts=[ast.Name(id=x), low, high]) if not any(isinstance(n, ast.Name) and n.id in KINDS for n in [*ast.walk(low), *ast.walk(high)]):
                return x, ast.unparse(low), ast.unparse(high), None
        raise ValueError(f"not a limit: {ast.unparse(node)}")

    class Cut(ast.NodeTransformer):
        def visit_Call(self, node: ast.Call) -> ast.expr:  # noqa: N802
            if not isinstance(node.func, ast.Name) or node.func.id not in KINDS:
                return self.generic_visit(node)
            if len(node.args) < 2 or node.keywords:
                raise ValueError("a calculus term without limits")
            body = node.args[0] if len(node.args) == 2 else ast.Call(node.func, node.args[:-1], [])
            parts.append((node.func.id, ast.unparse(body), *limit(node.func.id, node.args[-1])))
            return ast.Name(f"c{len(parts) - 1}_")

    try:
        tree = ast.parse(text.strip().replace("^", "**"), mode="eval").body
        return ast.unparse(Cut().visit(tree)), parts
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from e


@F.pandas_udf(_CUT)
def _cut(text: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple] = {}
    for t in text.unique():
        try:
            known[t] = cut(t)
        except ValueError:
            known[t] = (None, [])
    return pd.DataFrame([known[t] for t in text], columns=["text", "parts"])


def stencil(order: int) -> list[float]:
    """Weights of f(x - REACH h) .. f(x + REACH h) whose sum is the derivative times h ** order, exact for polynomials."""
    offsets = range(-REACH, REACH + 1)
    n = len(offsets)
    rows = [[Fraction(o) ** k for o in offsets] + [Fraction(math.factorial(order) if k == order else 0)] for k in range(n)]
    for i in range(n):
        p = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [float(r[-1]) for r in rows]


def _integral_nodes() -> list[tuple[float, float, float, bool]]:
    """(distance to the low end, distance to the high end, weight, coarse) on the interval from 0 to 1, by the double exponential rule."""
    out = []
    for k in range(-math.floor(3.4 / STEP), math.floor(3.4 / STEP) + 1):
        s = math.pi / 2 * math.sinh(k * STEP)
        q = 1 / (1 + math.exp(2 * abs(s)))  # to the nearer end
        w = STEP * math.pi / 2 * math.cosh(k * STEP) / (2 * math.cosh(s) ** 2)
        out.append((1 - q if s > 0 else q, q if s > 0 else 1 - q, w, k % 2 == 0))
    return out


def _nodes(low: Column, high: Column, x: Column) -> Column:
    """array<struct<x, w, level>> of a term: where its body is evaluated and with which weight. level tells an integral's coarse nodes (0) from the others (1), and a derivative's scales."""
    kind = F.col("kind")
    d = lambda v: F.lit(float(v))
    unit = F.array(*[F.struct(d(a).alias("a"), d(b).alias("b"), d(w).alias("w"), F.lit(0 if c else 1).alias("level")) for a, b, w, c in _integral_nodes()])
    inf_low, inf_high, width = low == d("-inf"), high == d("inf"), high - low

    def placed(n: Column) -> Column:
        a, b, w = n["a"], n["b"], n["w"]
        at = (
            F.when(inf_low & inf_high, (a - b) / (d(4) * a * b)).when(inf_high, low + a / b).when(inf_low, high - b / a)
            .when(a < b, low + width * a).otherwise(high - width * b)
        )
        by = F.when(inf_low & inf_high, (a * a + b * b) / (d(4) * a * a * b * b)).when(inf_high, d(1) / (b * b)).when(inf_low, d(1) / (a * a)).otherwise(width)
        return F.struct(at.alias("x"), (w * by).alias("w"), n["level"].alias("level"))

    step = lambda i: d(SCALES[i]) / d(REACH) * F.greatest(d(1), F.abs(x))
    weights = lambda o: F.element_at(F.array(*[d(stencil(n)[o + REACH]) for n in range(1, MOST_ORDER + 1)]), F.col("order"))
    around = F.array(*[F.struct((x + d(o) * step(i)).alias("x"), (weights(o) / F.pow(step(i), F.col("order"))).alias("w"), F.lit(i).alias("level")) for i in range(len(SCALES)) for o in range(-REACH, REACH + 1)])
    first = low.cast("long") + F.col("block") * BLOCK
    terms = F.transform(F.sequence(first, F.least(first + F.lit(BLOCK - 1), high.cast("long"))), lambda k: F.struct(k.cast("double").alias("x"), d(1).alias("w"), F.lit(0).alias("level")))
    return F.when(kind == "Integral", F.transform(unit, placed)).when(kind == "Derivative", around).otherwise(terms)


def _real(v: Column) -> Column:
    return F.when((v["status"] == "evaluated") & (v["im"] == 0), v["re"])


def _bound(text: Column) -> Column:
    return F.when(text == "oo", F.lit(float("inf"))).when(text == "-oo", F.lit(float("-inf"))).otherwise(_real(evaluate(text, F.col("inputs"))))


def _text(re_: Column, im: Column) -> Column:
    return F.concat(re_.cast("string"), F.when(im != 0, F.concat(F.when(im > 0, "+").otherwise(""), im.cast("string"), F.lit("j"))).otherwise(""))


def _terms(parts: DataFrame, depth: int) -> DataFrame:
    """parts(text, given, inputs, n and the fields of _PART) with `value`, a number's text, null where the term has no value."""
    var, kind, series = F.col("var"), F.col("kind"), F.col("kind").isin("Sum", "Product")
    # An input may be named x, x_val or x_value; the bound variable hides it.
    name = lambda k: F.regexp_replace(k, "_(val|value)$", "")
    p = parts.withColumn("_low", F.when(F.col("low").isNotNull(), _bound(F.col("low")))).withColumn("_high", F.when(F.col("high").isNotNull(), _bound(F.col("high"))))
    p = p.withColumn("_x", F.when(kind == "Derivative", _real(evaluate(var, F.col("inputs"))))).withColumn("inputs", F.map_filter("inputs", lambda k, _: name(k) != var))
    low, high = F.col("_low"), F.col("_high")
    whole = (F.floor(low) == low) & (F.floor(high) == high) & (F.abs(low) < 2**53) & (F.abs(high) < 2**53)
    defined = F.coalesce(F.when(series, whole).when(kind == "Integral", (low < F.lit(float("inf"))) & (high > F.lit(float("-inf")))).otherwise(F.col("_x").isNotNull()), F.lit(False))
    empty = defined & ((series & (high < low)) | ((kind == "Integral") & (low == high)))
    blocks = F.when(series & defined & ~empty, F.sequence(F.lit(0).cast("long"), F.floor((high - low) / BLOCK).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    # Terms without nodes keep one row, so that none is lost.
    rows = p.withColumn("_defined", defined).withColumn("_empty", empty).withColumn("block", F.explode(blocks))
    # A term's blocks and nodes are spread over tasks, as one expression may have very many.
    rows = rows.repartition(F.spark_partition_id() * 0 + F.pmod(F.xxhash64("text", "given", "n", "block"), F.lit(1 << 20)))
    rows = rows.withColumn("node", F.explode_outer(F.when(F.col("_defined") & ~F.col("_empty"), _nodes(low, high, F.col("_x")))))
    rows = rows.withColumn("_env", F.when(F.col("node").isNotNull(), F.map_concat("inputs", F.create_map(var, F.col("node.x").cast("string")))))
    rows = values(rows, "body", "_env", depth, "v")
    ok, w = F.col("v.status") == "evaluated", F.col("node.w")
    key = ["text", "given", "n"]
    size = F.sqrt(F.col("v.re") * F.col("v.re") + F.col("v.im") * F.col("v.im"))
    sums = rows.groupBy(*key, kind.alias("kind"), "_defined", "_empty", F.col("node.level").alias("level")).agg(
        F.sum(w * F.col("v.re")).alias("re"), F.sum(w * F.col("v.im")).alias("im"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("all"),
        F.bool_and(F.coalesce(F.col("v.im") == 0, F.lit(True))).alias("real"), F.product(F.col("v.re")).alias("times"), F.product(size).alias("size"), F.sum(F.atan2("v.im", "v.re")).alias("angle"),
    )
    level = F.when(F.col("all"), F.struct("level", "re", "im", "real", "times", "size", "angle"))
    one = sums.groupBy(*key, "kind", "_defined", "_empty").agg(F.array_sort(F.collect_list(level)).alias("l"))
    l = lambda i: F.get(F.col("l"), F.lit(i))  # noqa: E731, E741
    # Coarse nodes have weights for a step half as wide, so that the coarse value is twice their sum.
    fine = F.struct((l(0)["re"] + l(1)["re"]).alias("re"), (l(0)["im"] + l(1)["im"]).alias("im"))
    near = lambda a, b, x, y: F.greatest(F.abs(a - b), F.abs(x - y)) / F.greatest(F.lit(1.0), F.abs(b), F.abs(y))
    off = near(l(0)["re"] * 2, fine["re"], l(0)["im"] * 2, fine["im"])
    integral = F.when((F.size("l") == 2) & (off < AGREE["Integral"]), _text(fine["re"], fine["im"]))
    pairs = F.transform(F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.struct(near(F.get("l", i)["re"], F.get("l", i + 1)["re"], F.get("l", i)["im"], F.get("l", i + 1)["im"]).alias("off"), F.get("l", i + 1).alias("at")))
    best = F.array_min(F.when(F.size("l") > 1, pairs))
    slope = F.when(best["off"] < AGREE["Derivative"], _text(best["at"]["re"], best["at"]["im"]))
    product = F.when(l(0)["real"], l(0)["times"].cast("string")).otherwise(_text(l(0)["size"] * F.cos(l(0)["angle"]), l(0)["size"] * F.sin(l(0)["angle"])))
    value = F.when(F.col("_empty"), F.when(F.col("kind") == "Product", "1").otherwise("0")).when(
        F.col("_defined"), F.when(F.col("kind") == "Integral", integral).when(F.col("kind") == "Derivative", slope).when(F.col("kind") == "Product", product).otherwise(_text(l(0)["re"], l(0)["im"]))
    )
    return one.select(*key, value.alias("value"))


def _solved(pairs: DataFrame, depth: int) -> DataFrame:
    """pairs(text, given), distinct; given is the inputs as JSON. With `v`, as evaluate() gives it."""
    read = pairs.withColumn("inputs", F.from_json("given", "map<string,string>")).withColumn("cut", _cut(F.col("text")))
    parts = read.select("text", "given", "inputs", F.posexplode("cut.parts").alias("n", "part")).select("text", "given", "inputs", "n", "part.*")
    term = F.struct(F.concat(F.lit("c"), F.col("n").cast("string"), F.lit("_")), F.col("value"))
    found = _terms(parts, depth).groupBy("text", "given").agg(F.collect_list(F.when(F.col("value").isNotNull(), term)).alias("terms"), F.count("*").alias("n"))
    both = read.join(found, ["text", "given"], "left")
    held = F.map_concat("inputs", F.coalesce(F.map_from_entries("terms"), F.create_map().cast("map<string,string>")))
    # Unread text is a parse error like any other. A term without value leaves its name unbound: undefined.
    return both.select("text", "given", evaluate(F.coalesce("cut.text", F.lit("?")), held).alias("v"))


def values(rows: DataFrame, text: str, inputs: str, depth: int = 2, result: str = "v") -> DataFrame:
    """rows with column `result`: the value of expression column `text` at map column `inputs`, as evaluate() gives it, calculus terms included.

    Terms may be nested `depth` deep. Calculus in bounds, antiderivatives without bounds and differential equations are parse errors. undefined are: deeper terms and unreadable bodies, terms with
    bounds that aren't real (for sums: whole), infinite sums, and integrals and derivatives whose two estimates differ by more than AGREE. A sum over no terms is
    0, a product 1. Derivatives are symmetric ones: that of Abs(x) is 0 at 0. Null texts are empty; null inputs are left out, as are all where the map is null. Rows that repeat an expression and its inputs share its nodes.
    """
    if depth == 0:
        return rows.withColumn(result, evaluate(F.col(text), F.col(inputs)))
    nested = has_calculus(F.col(text))
    plain = rows.where(~nested).withColumn(result, evaluate(F.col(text), F.col(inputs)))
    given = F.coalesce(F.to_json(F.map_filter(inputs, lambda k, v: v.isNotNull())), F.lit("{}"))
    keyed = rows.where(nested).select(F.col(text).alias("text"), given.alias("given"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    solved = _solved(keyed.select("text", "given").distinct(), depth - 1)
    return plain.union(keyed.join(solved, ["text", "given"]).select("row.*", F.col("v").alias(result)))
