r"""Matrices of whole numbers as columns of array<array<bigint>>, in exact arithmetic, and problems made of them.

Elimination is fraction-free, so that every quotient is whole. Any size works as long as its minors' products fit a long; beyond, the job stops with an overflow error
rather than give a wrong number. Rational entries are handled over their common denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.generators import hashed, kept, spread

#: The common denominator of rational entries, whose own denominators are 2, 3 and 4.
UNIT = 12
SIZES = (2, 2, 3, 3, 4)
KINDS = ("det", "trace", "inverse", "charpoly", "norm", "discriminant")
LIMIT = 1e6
_NAME = "matrices"


def _each(m: Column, entry) -> Column:
    """The matrix of entry(value, row, column)."""
    return F.transform(m, lambda row, i: F.transform(row, lambda v, j: entry(v, i, j)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def determinant(m: Column) -> Column:
    """Of a square matrix; null for a null one, 1 for one without rows.

    Column by column, with the first row that isn't zero there as pivot; a column without one makes it 0.
    """
    whole = lambda a, b: F.call_function("div", a, b)

    def swap(s: Column, k: Column) -> Column:
        rows = s["m"]
        found = F.array_min(F.filter(F.transform(rows, lambda row, i: F.when((i >= k) & (F.get(row, k) != 0), i)), lambda i: i.isNotNull()))
        return F.struct(rows.alias("m"), s["before"].alias("before"), s["sign"].alias("sign"), F.coalesce(found, F.lit(-1)).alias("at"), s["top"].alias("top"))

    def take(s: Column, k: Column) -> Column:
        rows, at = s["m"], s["at"]
        swapped = F.when(at <= k, rows).otherwise(F.transform(rows, lambda row, i: F.when(i == k, F.get(rows, at)).when(i == at, F.get(rows, k)).otherwise(row)))
        sign = F.when(at < 0, 0).when(at == k, s["sign"]).otherwise(-s["sign"])
        return F.struct(swapped.alias("m"), s["before"].alias("before"), sign.alias("sign"), at.alias("at"), F.get(rows, F.greatest(at, F.lit(0))).alias("top"))

    def clear(s: Column, k: Column) -> Column:
        rows, before, top = s["m"], s["before"], s["top"]
        pivot = F.get(top, k)
        less = F.transform(rows, lambda row, i: F.when(i > k, F.transform(row, lambda v, j: whole(v * pivot - F.get(row, k) * F.get(top, j), before))).otherwise(row))
        return F.struct(less.alias("m"), pivot.alias("before"), s["sign"].alias("sign"), s["at"].alias("at"), top.alias("top"))

    # Each step of the fold does one of the three, so that the next reads a value and not an expression written out wherever it is used.
    def step(s: Column, n: Column) -> Column:
        k, part = F.call_function("div", n, F.lit(3)).cast("int"), n % 3
        return F.when(s["sign"] == 0, s).when(part == 0, swap(s, k)).when(part == 1, take(s, k)).otherwise(clear(s, k))

    one, none = F.lit(1).cast("long"), F.array().cast("array<bigint>")
    start = F.struct(m.alias("m"), one.alias("before"), F.lit(1).alias("sign"), F.lit(0).alias("at"), none.alias("top"))
    steps = F.when(F.size(m) > 0, F.sequence(F.lit(0), 3 * F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(m.isNotNull(), F.aggregate(steps, start, step, lambda s: F.when(s["sign"] == 0, F.lit(0).cast("long")).otherwise(s["sign"] * s["before"])))


def cofactor(m: Column, i: Column, j: Column) -> Column:
    """Of row i and column j, counted from 0. The inverse's entry (i, j) is cofactor(m, j, i) / determinant(m)."""
    rows = F.filter(m, lambda row, r: r != i)
    minor = F.transform(rows, lambda row: F.filter(row, lambda v, c: c != j))
    return F.when((i + j) % 2 == 0, determinant(minor)).otherwise(-determinant(minor))


def _times(a: Column, b: Column) -> Column:
    return F.transform(a, lambda row: F.transform(F.get(b, F.lit(0)), lambda _, j: _sum(F.transform(row, lambda v, k: v * F.get(F.get(b, k), j)))))


def trace(m: Column) -> Column:
    return _sum(F.transform(m, lambda row, i: F.get(row, i)))


def characteristic(m: Column) -> Column:
    """Coefficients of det(x I - m), from the highest power down, by traces of powers: each next matrix is m times (the one before plus its coefficient)."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(s: Column, k: Column) -> Column:
        last = F.element_at(s["c"], -1)
        n = _times(m, _each(s["m"], lambda v, i, j: v + F.when(i == j, last).otherwise(zero)))
        return F.struct(n.alias("m"), F.concat(s["c"], F.array(-F.call_function("div", trace(n), k))).alias("c"))

    start = F.struct(_each(m, lambda v, i, j: v * 0).alias("m"), F.array(one).alias("c"))
    return F.aggregate(F.sequence(one, F.size(m).cast("long")), start, step, lambda s: s["c"])


def value_at(coefficients: Column, x: Column) -> Column:
    """Of a polynomial, coefficients from the highest power down."""
    return F.aggregate(coefficients, F.lit(0).cast("long"), lambda s, c: s * x + c)


def resultant(p: Column, q: Column) -> Column:
    """Of two polynomials, coefficients from the highest power down, as the determinant of their Sylvester matrix."""
    m, n = F.size(p) - 1, F.size(q) - 1
    zero = F.lit(0).cast("long")
    spread = lambda c, times: F.transform(F.sequence(F.lit(0), times - 1), lambda i: F.transform(F.sequence(F.lit(0), m + n - 1), lambda j: F.coalesce(F.when(j >= i, F.get(c, j - i)), zero)))
    none = F.array().cast("array<array<bigint>>")
    return determinant(F.concat(F.when(n > 0, spread(p, n)).otherwise(none), F.when(m > 0, spread(q, m)).otherwise(none)))


def discriminant(p: Column) -> Column:
    """Of a polynomial of degree 1 or more, whose first coefficient isn't 0."""
    n = F.size(p) - 1
    slope = F.transform(F.slice(p, F.lit(1), n), lambda c, i: c * (n - i))
    return F.when((n * (n - 1) / 2) % 2 == 0, F.lit(1)).otherwise(F.lit(-1)) * F.call_function("div", resultant(p, slope), F.get(p, F.lit(0)))


def _entry(v: Column) -> Column:
    """LaTeX of v / UNIT, reduced."""
    by = F.get(F.filter(F.array(*[F.lit(d).cast("long") for d in range(UNIT, 0, -1) if UNIT % d == 0]), lambda d: v % d == 0), F.lit(0))
    up, down = F.call_function("div", v, by), F.call_function("div", F.lit(UNIT).cast("long"), by)
    return F.when(down == 1, up.cast("string")).otherwise(F.concat(F.when(v < 0, "-").otherwise(""), F.lit(r"\frac{"), F.abs(up).cast("string"), F.lit("}{"), down.cast("string"), F.lit("}")))


def objects(keys: DataFrame, seed: str = "0") -> DataFrame:
    """keys(i) with kind, size, m (entries times UNIT), row and column (of an inverse's entry), lambda; each a pure function of seed and i."""
    i, draw = F.col("i"), lambda what, low, high: hashed(seed, _NAME, what, F.col("i"), low, high)
    df = spread(keys.select(i.cast("long").alias("i")))
    df = df.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), draw("kind", 1, len(KINDS)))).withColumn("size", F.element_at(F.array(*map(F.lit, SIZES)), draw("size", 1, len(SIZES))))
    df = df.withColumn("rational", (draw("rational", 1, 5) <= 2) & (F.col("kind") != "discriminant") & ~((F.col("kind") == "inverse") & (F.col("size") == 4)))
    places = F.sequence(F.lit(0), F.col("size") - 1)

    def entry(r: Column, c: Column) -> Column:
        at = F.concat_ws(":", i, r, c)
        cell = lambda what, low, high: hashed(seed, _NAME, what, at, low, high)
        part = cell("up", -4, 4) * F.call_function("div", F.lit(UNIT), cell("down", 2, 4))
        return F.when(F.col("rational") & (cell("part", 0, 1) == 0), part).otherwise(cell("whole", -6, 6) * UNIT).cast("long")

    at = lambda what: F.pmod(draw(what, 0, 11), F.col("size"))
    m = F.transform(places, lambda r: F.transform(places, lambda c: entry(r, c)))
    return kept(df.select("i", "kind", "size", m.alias("m"), at("row").alias("row"), at("column").alias("column"), draw("lambda", 0, 2).cast("long").alias("lambda")))


def generate(keys: DataFrame, seed: str = "0") -> DataFrame:
    """(task_id, slice, kind, size, latex, expected) of keys(i): determinants, traces, entries of inverses, characteristic polynomials at a number, norms, discriminants.

    A discriminant is that of the cubic whose coefficients, over UNIT, open the matrix's rows: a + 7, b from its first, c, d from its second. Keys whose value is 0 for a determinant, undefined or
    beyond LIMIT give no row.
    """
    df = kept(objects(keys, seed).withColumn("det", determinant(F.col("m"))))
    m, n, unit = F.col("m"), F.col("size"), F.lit(float(UNIT))
    det = F.col("det")
    cell = lambda r, c: F.call_function("div", F.get(F.get(m, F.lit(r)), F.lit(c)), F.lit(UNIT).cast("long"))
    cubic = F.array(cell(0, 0) + 7, cell(0, 1), cell(1, 0), cell(1, 1))
    value = {
        "det": F.when(det != 0, det / F.pow(unit, n)), "trace": trace(m) / unit, "inverse": F.when(det != 0, unit * cofactor(m, F.col("column"), F.col("row")) / det),
        "charpoly": value_at(characteristic(m), F.col("lambda") * UNIT) / F.pow(unit, n), "norm": _sum(F.flatten(_each(m, lambda v, i, j: v * v))) / (unit * unit), "discriminant": discriminant(cubic).cast("double"),
    }
    text = F.concat(F.lit(r"\begin{pmatrix}"), F.array_join(F.transform(m, lambda row: F.array_join(F.transform(row, _entry), " & ")), r" \\ "), F.lit(r"\end{pmatrix}"))
    number = lambda c: c.cast("string")
    said = {
        "det": (r"\det\left(", text, r"\right)"), "trace": (r"\operatorname{tr}\left(", text, r"\right)"), "norm": (r"\left\Vert ", text, r" \right\Vert_{F}^{2}"),
        "inverse": (r"\left(", text, r"\right)^{-1}_{", number(F.col("row") + 1), ",", number(F.col("column") + 1), "}"), "charpoly": (r"\operatorname{charpoly}\left(", text, r"\right)\left(", number(F.col("lambda")), r"\right)"),
        "discriminant": (r"\operatorname{disc}\left(", *[x for k, p in enumerate(("x^3 + ", "x^2 + ", "x + ", "")) for x in ("(", number(F.get(cubic, F.lit(k))), ")" + p)], r"\right)"),
    }
    latex, expected = F.lit(None), F.lit(None).cast("double")
    for kind in KINDS:
        latex = F.when(F.col("kind") == kind, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said[kind]])).otherwise(latex)
        expected = F.when(F.col("kind") == kind, value[kind]).otherwise(expected)
    made = df.select(F.concat(F.lit("matrix_"), "i").alias("task_id"), F.lit("matrix").alias("slice"), "kind", "size", latex.alias("latex"), expected.alias("expected"))
    return kept(made).where(F.abs("expected") <= LIMIT)
