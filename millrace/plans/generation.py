"""One query a family of generated problems, over the part keys, and its SQL made from the same templates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import latex
from millrace.functions.expressions import evaluate
from millrace.operators import gates, matrices, trees, user_families
from millrace.operators import generators as g
from millrace.plans.tables import table

SEED = "11"


def rounded(value: Column, digits: int = 5) -> Column:
    """value rounded as SQL engines do doubles, half away from zero after scaling; Spark's round() goes by the shortest decimal text, which decides ties otherwise."""
    scaled = F.abs(value) * F.lit(10.0**digits)
    whole = F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)
    return F.when(value < 0, -whole.cast("double")).otherwise(whole.cast("double")) / F.lit(10.0**digits)


def family(spark: SparkSession, sf_dir: str, name: str | tuple[str, g.Family]) -> DataFrame:
    """Rounded, as engines differ in the last digits of transcendental functions."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    df = g.generate(keys, name, SEED, include_gated=True)
    return df.select("task_id", "kind", "latex", "case_index", "x", "y", rounded(F.col("expected")).alias("expected"), rounded(F.col("expected_im")).alias("expected_im"))


def generated_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families' pool as problems with nested cases: how many of each slice."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    df = g.problems(g.generate(keys, "geometry", SEED).union(g.generate(keys, "sequences", SEED)))
    return df.groupBy("slice").agg(F.count("*").alias("n_problems"), F.sum(F.size("test_cases")).alias("n_cases"))


def drawn(p: str, of: str, domain: tuple[int, int] | g.Log, name: str) -> str:
    """SQL of a draw."""
    whole = lambda tag, low, high: f"({low} + CAST(CAST('0x' || substr(md5('{SEED}:{name}:{tag}:' || {of}), 1, 8) AS BIGINT) % {high - low + 1} AS INT))"
    if isinstance(domain, tuple):
        return f"{whole(p, *domain)} / 10.0::DOUBLE" if p in g.POINTS else whole(p, *domain)
    scales = ", ".join(f"1e{e}" for e in range(domain.low, domain.high + 1))
    sign = whole(f"{p}-sign", 0, 1)
    return f"(CASE {sign} WHEN 0 THEN -1.0 ELSE 1.0 END)::DOUBLE * ({whole(f'{p}-size', 100, 999)} / 100.0::DOUBLE) * ([{scales}])[{whole(f'{p}-scale', 1, domain.high - domain.low + 1)}]"


def sampled_sql(family: str | tuple[str, g.Family], keys: str, key: str) -> str:
    """CTEs up to `cases`: each key's template, parameters and accepted points, each attempt a row and its rank the case."""
    name, f = g.family_of(family, True)
    ranges, points = g.PARAMETERS | f.ranges, g.POINTS | f.ranges
    case = lambda what: "CASE t " + " ".join(f"WHEN {k} THEN {what(t)}" for k, t in enumerate(f.templates)) + " END"
    plain = lambda s: s.replace("0D", "0")
    tried = lambda n, rows: f"""
  SELECT *, CAST({case(lambda t: t.other or plain(t.truth))} AS DOUBLE) AS expected, CAST({case(lambda t: t.other_imaginary or plain(t.imaginary))} AS DOUBLE) AS expected_im, {case(lambda t: g.near_pole(name, f, t, False))} AS near
  FROM (SELECT p.*, r.k, {', '.join(f"{drawn(v, "i || ':' || r.k", points[v], name)} AS {v}" for v in g.POINTS)} FROM {rows} p, range({n}) r(k)) d"""  # noqa: E731
    good = f"NOT near AND abs(expected) <= {g.LIMIT} AND abs(expected_im) <= {g.LIMIT}"
    return f"""
p AS (SELECT {key} AS i, {key} % {len(f.templates)} AS t, {', '.join(f"{drawn(p, key, ranges[p], name)} AS {p}" for p in g.PARAMETERS)} FROM {keys}),
few AS MATERIALIZED ({tried(g.FIRST_ATTEMPTS, 'p')}),
short AS (SELECT p.* FROM p WHERE (SELECT count(*) FROM few WHERE few.i = p.i AND {good}) < {g.CASES}),
tries AS MATERIALIZED (SELECT * FROM few WHERE i NOT IN (SELECT i FROM short) UNION ALL {tried(g.ATTEMPTS, 'short')}),
cases AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY k) - 1 AS INT) AS case_index, {case(lambda t: f"'{t.kind}'")} AS kind FROM tries WHERE {good}) q WHERE case_index < {g.CASES})"""


def texts_sql(family: str | tuple[str, g.Family]) -> str:
    """CTE `texts`: the distinct notations of each problem, numbered."""
    name, f = g.family_of(family, True)
    tagged = lambda x: x.replace("CASE _t", "CASE t")
    return f"""
every AS (SELECT p.*, v, CASE v WHEN 0 THEN {tagged(g.standard(f, 'sql'))} ELSE {tagged(g.notations(f, 'sql', 'style'))} END AS latex
  FROM (SELECT p.*, v, md5('{SEED}:{name}:style:' || i || ':' || v) AS style FROM p, range({g.VARIANTS}) w(v)) p),
texts AS (SELECT i, latex, CAST(row_number() OVER (PARTITION BY i ORDER BY min(v)) - 1 AS INT) AS variant FROM every GROUP BY i, latex)"""


def sql(family: str | tuple[str, g.Family], keys: str = "part", key: str = "p_partkey") -> str:
    """The rows of family() in SQL."""
    name, _ = g.family_of(family, True)
    return f"""
WITH {sampled_sql(family, keys, key)}, {texts_sql(family)}
SELECT '{name}_' || c.i || ':v' || variant AS task_id, kind, latex, case_index, x, y, round(expected, 5) AS expected, round(expected_im, 5) AS expected_im
FROM cases c JOIN texts USING (i)"""


#: What sampling has to cope with: poles within the range, truths defined on a part of it, magnitudes of all scales, a problem with hardly a point and one without any.
SAMPLING = ("sampling", g.Family("sampling", [
    g.Template("pole", r"\frac{<a> x + 1}{x - <b>}", "(a * x + 1) / (x - b)"),
    g.Template("two_poles", r"\frac{<a>}{x^2 - <m>}", "a / (x * x - m)"),
    g.Template("root", r"\sqrt{x - <a>}", "sqrt(x - a)", other="CASE WHEN x >= a THEN sqrt(x - a) END"),
    g.Template("magnitude", r"<a> y^2 + x", "a * y * y + x"),
    g.Template("rare", r"\sqrt{x - 4.2 - <n> / 10}", "sqrt(x - 4.2D - n / 10.0D)", other="CASE WHEN x::DOUBLE - 4.2::DOUBLE - n / 10.0::DOUBLE >= 0 THEN sqrt(x::DOUBLE - 4.2::DOUBLE - n / 10.0::DOUBLE) END"),
    g.Template("never", r"\sqrt{-1 - x^2}", "sqrt(-1.0D - x * x)", other="CAST(NULL AS DOUBLE)"),
], {"x": (-50, 50), "y": g.Log(-3, 6)}))
#: Families of which some texts are one formula, which the LaTeX reader can evaluate.
READABLE = ("functions", "elementary_ext", "multivariate", "edge", "geometry")


def read_kinds(name: str) -> list[str]:
    return [t.kind for t in g.FAMILIES[name].templates if t.imaginary == "0.0D" and trees.written(t.latex)[1] is not None and trees.ways(trees.written(t.latex)[0]) > 1]


def notation_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notation of a formula, read back and evaluated at the first point: how many there are, how many give the truth."""
    keys, out = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")), None
    for name in READABLE:
        df = g.generate(keys, name, SEED).where((F.col("case_index") == 0) & F.col("kind").isin(read_kinds(name))).withColumn("family", F.lit(name))
        out = df if out is None else out.union(df)
    e = evaluate(latex.expression(F.col("latex")), F.create_map(F.lit("x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string")))
    out = out.withColumn("e", e)
    agrees = (F.col("e.status") == "evaluated") & (F.abs(F.col("e.re") - F.col("expected")) <= 1e-8 * F.greatest(F.lit(1.0), F.abs("expected"))) & (F.abs("e.im") <= 1e-8)
    return out.groupBy("family", "kind").agg(F.count("*").alias("n_notations"), F.count_if(agrees).alias("n_agree"))


#: Checked families, and what stands in for every fifth problem's truth.
CHECKED, PLANTED = ("derivative", "integration", "ode", "differential_c1", "summation"), "truth + bad * (0.01 * x * x * truth + 0.01 * x)"
#: Where the truth itself is compared, the parts of the fault have one sign: they would cancel at x * truth = -1.
PLANTED_IN_VALUE = "truth + bad * (0.01 * x * x * truth + 0.01 * (x if truth >= 0 else -x))"


def gated_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each case's truth passes the check of its kind, wrong truths planted in every fifth problem."""
    keys, out = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")), None
    for name in CHECKED:
        df = gates.checked(keys, name, SEED, PLANTED_IN_VALUE if name in ("derivative", "summation") else PLANTED, bad=F.when(F.col("i") % 5 == 0, 1.0).otherwise(0.0)).select(F.lit(name).alias("family"), "i", "kind", "case_index", "ok")
        out = df if out is None else out.union(df)
    return out


class Collatz:
    """How many steps it takes from a number to 1; with `peaks`, the largest number on the way too."""

    def __init__(self, peaks: bool) -> None:
        self.peaks = peaks

    def columns(self, seed: str) -> T.StructType:
        kinds = {"task_id": T.StringType(), "latex": T.StringType(), "start": T.LongType(), "steps": T.IntegerType()} | ({"peak": T.LongType()} if self.peaks else {})
        return T.StructType([T.StructField(c, k) for c, k in kinds.items()])

    def rows(self, i: int, seed: str) -> Iterator[tuple]:
        n = top = start = i + int(seed)
        steps = 0
        while n > 1:
            n, steps = (3 * n + 1 if n % 2 else n // 2), steps + 1
            top = max(top, n)
        yield (f"collatz_{i}", rf"\min\{{k : T^k({start}) = 1\}}", start, steps, *([top] if self.peaks else []))


def user_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's family over the part keys, by lateral join."""
    user_families.register(spark, "collatz", Collatz(True))
    return user_families.generate(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")), "collatz", SEED)


def matrix_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scalars of matrices up to 4 by 4, whole and rational, over the part keys."""
    made = matrices.generate(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")), SEED)
    return made.select("task_id", "kind", "size", "latex", F.round("expected", 5).alias("expected"))


def _leibniz(cell: str) -> str:
    """SQL of a 4 by 4 determinant as the sum over permutations; cell has {r} and {c}."""
    sign = lambda p: "-" if sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2 else "+"
    return " ".join(f"{sign(p)} {' * '.join(cell.format(r=r, c=c) for r, c in enumerate(p))}" for p in permutations(range(4)))


def _matrix_sql() -> str:
    """matrix_problems() by other routes: determinants as sums over permutations, of matrices filled up to 4 by 4 with ones on the diagonal, inverses by Cramer's rule, a cubic's discriminant by its formula."""
    md5 = lambda what, at: f"CAST('0x' || substr(md5('{SEED}:matrices:{what}:' || {at}), 1, 8) AS BIGINT)"
    whole = lambda what, low, high, at="i": f"({low} + CAST({md5(what, at)} % {high - low + 1} AS INT))"
    at = "i || ':' || r || ':' || c"
    entry = f"CASE WHEN rational AND {whole('part', 0, 1, at)} = 0 THEN {whole('up', -4, 4, at)} * (12 // {whole('down', 2, 4, at)}) ELSE {whole('whole', -6, 6, at)} * 12 END::BIGINT"
    filled = [f"CASE WHEN {max(r, c)} < size THEN m[{r + 1}][{c + 1}] ELSE {int(r == c)} END AS e{r}{c}" for r in range(4) for c in range(4)]
    text = "CASE WHEN v % 12 = 0 THEN CAST(v // 12 AS VARCHAR) ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || '\\frac{' || abs(v) // gcd(v, 12) || '}{' || 12 // gcd(v, 12) || '}' END"
    tied = "CASE WHEN {c} = rw THEN CASE WHEN {r} = cl THEN 1 ELSE 0 END ELSE e{r}{c} END"
    less = "CASE WHEN greatest({r}, {c}) < size THEN CASE WHEN {r} = {c} THEN lam * 12 ELSE 0 END - e{r}{c} ELSE e{r}{c} END"
    a, b, c, d = "e00 // 12 + 7", "e01 // 12", "e10 // 12", "e11 // 12"
    return rf"""
WITH p AS (SELECT p_partkey AS i, ['det', 'trace', 'inverse', 'charpoly', 'norm', 'discriminant'][{whole('kind', 1, 6, 'p_partkey')}] AS kind, CAST([2, 2, 3, 3, 4][{whole('size', 1, 5, 'p_partkey')}] AS INT) AS size FROM part),
q AS (SELECT *, {whole('rational', 1, 5)} <= 2 AND kind <> 'discriminant' AND NOT (kind = 'inverse' AND size = 4) AS rational, {whole('row', 0, 11)} % size AS rw, {whole('column', 0, 11)} % size AS cl, {whole('lambda', 0, 2)} AS lam FROM p),
w AS (SELECT *, list_transform(range(size), lambda r: list_transform(range(size), lambda c: {entry})) AS m FROM q),
e AS (SELECT *, {', '.join(filled)} FROM w),
f AS (SELECT *, {_leibniz('e{r}{c}')} AS det, '\begin{{pmatrix}}' || array_to_string(list_transform(m, lambda row: array_to_string(list_transform(row, lambda v: {text}), ' & ')), ' \\ ') || '\end{{pmatrix}}' AS said,
  {a} AS ca, {b} AS cb, {c} AS cc, {d} AS cd FROM e),
g AS (SELECT *, CASE kind WHEN 'det' THEN CASE WHEN det <> 0 THEN det / power(12.0::DOUBLE, size) END WHEN 'trace' THEN list_sum(list_transform(range(size), lambda k: m[k + 1][k + 1])) / 12.0::DOUBLE
    WHEN 'inverse' THEN CASE WHEN det <> 0 THEN 12.0::DOUBLE * ({_leibniz(tied)}) / det END WHEN 'charpoly' THEN ({_leibniz(less)}) / power(12.0::DOUBLE, size)
    WHEN 'norm' THEN list_sum(list_transform(flatten(m), lambda v: v * v)) / 144.0::DOUBLE ELSE cb * cb * cc * cc - 4 * ca * cc * cc * cc - 4 * cb * cb * cb * cd - 27 * ca * ca * cd * cd + 18 * ca * cb * cc * cd END AS expected,
  CASE kind WHEN 'det' THEN '\det\left(' || said || '\right)' WHEN 'trace' THEN '\operatorname{{tr}}\left(' || said || '\right)' WHEN 'inverse' THEN '\left(' || said || '\right)^{{-1}}_{{' || rw + 1 || ',' || cl + 1 || '}}'
    WHEN 'charpoly' THEN '\operatorname{{charpoly}}\left(' || said || '\right)\left(' || lam || '\right)' WHEN 'norm' THEN '\left\Vert ' || said || ' \right\Vert_{{F}}^{{2}}'
    ELSE '\operatorname{{disc}}\left((' || ca || ')x^3 + (' || cb || ')x^2 + (' || cc || ')x + (' || cd || ')\right)' END AS latex FROM f)
SELECT 'matrix_' || i AS task_id, kind, size, latex, round(expected, 5) AS expected FROM g WHERE abs(expected) <= 1e6"""


def _each(names: tuple[str, ...], what, keys: str = "supplier", key: str = "s_suppkey") -> str:
    """A union of what(name) over CTEs of each family."""
    return " UNION ALL ".join(f"SELECT * FROM (WITH {sampled_sql(n, keys, key)}, {texts_sql(n)} {what(n)}) f" for n in names)


def _kinds(kinds: list[str]) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


QUERIES = {f"family_{n}": partial(family, name=n) for n in g.FAMILIES} | {"generated_problems": generated_problems, "sampled_inputs": partial(family, name=SAMPLING), "notation_readback": notation_readback, "gated_truths": gated_truths, "user_family": user_family, "matrix_problems": matrix_problems}
ORACLES = {f"family_{n}": sql(n) for n in g.FAMILIES} | {
    "generated_problems": f"SELECT f AS slice, count(*) AS n_problems, CAST(sum(n) AS BIGINT) AS n_cases FROM ({_each(('geometry', 'sequences'), lambda n: f"SELECT '{n}' AS f, c.i, variant, count(*) AS n FROM cases c JOIN texts USING (i) GROUP BY c.i, variant")}) q GROUP BY f",
    "sampled_inputs": sql(SAMPLING),
    "matrix_problems": _matrix_sql(),
    "notation_readback": f"SELECT f AS family, kind, count(*) AS n_notations, count(*) AS n_agree FROM ({_each(READABLE, lambda n: f"SELECT '{n}' AS f, kind FROM cases c JOIN texts USING (i) WHERE case_index = 0 AND kind IN ({_kinds(read_kinds(n))})")}) q GROUP BY f, kind",
    "user_family": f"""WITH RECURSIVE walk(i, start, n, k, top) AS (
        SELECT p_partkey, p_partkey + {SEED}, p_partkey + {SEED}, 0, p_partkey + {SEED} FROM part
        UNION ALL SELECT i, start, m, k + 1, greatest(top, m) FROM (SELECT *, CASE WHEN n % 2 = 1 THEN 3 * n + 1 ELSE n // 2 END AS m FROM walk WHERE n > 1) s)
        SELECT i, 'collatz_' || i AS task_id, '\\min\\{{k : T^k(' || start || ') = 1\\}}' AS latex, start, CAST(max(k) AS INT) AS steps, max(top) AS peak FROM walk GROUP BY i, start""",
    "gated_truths": _each(CHECKED, lambda n: f"SELECT '{n}' AS family, i, kind, case_index, i % 5 <> 0 AS ok FROM cases WHERE kind IN ({_kinds(gates.checkable(n, g.FAMILIES[n]))})"),
}
