r"""Checks of a family's truths against the problems they claim to solve, as columns.

A derivative's truth must agree with central differences of the function in the problem's text, an integral's truth must have the integrand as its derivative,
a differential equation's truth must leave no residual, a sum's or product's closed form must equal a walk over its terms. Derivatives are central differences at
two steps, of which the error's first term is taken out. What is checked comes from the problem's text, read as a tree, not from the truth.
"""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import generators as g
from millrace.operators import trees

STEP, TOLERANCE = 1e-3, 1e-5


def plain(node: trees.Tree) -> trees.Tree:
    """The reader's names as SQL knows them."""

    class Rename(ast.NodeTransformer):
        def visit_Name(self, n: ast.Name) -> ast.expr:  # noqa: N802
            return ast.Constant(math.e) if n.id == "E" else ast.Call(ast.Name("pi"), [], []) if n.id == "pi" else n

        def visit_Call(self, n: ast.Call) -> ast.expr:  # noqa: N802
            args = [self.visit(a) for a in n.args]
            if n.func.id == "log":
                logs = [ast.Call(ast.Name("ln"), [a], []) for a in args]
                return logs[0] if len(logs) == 1 else ast.BinOp(logs[0], ast.Div(), logs[1])
            return ast.Call(ast.Name({"Abs": "abs", "ceiling": "ceil"}.get(n.func.id, n.func.id)), args, [])

    return Rename().visit(node)


def moved(node: trees.Tree, by: float) -> str:
    return trees.sql(trees.put(node, x=trees.parse(f"(x + {by!r})")))


def slope(node: trees.Tree) -> str:
    """SQL of d/dx."""
    d = lambda h: f"(({moved(node, h)}) - ({moved(node, -h)})) / {2 * h!r}D"
    return f"((4.0D * {d(STEP / 2)} - {d(STEP)}) / 3.0D)"


def curvature(node: trees.Tree) -> str:
    """SQL of the second derivative."""
    d = lambda h: f"(({moved(node, h)}) - 2.0D * ({trees.sql(node)}) + ({moved(node, -h)})) / {h * h!r}D"
    return f"((4.0D * {d(4 * STEP)} - {d(8 * STEP)}) / 3.0D)"


def sides(name: str, t: g.Template, planted: trees.Tree | None = None) -> tuple[str, str, list[str]] | None:
    """SQL of two values that must agree and of the sizes that set the scale; None for templates whose text says nothing to check.

    planted: a tree over `truth` that stands in for the truth, to see that the check finds it.
    """
    truth = g.tree(name, t)
    truth = truth if planted is None else trees.put(planted, truth=truth)
    read = lambda text: (found := trees.reading(text)) and plain(found)
    try:
        if m := re.fullmatch(r"\\frac\{d\}\{dx\} (.*)", t.latex):
            f = read(m[1])
            return f and (slope(f), trees.sql(truth), [])
        if m := re.fullmatch(r"\\int_0\^\{x\} (.*) dt", t.latex):
            f = read(m[1])
            return f and (slope(truth), trees.sql(trees.put(f, t=ast.Name("x"))), [trees.sql(truth)])
        if m := re.fullmatch(r"\\(sum|prod)_\{k=(\d)\}\^\{<([a-z])>\} (.*)", t.latex):
            f = read(m[4])
            walk = f and trees.parse(f"{m[1]}({ast.unparse(f)} for k in range({m[2]}, {m[3]} + 1))")
            return walk and (trees.sql(walk), trees.sql(truth), [])
        if m := re.match(r"([^,=]*y'[^,=]*) = ([^,=]*)", t.latex):
            left, right = (read(re.sub(r"y'", "p", re.sub(r"y''", "q", x))) for x in m.groups())
            if left is None or right is None:
                return None
            put = {"p": slope(truth), "q": curvature(truth), "y": trees.sql(truth)}
            said = lambda node: re.sub(r"\b[pqy]\b", lambda m: f"({put[m[0]]})", trees.sql(node))
            used = trees.names(left) | {"y"}
            return said(left), said(right), [put[k] for k in put if k in used]
    except trees.Unprintable:
        pass
    return None


def holds(name: str, f: g.Family, planted: trees.Tree | None = None) -> Column:
    """Whether the truth of a row of sampled() passes its template's check; null for templates without one."""

    def test(t: g.Template) -> str:
        found = sides(name, t, planted)
        if found is None:
            return "CAST(NULL AS BOOLEAN)"
        l, r, sizes = found
        return f"coalesce(abs(({l}) - ({r})) <= {TOLERANCE}D * greatest(1.0D, {', '.join(f'abs({x})' for x in (l, r, *sizes))}), false)"

    return F.expr(g.case_of(f, test))


def checkable(name: str, f: g.Family) -> list[str]:
    """The kinds whose truths can be checked."""
    return [t.kind for t in f.templates if sides(name, t) is not None]


def checked(keys: DataFrame, name: str, seed: str = "0", planted: str | None = None, **columns: Column) -> DataFrame:
    """(i, kind, case_index, x, y, ok) of a family's sampled cases, where the template can be checked.

    planted: an expression over `truth`, x, the parameters and `columns`, which takes the truth's place.
    """
    f = g.FAMILIES[name]
    df = g.sampled(g.objects(keys, name, f, seed), name, f, seed).withColumns(columns)
    some = [k for k, t in enumerate(f.templates) if t.kind in checkable(name, f)]
    df = df.where(F.col("_t").isin(some))
    ok = holds(name, f, None if planted is None else trees.parse(planted))
    return df.select("i", F.expr(g.case_of(f, lambda t: f"'{t.kind}'")).alias("kind"), "case_index", "x", "y", ok.alias("ok"))
