r"""Formulas as trees, built while a query is planned; printed as SQL, as Python and, with choices of notation, as LaTeX.

A tree is Python's own syntax tree of an expression, such as `a * x**n / (b*x + c)`. Nothing here runs over rows: the printers give SQL text or pieces of text,
from which Spark makes its column expressions.
"""

from __future__ import annotations

import ast
import copy
import math
import re
from dataclasses import dataclass

from millrace.functions import latex

Tree = ast.expr
PARAMETERS = ("a", "b", "c", "m", "n")
_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}
# Functions that SQL and the generators' Python name alike.
_SAME = {"sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "exp", "ln", "sqrt", "cbrt", "floor", "ceil", "abs", "power", "factorial", "least", "greatest", "pi"}


def parse(text: str) -> Tree:
    """The tree of an expression in Python's syntax; SQL arithmetic without CASE or lambdas has the same."""
    return ast.parse(re.sub(r"(?<=[0-9])D\b", "", text.strip()), mode="eval").body


class Unprintable(ValueError):
    """The target has no such operation."""


def sql(node: Tree, spark: bool = True, depth: int = 0) -> str:
    """SQL of Spark, or of DuckDB; numbers with a point are doubles in both."""
    p = lambda x: sql(x, spark, depth)
    match node:
        case ast.Constant(value=bool()):
            raise Unprintable("a truth value")
        case ast.Constant(value=int() as v):
            return str(v)
        case ast.Constant(value=float() as v):
            return f"{v!r}D" if spark else f"CAST({v!r} AS DOUBLE)"
        case ast.Name(id=name):
            return name
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return f"(-{p(x)})"
        case ast.BinOp(left=l, op=ast.Pow(), right=r):
            return f"power({p(l)}, {p(r)})"
        case ast.BinOp(left=l, op=ast.FloorDiv(), right=r):
            return f"({p(l)} {'div' if spark else '//'} {p(r)})"
        case ast.BinOp(left=l, op=ast.Div(), right=r) if spark:
            return f"try_divide({p(l)}, {p(r)})"
        case ast.BinOp(left=l, op=op, right=r) if type(op) in _SIGNS:
            return f"({p(l)} {_SIGNS[type(op)]} {p(r)})"
        case ast.IfExp(test=t, body=yes, orelse=no):
            return f"(CASE WHEN {p(t)} THEN {p(yes)} ELSE {p(no)} END)"
        case ast.BoolOp(op=op, values=values):
            return "(" + (" AND " if isinstance(op, ast.And) else " OR ").join(map(p, values)) + ")"
        case ast.Compare(left=l, ops=ops, comparators=right):
            sides = [l, *right]
            return "(" + " AND ".join(f"{p(sides[i])} {_COMPARE[type(o)]} {p(sides[i + 1])}" for i, o in enumerate(ops)) + ")"
        case ast.Subscript(value=ast.Tuple(elts=items), slice=at):
            return f"element_at(array({', '.join(map(p, items))}), CAST({p(at)} AS INT) + 1)" if spark else f"([{', '.join(map(p, items))}])[{p(at)} + 1]"
        case ast.Call(func=ast.Name(id=("sum" | "prod") as what), args=[ast.GeneratorExp(elt=body, generators=[ast.comprehension(target=ast.Name(id=k), iter=ast.Call(func=ast.Name(id="range"), args=[low, high]), ifs=ifs)])]):
            inner, none = sql(body, spark, depth + 1), "0" if what == "sum" else "1"
            if ifs:
                inner = f"CASE WHEN {' AND '.join(sql(i, spark, depth + 1) for i in ifs)} THEN {inner} ELSE {none} END"
            if not spark:
                return f"coalesce(CAST(list_{'sum' if what == 'sum' else 'product'}(list_transform(range({p(low)}, {p(high)}), lambda {k}: CAST({inner} AS DOUBLE))) AS DOUBLE), {none}.0)"
            total, sign = f"s{depth}", "+" if what == "sum" else "*"
            walk = f"aggregate(sequence({p(low)}, {p(high)} - 1), {none}.0D, ({total}, {k}) -> {total} {sign} CAST({inner} AS DOUBLE))"
            return f"(CASE WHEN {p(low)} < {p(high)} THEN {walk} ELSE {none}.0D END)"
        case ast.Call(func=ast.Name(id="gcd"), args=[l, r]):
            l, r, d = p(l), p(r), f"d{depth}"
            return f"array_max(filter(sequence(1, least({l}, {r})), {d} -> {l} % {d} = 0 AND {r} % {d} = 0))" if spark else f"gcd({l}, {r})"
        case ast.Call(func=ast.Name(id="factorial"), args=[n]):
            return f"CAST(factorial({p(n)}) AS DOUBLE)"
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _SAME:
            return f"{name}({', '.join(map(p, args))})"
    raise Unprintable(ast.unparse(node))


def parts(node: Tree) -> tuple[Tree, Tree]:
    """Real and imaginary part of a tree, which is complex only as complex(re, im)."""
    match node:
        case ast.Call(func=ast.Name(id="complex"), args=[re_, im]):
            return re_, im
    return node, ast.Constant(0.0)


def put(node: Tree, **values: Tree) -> Tree:
    """node with names replaced by trees."""

    class Put(ast.NodeTransformer):
        def visit_Name(self, n: ast.Name) -> ast.expr:  # noqa: N802
            return copy.deepcopy(values[n.id]) if n.id in values else n  # never one object in two places

    return Put().visit(copy.deepcopy(node))


def names(node: Tree) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


def python(node: Tree) -> str:
    """Python's text, parameters as <a>."""
    return ast.unparse(put(node, **{p: ast.Name(f"<{p}>") for p in PARAMETERS}))


def _binary(l: Tree, op: ast.operator, r: Tree) -> Tree:
    """An operation on coefficients; one on zeros is left out, so that a degree shows."""
    zero = [isinstance(s, ast.Constant) and s.value == 0 for s in (l, r)]
    if isinstance(op, ast.Mult | ast.Div):
        return ast.Constant(0.0) if zero[0] or (zero[1] and isinstance(op, ast.Mult)) else ast.BinOp(l, op, r)
    if zero[1]:
        return l
    return (r if isinstance(op, ast.Add) else ast.UnaryOp(ast.USub(), r)) if zero[0] else ast.BinOp(l, op, r)


def quadratic(node: Tree, x: str) -> list[Tree] | None:
    """[c0, c1, c2] of a polynomial in x of degree 2 at most, None if node isn't one."""
    none, zero = [ast.Constant(0.0)] * 3, ast.Constant(0.0)
    if x not in names(node):
        return [node, zero, zero]
    match node:
        case ast.Name():
            return [zero, ast.Constant(1.0), zero]
        case ast.UnaryOp(op=ast.USub(), operand=u):
            u = quadratic(u, x)
            return u and [_binary(zero, ast.Sub(), c) for c in u]
        case ast.BinOp(left=l, op=ast.Add() | ast.Sub() as op, right=r):
            l, r = quadratic(l, x), quadratic(r, x)
            return l and r and [_binary(p, op, q) for p, q in zip(l, r, strict=True)]
        case ast.BinOp(left=l, op=ast.Mult(), right=r) if x not in names(l) or x not in names(r):
            l, r = (l, r) if x not in names(l) else (r, l)
            r = quadratic(r, x)
            return r and [_binary(l, ast.Mult(), q) for q in r]
        case ast.BinOp(left=ast.Name(id=i), op=ast.Mult(), right=ast.Name(id=j)) if i == j == x:
            return [*none[:2], ast.Constant(1.0)]
        case ast.BinOp(left=ast.Name(id=i), op=ast.Pow(), right=ast.Constant(value=2)) if i == x:
            return [*none[:2], ast.Constant(1.0)]
        case ast.BinOp(left=l, op=ast.Div(), right=r) if x not in names(r):
            l = quadratic(l, x)
            return l and [_binary(q, ast.Div(), r) for q in l]
    return None


def _factors(node: Tree) -> list[Tree]:
    match node:
        case ast.BinOp(left=l, op=ast.Mult(), right=r):
            return _factors(l) + _factors(r)
        case ast.BinOp(left=l, op=ast.Pow()):
            return _factors(l)
        case ast.Call(func=ast.Name(id="power"), args=[l, _]) | ast.Call(func=ast.Name(id="sqrt"), args=[l]):
            return _factors(l)
    return [node]


def poles(node: Tree, x: str) -> list[list[Tree]]:
    """[c0, c1, c2] of each factor of a denominator in node that is such a polynomial in x: its real roots are poles."""
    found = {}
    for n in ast.walk(node):
        below = n.right if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Div) else None
        for f in _factors(below) if below is not None else []:
            q = quadratic(f, x)
            if q and x in names(f):
                found.setdefault(ast.unparse(f), q)
    return list(found.values())


def near_pole(node: Tree, x: str, margin: float, spark: bool = True) -> str:
    """SQL: whether x is within margin of a pole of node."""
    tests = []
    d = lambda v: f"{v!r}D" if spark else f"CAST({v!r} AS DOUBLE)"
    for q in poles(node, x):
        c0, c1, c2 = (sql(c, spark) for c in q)
        if isinstance(q[2], ast.Constant) and q[2].value == 0:
            tests.append(f"({c1} <> 0 AND abs({x} + {c0} * {d(1.0)} / CASE WHEN {c1} = 0 THEN 1 ELSE {c1} END) < {d(margin)})")
        else:
            inside = f"({c1} * {c1} - {d(4.0)} * {c2} * {c0})"
            root = f"sqrt(CASE WHEN {inside} < 0 THEN 0 ELSE {inside} END)"
            tests += [f"({inside} >= 0 AND {c2} <> 0 AND abs({x} - (-{c1} {sign} {root}) / ({d(2.0)} * CASE WHEN {c2} = 0 THEN 1 ELSE {c2} END)) < {d(margin)})" for sign in "+-"]
    return " OR ".join(tests) or "false"


# LaTeX


@dataclass(frozen=True)
class Choice:
    """One of some ways to write a thing: `number` says which hexadecimal digit of a row's style decides, each option has the digit below which it is taken."""

    number: int
    options: tuple[tuple[str, tuple], ...]


Pieces = tuple  # of text, <parameter> and Choice


def reading(text: str) -> Tree | None:
    """The tree of a piece of a LaTeX template, None if it isn't a formula that the reader knows."""
    plain = latex.read(re.sub(r"<([abcmn])>", r"{\1}", text))
    return None if plain is None else parse(plain)


class Writer:
    """Pieces of LaTeX of a tree. Every choice takes the next digit of the style."""

    COMMANDS = {"asin": "arcsin", "acos": "arccos", "atan": "arctan", "log": "ln"}
    KNOWN = {"sin", "cos", "tan", "sec", "csc", "cot", "sinh", "cosh", "tanh", "coth", "arcsin", "arccos", "arctan", "ln"}

    def __init__(self) -> None:
        self.count = 0

    def choose(self, *options: tuple[str, ...]) -> list[Pieces]:
        """One choice among options (digit below which, text, text, ..): a choice for each of the texts, all decided by one digit.

        What stands between the texts is written once, so that nested choices don't multiply.
        """
        self.count += 1
        return [(Choice((self.count - 1) % 32 + 1, tuple((below, (said[i],)) for below, *said in options)),) for i in range(len(options[0]) - 1)]

    def braced(self, node: Tree) -> Pieces:
        return ("{", *self.write(node), "}")

    def bracketed(self, node: Tree) -> Pieces:
        return (r"\left(", *self.write(node), r"\right)")

    def tight(self, node: Tree, least: int) -> Pieces:
        return self.write(node) if rank(node) >= least else self.bracketed(node)

    def write(self, node: Tree) -> Pieces:
        match node:
            case ast.Constant(value=v):
                return (repr(v),)
            case ast.Name(id=name):
                return (f"<{name}>",) if name in PARAMETERS else ({"pi": r"\pi", "E": "e", "I": "i"}.get(name, name),)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return ("-", *self.tight(x, 3))
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.write(x)
            case ast.BinOp(left=l, op=ast.Add() | ast.Sub() as op, right=r):
                return (*self.write(l), " + " if isinstance(op, ast.Add) else " - ", *self.tight(r, 2))
            case ast.BinOp(left=l, op=ast.Mult(), right=r):
                dot, times = ("c" if starts_with_number(r) else "b", r" \cdot "), ("g", r" \times ")
                (sign,) = self.choose(dot, times) if starts_with_number(r) else self.choose(("8", " "), dot, times)
                return (*self.tight(l, 2), *sign, *self.tight(r, 3))
            case ast.BinOp(left=l, op=ast.Div(), right=r):
                up, down = (("", "") if rank(x) >= least else (r"\left(", r"\right)") for x, least in ((l, 2), (r, 4)))
                start, over, end = self.choose(("b", r"\frac{", "}{", "}"), ("g", r"\left(" + up[0], f"{up[1]} / {down[0]}", down[1] + r"\right)"))
                return (*start, *self.write(l), *over, *self.write(r), *end)
            case ast.BinOp(left=ast.Name(id="E"), op=ast.Pow(), right=r):
                start, end = self.choose(("7", "e^{", "}"), ("c", r"\exp\left(", r"\right)"), ("g", r"\operatorname{exp}\left(", r"\right)"))
                return (*start, *self.write(r), *end)
            case ast.BinOp(left=l, op=ast.Pow(), right=r):
                return (*self.tight(l, 4), "^", *self.braced(r))
            case ast.Call(func=ast.Name(id="sqrt"), args=[x]):
                start, end = self.choose(("b", r"\sqrt{", "}"), ("g", r"\left(", r"\right)^{\frac{1}{2}}"))
                return (*start, *self.write(x), *end)
            case ast.Call(func=ast.Name(id="Abs"), args=[x]):
                start, end = self.choose(("8", r"\left|", r"\right|"), ("g", "|", "|"))
                return (*start, *self.write(x), *end)
            case ast.Call(func=ast.Name(id="log"), args=[x, base]):
                return (r"\log_", *self.braced(base), *self.bracketed(x))
            case ast.Call(func=ast.Name(id="log"), args=[x]):
                (name,) = self.choose(("8", r"\ln"), ("g", r"\log"))
                return (*name, *self.bracketed(x))
            case ast.Call(func=ast.Name(id=("asin" | "acos" | "atan") as name), args=[x]):
                (said,) = self.choose(("8", rf"\{self.COMMANDS[name]}"), ("c", rf"\operatorname{{{name}}}"), ("g", rf"\{name[1:]}^{{-1}}"))
                return (*said, *self.bracketed(x))
            case ast.Call(func=ast.Name(id="factorial"), args=[x]):
                return (*self.tight(x, 4), "!")
            case ast.Call(func=ast.Name(id=("floor" | "ceiling") as name), args=[x]):
                side = name[:5].replace("ceili", "ceil")
                return (rf"\l{side} ", *self.write(x), rf" \r{side}")
            case ast.Call(func=ast.Name(id=name), args=[x]):
                return (rf"\{name}" if name in self.KNOWN else rf"\operatorname{{{name}}}", *self.bracketed(x))
        raise Unprintable(ast.unparse(node))


def rank(node: Tree) -> int:
    """How tightly LaTeX binds: sums 1, products and signs 2, function calls and fractions 3, what may stand under a power 4."""
    match node:
        case ast.BinOp(op=ast.Add() | ast.Sub()):
            return 1
        case ast.UnaryOp() | ast.BinOp(op=ast.Mult()):
            return 2
        case ast.Name() | ast.Constant():
            return 4
        case ast.Call(func=ast.Name(id="Abs")):
            return 4
    return 3


def starts_with_number(node: Tree) -> bool:
    match node:
        case ast.Constant():
            return True
        case ast.Name(id=name):
            return name in PARAMETERS
        case ast.BinOp(left=l, op=ast.Mult() | ast.Pow()):
            return starts_with_number(l)
        case ast.Call(func=ast.Name(id="factorial"), args=[x]):
            return starts_with_number(x)
    return False


# What stands around formulas in a problem's text, with the ways to write it; {} is the formula behind it.
_DERIVATIVE = r"\frac{d}{dx} "
_CUT = re.compile(r"(\\frac\{d\}\{dx\} |\\int_\S+ | d[tx]\b|\\lim_\{[^{}]*\} |\\(?:sum|prod)_\{[^{}]*\}\^\{?<[a-z]>\}? |\[t\^[^\]]*\] | = |, |y''|y'(?!'))")


def _formula(text: str) -> Tree | None:
    """reading(), None also for what looks like a call of a letter, as y(0), and for words."""
    return None if re.search(r"(?<![\\A-Za-z])([A-Za-z]\(|[A-Za-z]{2})", re.sub(r"\\operatorname\{[a-z0-9]+\}", "", text)) else reading(text)


def written(text: str) -> tuple[Pieces, Tree | None]:
    """Pieces of a problem's text with choices of notation, and its tree if the text is one formula."""
    out, writer, cuts = [], Writer(), _CUT.split(text)
    k = 0
    while k < len(cuts):
        t = cuts[k]
        body = _formula(cuts[k + 1]) if t == _DERIVATIVE and k + 1 < len(cuts) else None
        if body is not None:
            low, high = ("", "") if rank(body) >= 2 else (r"\left(", r"\right)")
            start, end = writer.choose(("6", t + low, high), ("9", r"\frac{d}{\,dx} " + low, high), ("c", r"\left(", r"\right)'"), ("g", r"\frac{d \left(", r"\right)}{dx}"))
            out += (*start, *writer.write(body), *end)
            k += 2
            continue
        if t == "y''":
            out += writer.choose(("6", t), ("b", r"\frac{d^2 y}{dx^2}"), ("g", r"y^{(2)}"))[0]
        elif t == "y'":
            out += writer.choose(("6", t), ("b", r"\frac{dy}{dx}"), ("g", r"\frac{d}{dx} y"))[0]
        elif t in (" dt", " dx"):
            out += writer.choose(("6", t), ("b", rf" \,{t}"), ("g", rf" \, \mathrm{{d}}{t[-1]}"))[0]
        elif t:
            lead, core, trail = re.fullmatch(r"(\s*(?:[+-]\s+)?)(.*?)(\s*)", t).groups()
            tree = _formula(core) if core and k % 2 == 0 else None
            try:
                # After a sign of sum, limit or coefficient a formula of several terms needs brackets.
                body = None if tree is None else writer.tight(tree, 2) if k and cuts[k - 1].startswith(("\\lim", "\\sum", "\\prod", "[t")) else writer.write(tree)
            except Unprintable:
                body = None
            out += [t] if body is None else [x for x in (lead, *body, trail) if x]
        k += 1
    whole = _formula(text) if len(cuts) == 1 else None
    pieces = tuple(out)
    return (pieces if ways(pieces) > 2 else framed(pieces)), whole


def ways(pieces: Pieces) -> int:
    """How many texts the choices give, at most."""
    return math.prod({p.number: len(p.options) for p in pieces if isinstance(p, Choice)}.values())


#: Around texts that have hardly a choice.
FRAMES = (("5", ("", "")), ("a", (r"\left(", r"\right)")), ("d", (r"\displaystyle ", "")), ("g", (r"\textstyle ", "")))


def framed(pieces: Pieces) -> Pieces:
    """pieces, in one of FRAMES by the last digit of the style."""
    return (Choice(32, tuple((digit, tuple(x for x in (low, *pieces, high) if x)) for digit, (low, high) in FRAMES)),)


def text_sql(pieces: Pieces, style: str, quote: str) -> str:
    """SQL of the pieces' text; parameters are columns by their names. quote: makes a literal of a text, which engines do differently."""
    out = []
    for p in pieces:
        if isinstance(p, Choice):
            whens = " ".join(f"WHEN substr({style}, {p.number}, 1) < '{below}' THEN {text_sql(option, style, quote)}" for below, option in p.options[:-1])
            last = text_sql(p.options[-1][1], style, quote)
            out.append(f"CASE {whens} ELSE {last} END" if whens else last)
        else:
            out += [f"CAST({q} AS STRING)" if i % 2 else quoted(q, quote) for i, q in enumerate(re.split(r"<([abcmn])>", p)) if i % 2 or q]
    return "(" + " || ".join(out) + ")" if out else quoted("", quote)


def quoted(text: str, quote: str) -> str:
    """A literal: Spark's raw one in double quotes, or the standard's in single ones."""
    return f'r"{text}"' if quote == "spark" else "'" + text.replace("'", "''") + "'"
