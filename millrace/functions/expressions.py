"""Evaluating truth expressions given as text, one row an expression, in Arrow batches.

An expression is parsed once per distinct text and must be plain arithmetic over numbers, the inputs' names and FUNCTIONS; all
values are complex, so roots and logarithms of negative numbers have their principal values.
"""

from __future__ import annotations

import ast
import cmath
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _whole(z: complex) -> int:
    if z.imag or z.real != int(z.real):
        raise ValueError("not a whole number")
    return int(z.real)


def _real(z: complex) -> float:
    if abs(z.imag) > 1e-12:
        raise ValueError("not real")
    return z.real


# The vocabulary of truth expressions.
CONSTANTS = {"pi": math.pi, "E": math.e, "I": 1j, "oo": math.inf}
FUNCTIONS: dict[str, Callable] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan,
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "asinh": cmath.asinh, "acosh": cmath.acosh, "atanh": cmath.atanh,
    "sec": lambda z: 1 / cmath.cos(z), "csc": lambda z: 1 / cmath.sin(z), "cot": lambda z: 1 / cmath.tan(z),
    "sech": lambda z: 1 / cmath.cosh(z), "csch": lambda z: 1 / cmath.sinh(z), "coth": lambda z: 1 / cmath.tanh(z),
    "exp": cmath.exp, "sqrt": cmath.sqrt, "ln": cmath.log, "log": lambda z, b=math.e: cmath.log(z) / cmath.log(b), "cbrt": lambda z: z ** (1 / 3),
    "Abs": abs, "sign": lambda z: z / abs(z) if z else 0, "floor": lambda z: math.floor(_real(z)), "ceiling": lambda z: math.ceil(_real(z)),
    "atan2": lambda y, x: math.atan2(_real(y), _real(x)), "Min": lambda *a: min(map(_real, a)), "Max": lambda *a: max(map(_real, a)), "Mod": lambda a, b: math.fmod(math.fmod(_real(a), _real(b)) + _real(b), _real(b)),
    "factorial": lambda n: math.factorial(_whole(n)), "binomial": lambda n, k: math.comb(_whole(n), _whole(k)), "gcd": lambda a, b: math.gcd(_whole(a), _whole(b)), "lcm": lambda a, b: math.lcm(_whole(a), _whole(b)),
    "gamma": lambda z: math.gamma(_real(z)), "erf": lambda z: math.erf(_real(z)),
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: a**b}


def compiled(text: str) -> Callable[[dict[str, complex]], complex]:
    """A function of the inputs; ValueError where the text isn't such an expression."""

    def build(node: ast.AST) -> Callable:
        match node:
            case ast.Constant(value=int() | float() | complex() as v) if not isinstance(v, bool):
                return lambda env: complex(v)
            case ast.Name(id=name):
                return (lambda env: complex(CONSTANTS[name])) if name in CONSTANTS else (lambda env: env[name])
            case ast.UnaryOp(op=ast.USub(), operand=x):
                f = build(x)
                return lambda env: 0 - f(env)  # keeps +0j, and with it the branch of roots
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                f, g, do = build(a), build(b), _BINARY[type(op)]
                return lambda env: do(f(env), g(env))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
                parts, do = [build(a) for a in args], FUNCTIONS[name]
                return lambda env: complex(do(*(p(env) for p in parts)))
        raise ValueError(f"not arithmetic: {ast.dump(node)[:80]}")

    try:
        return build(ast.parse(text.strip().replace("^", "**"), mode="eval").body)
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from e


RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


@F.pandas_udf(RESULT)
def _evaluate(text: pd.Series, inputs: pd.Series) -> pd.DataFrame:
    known: dict[str, Callable | None] = {}
    out = []
    for t, given in zip(text, inputs, strict=True):
        if t is None or not t.strip():
            out.append(("empty", None, None))
            continue
        if t not in known:
            try:
                known[t] = compiled(t)
            except ValueError:
                known[t] = None
        f = known[t]
        if f is None:
            out.append(("parse error", None, None))
            continue
        try:
            env = {k.removesuffix("_val").removesuffix("_value"): complex(str(v).replace(" ", "")) for k, v in dict(given if given is not None else {}).items() if v is not None}
            z = f(env)
            ok = math.isfinite(z.real) and math.isfinite(z.imag)
            out.append(("evaluated" if ok else "undefined", z.real if ok else None, (z.imag if abs(z.imag) > 1e-9 else 0.0) if ok else None))
        except (ValueError, ArithmeticError, KeyError, TypeError):
            out.append(("undefined", None, None))
    return pd.DataFrame(out, columns=["status", "re", "im"])


def evaluate(text: Column, inputs: Column) -> Column:
    """struct<status, re, im>: status is empty, parse error, undefined (no finite value there) or evaluated."""
    return _evaluate(text, inputs)
