r"""Reading LaTeX formulas as plain arithmetic for expressions.evaluate().

Understood: numbers, letters, + - * / ^ and \cdot, \times, \frac, \sqrt[n]{..}, brackets, |..|, \pi, e, functions by name (\sin,
\operatorname{..}, powers like \sin^2 x), juxtaposition as multiplication. Calculus, sums and limits are not, and give null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# LaTeX names and the vocabulary of truth expressions.
NAMES = {
    "sin": "sin", "cos": "cos", "tan": "tan", "sec": "sec", "csc": "csc", "cot": "cot", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "coth": "coth", "sech": "sech", "csch": "csch",
    "arcsin": "asin", "arccos": "acos", "arctan": "atan", "asin": "asin", "acos": "acos", "atan": "atan", "asinh": "asinh", "acosh": "acosh", "atanh": "atanh", "exp": "exp", "ln": "log", "log": "log",
}
_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[0-9]+(?:\.[0-9]*)?|\.[0-9]+|[A-Za-z]|\S")
_SKIP = {r"\left", r"\right", r"\displaystyle", r"\textstyle", r"\,", r"\;", r"\!", r"\:", r"\quad"}


class _Reader:
    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text.replace(r"\dfrac", r"\frac").replace(r"\tfrac", r"\frac")) if t not in _SKIP]
        self.at, self.bars = 0, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t != want):
            raise ValueError(f"{want or 'more'} expected")
        self.at += 1
        return t

    def sum(self) -> str:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = f"{out} {self.take()} {self.product()}"
        return out

    def product(self) -> str:
        out = self.signed()
        while t := self.peek():
            if t in ("*", r"\cdot", r"\times", "/"):
                self.take()
                out = f"{out} {'/' if t == '/' else '*'} {self.signed()}"
            elif self.starts(t):
                out = f"{out} * {self.power()}"
            else:
                break
        return out

    def starts(self, t: str) -> bool:
        return t[0].isalnum() or t[0] == "." or t in ("(", "{", "[", r"\frac", r"\sqrt", r"\pi", r"\operatorname", r"\lfloor", r"\lceil") or t[1:] in NAMES or (t == "|" and not self.bars)

    def signed(self) -> str:
        if self.peek() in ("+", "-"):
            return f"({self.take()}{self.signed()})"
        return self.power()

    def power(self) -> str:
        out = self.atom()
        while self.peek() in ("^", "!"):
            if self.take() == "!":
                out = f"factorial({out})"
            else:
                out = f"({out})**({self.argument()})"
        return out

    def argument(self) -> str:
        """What follows ^ or a command: a group in braces, or one token."""
        if self.peek() == "{":
            return self.group("{", "}")
        t = self.peek()
        if t[:1].isdigit() and len(t) > 1:  # without braces, one digit
            self.tokens[self.at] = t[1:]
            return t[0]
        return self.signed() if t == "-" else self.atom()

    def group(self, left: str, right: str) -> str:
        self.take(left)
        bars, self.bars = self.bars, 0
        out = self.sum()
        self.bars = bars
        self.take(right)
        return f"({out})"

    def atom(self) -> str:
        t = self.peek()
        for left, right in (("(", ")"), ("{", "}"), ("[", "]")):
            if t == left:
                return self.group(left, right)
        self.take()
        if t[:1].isdigit() or t[:1] == ".":
            return t
        if t == "|":
            self.bars += 1
            out = self.sum()
            self.bars -= 1
            self.take("|")
            return f"Abs({out})"
        if t in (r"\lfloor", r"\lceil"):
            out = self.sum()
            self.take(r"\rfloor" if t == r"\lfloor" else r"\rceil")
            return f"{'floor' if t == r'\lfloor' else 'ceiling'}({out})"
        if t == r"\pi":
            return "pi"
        if t == r"\frac":
            return f"({self.argument()} / {self.argument()})"
        if t == r"\sqrt":
            if self.peek() == "[":
                n = self.group("[", "]")
                return f"({self.argument()})**(1/{n})"
            return f"sqrt({self.argument()})"
        if t == r"\operatorname":
            self.take("{")
            t = "\\"
            while self.peek() != "}":
                t += self.take()
            self.take("}")
        if (name := NAMES.get(t[1:])) and t[0] == "\\":
            return self.function(name)
        if len(t) == 1 and t.isalpha():
            return {"e": "E", "i": "I"}.get(t, t)
        raise ValueError(f"{t} isn't understood")

    def function(self, name: str) -> str:
        base = raised = None
        while self.peek() in ("^", "_"):
            if self.take() == "_":
                base = self.argument()
            else:
                raised = self.argument()
        if self.peek() in ("(", "{"):
            inner = self.group(self.peek(), ")" if self.peek() == "(" else "}")
        else:  # \sin 2x takes the factors that follow
            inner = self.power()
            while self.starts(self.peek() or " ") and self.peek()[1:] not in NAMES:
                inner = f"{inner} * {self.power()}"
        if raised == "(-1)" or raised == "((-1))":
            name, raised = f"a{name}", None
        out = f"{name}({inner}{f', {base}' if base else ''})"
        return f"({out})**({raised})" if raised else out


def read(latex: str | None) -> str | None:
    """An expression for expressions.compiled(), or None."""
    try:
        r = _Reader(latex or "")
        out = r.sum()
        return out if not r.peek() else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _expression(latex: pd.Series) -> pd.Series:
    known = {t: read(t) for t in latex.unique()}
    return latex.map(known)


def expression(latex: Column) -> Column:
    """The formula as plain arithmetic, null where it isn't understood."""
    return _expression(latex)
