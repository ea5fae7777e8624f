"""Running solution code for each case, in child processes with resource limits, from Arrow UDF workers.

Code never runs in the Python worker itself: a row that kills its process or never ends costs that child, not the task.
The checks of the source before that are a filter, not the protection.
"""

from __future__ import annotations

import ast
import json
import os
import selectors
import signal
import subprocess
import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What submitted code may import, must not call, and which names with two underscores it may use.
ALLOWED_IMPORTS = {"sympy", "numpy", "math", "cmath", "itertools", "functools", "collections", "fractions", "statistics", "decimal"}
DENIED_CALLS = {"eval", "exec", "open", "compile", "__import__", "input", "breakpoint", "globals", "locals", "vars", "memoryview", "help", "exit", "quit"}
DENIED_METHODS = {"system", "popen", "subprocess", "connect"}
ALLOWED_DUNDERS = {"__name__", "__file__"}


def safety_error(code: str | None) -> str | None:
    """Why code may not run, or None."""
    if code is None or not code.strip():
        return "no code"
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return f"syntax error: {e}"[:200]
    for node in ast.walk(tree):
        match node:
            case ast.Import():
                for a in node.names:
                    if a.name.split(".")[0] not in ALLOWED_IMPORTS:
                        return f"import of {a.name}"
            case ast.ImportFrom():
                if node.level or (node.module or "").split(".")[0] not in ALLOWED_IMPORTS:
                    return f"import from {'.' * node.level}{node.module or ''}"
            case ast.Call(func=ast.Name(id=name)) if name in DENIED_CALLS:
                return f"use of {name}"
            case ast.Call(func=ast.Attribute(attr=name)) if name in DENIED_METHODS:
                return f"use of .{name}"
        name = getattr(node, "attr", None) or getattr(node, "id", None)
        if isinstance(name, str) and name.startswith("__") and name not in ALLOWED_DUNDERS:
            return f"use of {name}"
    return None


#: The child serves one request a line, a program with some inputs, in a fork of its own, so that imports are paid for once. Each input is run in a fresh
#: namespace with a time limit of its own; what kills the fork ends the request there, and the rest is asked for again.
_CHILD = r"""
import inspect, json, os, resource, signal, sys
def number(v):
    if isinstance(v, bool) or v is None: return str(v)
    if hasattr(v, 'item'): v = v.item()
    if isinstance(v, int): return repr(float(v)) if abs(v) < 1e300 else str(v)
    try:
        c = complex(v)
    except Exception:
        return str(v)
    if c.imag: return f"{c.real!r}{'+' if c.imag >= 0 else ''}{c.imag!r}j"
    return repr(c.real)
def value(t):
    if not isinstance(t, str): return t
    for kind in (int, float, complex):
        try: return kind(t.replace(' ', ''))
        except ValueError: pass
    return t
def entry(space):
    if callable(space.get('calculate')): return space['calculate']
    for name, f in space.items():
        if not name.startswith('_') and inspect.isfunction(f) and f.__module__ == '__main__': return f
    raise TypeError('no function')
def bound(f, given):
    out = {}
    for p in inspect.signature(f).parameters.values():
        for key in (p.name, p.name.removesuffix('_val'), p.name.removesuffix('_value')):
            if given.get(key) is not None: out[p.name] = value(given[key]); break
        else:
            if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY, p.POSITIONAL_ONLY): raise TypeError('missing ' + p.name)
    return out
import math, cmath
try: import numpy
except ImportError: pass
def limits(job):
    s = max(1, int(job['timeout_s'] * len(job['inputs']) + 1))
    for what, most in ((resource.RLIMIT_CPU, s), (resource.RLIMIT_FSIZE, 1 << 20), (resource.RLIMIT_NOFILE, 64)): resource.setrlimit(what, (most, most))
    used = int(open('/proc/self/statm').read().split()[0]) * 4096
    resource.setrlimit(resource.RLIMIT_AS, (used + (job['memory_mb'] << 20),) * 2)
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    null = os.open(os.devnull, os.O_RDWR)
    for k in (0, 1, 2): os.dup2(null, k)
def one(code, given, most):
    try:
        space = {'__name__': '__main__'}
        exec(code if not isinstance(code, str) else compile(code, '<code>', 'exec'), space)
        f = entry(space)
        said = number(f(**bound(f, given)))
        if len(said.encode()) > most: raise OverflowError(f'the output is longer than {most} bytes')
        return {'exit_code': 0, 'stdout': said, 'stderr': ''}
    except BaseException as e:
        return {'exit_code': 1, 'stdout': '', 'stderr': f'{type(e).__name__}: {e}'[:500]}
for line in sys.stdin:
    job = json.loads(line)
    r, w = os.pipe()
    pid = os.fork()
    if not pid:
        os.close(r)
        limits(job)
        code = job['code']
        try: code = compile(code, '<code>', 'exec')
        except BaseException: pass
        try:
            with os.fdopen(w, 'wb') as out:
                for given in job['inputs']:
                    signal.setitimer(signal.ITIMER_REAL, job['timeout_s'])
                    got = one(code, given, job['output_bytes'])
                    signal.setitimer(signal.ITIMER_REAL, 0)
                    out.write(json.dumps(got).encode() + b'\n'); out.flush()
        finally: os._exit(0)
    os.close(w)
    with os.fdopen(r, 'rb') as f:
        for got in f:
            if got.endswith(b'\n'): sys.stdout.write(got.decode()); sys.stdout.flush()
    _, status = os.waitpid(pid, 0)
    late = os.WIFSIGNALED(status) and os.WTERMSIG(status) in (signal.SIGALRM, signal.SIGXCPU)
    print(json.dumps({'end': True, 'timed_out': late}), flush=True)
"""


#: A longer output is an error of the run, and named as such.
OUTPUT_BYTES = 1 << 20
#: Inputs of one program that share a fork.
TOGETHER = 64


class Child:
    """A child process that runs programs; replaced when it dies or falls silent."""

    def __init__(self):
        self.process = None

    def run(self, code: str, inputs: list[dict], timeout_s: float, memory_mb: int) -> list[dict]:
        """One result for each input."""
        done: list[dict] = []
        idle = 0  # requests in a row that gave nothing
        while len(done) < len(inputs):
            got, end = self._ask(code, inputs[len(done) :], timeout_s, memory_mb)
            done += got
            idle = 0 if got or end else idle + 1
            if len(done) < len(inputs) and (end or idle == 2):  # the next one killed the fork, or the child twice
                done.append({"exit_code": 1, "stdout": "", "stderr": "killed" if end else "the sandbox died", "timed_out": end["timed_out"] if end else True})
                idle = 0
        return done

    def _ask(self, code: str, inputs: list[dict], timeout_s: float, memory_mb: int) -> tuple[list[dict], dict | None]:
        """The results until the fork ended, and how it ended; None if the child itself fell silent."""
        if self.process is None or self.process.poll() is not None:
            env = {"PATH": os.environ.get("PATH", ""), "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": ""}
            self.process = subprocess.Popen([sys.executable, "-c", _CHILD], bufsize=0, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
        got, held = [], b""
        try:
            request = {"code": code, "inputs": inputs, "timeout_s": timeout_s, "memory_mb": memory_mb, "output_bytes": OUTPUT_BYTES}
            self.process.stdin.write(json.dumps(request).encode() + b"\n")
            with selectors.DefaultSelector() as s:
                s.register(self.process.stdout, selectors.EVENT_READ)
                while s.select(timeout_s + 20) and (more := os.read(self.process.stdout.fileno(), 1 << 16)):
                    *lines, held = (held + more).split(b"\n")
                    got += map(json.loads, lines)
                    if got and "end" in got[-1]:
                        return got[:-1], got[-1]
        except (OSError, ValueError):
            pass
        self.close()
        return got, None

    def close(self) -> None:
        if self.process is not None:
            try:
                os.killpg(self.process.pid, signal.SIGKILL)
            except OSError:
                pass
            self.process.wait()
            self.process = None


RESULT = "exit_code int, stdout string, stderr string, timed_out boolean, safety_error string"


def execute(cases: DataFrame, timeout_s: float = 2.0, memory_mb: int = 512) -> DataFrame:
    """cases(.., code, input map<string,string>) with `run`, a struct of exit code, output, error, time-out and safety error.

    Only key columns, code and input go through Python. A source is checked once for each batch's distinct texts, and its inputs of a batch run in
    a few forks. An output of more than OUTPUT_BYTES fails.
    """
    rest = [c for c in cases.columns if c not in ("code", "input")]
    schema = cases.select(*rest, "code", "input").schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = Child()
        try:
            for df in frames:
                out: list[tuple] = [()] * len(df)
                inputs, of_code = df["input"].tolist(), df.groupby(df["code"].fillna(""), sort=False).indices
                for code, rows in of_code.items():
                    if bad := safety_error(code):
                        for i in rows:
                            out[i] = (1, "", "", False, bad)
                        continue
                    for k in range(0, len(rows), TOGETHER):
                        some = rows[k : k + TOGETHER]
                        for i, got in zip(some, child.run(code, [dict(inputs[i] or {}) for i in some], timeout_s, memory_mb), strict=True):
                            out[i] = (got["exit_code"], got["stdout"], got["stderr"], bool(got.get("timed_out")), None)
                names = ["exit_code", "stdout", "stderr", "timed_out", "safety_error"]
                # Maps come from Arrow as lists of pairs or dicts; they go back as they came.
                yield pd.concat([df.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)
        finally:
            child.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    done = cases.select(*rest, "code", "input").mapInPandas(run, f"{fields}, {RESULT}")
    return done.select(*rest, "code", "input", F.struct("exit_code", "stdout", "stderr", "timed_out", "safety_error").alias("run"))


def run_solutions(problems: DataFrame, **limits) -> DataFrame:
    """(task_id, case_index, got, expected, error) of problems(task_id, code, test_cases): got is null where the run failed."""
    cases = problems.select("task_id", "code", F.posexplode("test_cases").alias("case_index", "c"))
    done = execute(cases.select("task_id", "case_index", F.col("c.output").alias("expected"), "code", F.col("c.input").alias("input")), **limits)
    ok = (F.col("run.exit_code") == 0) & F.col("run.safety_error").isNull() & ~F.col("run.timed_out")
    # Code that prints nothing counts as the answer 0.
    got = F.when(ok, F.when(F.col("run.stdout") == "", "0").otherwise(F.col("run.stdout")))
    return done.select("task_id", "case_index", got.alias("got"), "expected", F.when(~ok, F.coalesce("run.safety_error", F.nullif("run.stderr", F.lit("")), F.lit("failed"))).alias("error"))


@F.pandas_udf(StringType())
def safety(code: pd.Series) -> pd.Series:
    """safety_error as a column, once for each distinct text of a batch."""
    known = {c: safety_error(c) for c in code.unique()}
    return code.map(known)


def throughput(spark, n: int = 10_000, cores: int | None = None) -> float:
    """Executions a second of n small functions, ten inputs a function; an error if any of them fails."""
    df = spark.range(n).repartition(cores or spark.sparkContext.defaultParallelism, F.floor(F.col("id") / 10))
    code = F.concat(F.lit("def calculate(x):\n    return x ** 2 + "), F.floor(F.col("id") / 10).cast("string"))
    df = df.select("id", code.alias("code"), F.create_map(F.lit("x"), F.col("id").cast("string")).alias("input"))
    start = time.time()
    failed = execute(df).agg(F.count_if(F.col("run.exit_code") != 0)).first()[0]
    if failed:
        raise RuntimeError(f"{failed} of {n} runs failed")
    return n / (time.time() - start)
