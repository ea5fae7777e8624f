import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import bootstrap, calculus, contamination, dedup, gates, generators, matrices, sampling, sandbox, scoring, training_mixture, trees, verify


def problems(spark, rows):
    return spark.createDataFrame([(t, [({"x": "1"}, o) for o in outs]) for t, outs in rows], "task_id string, test_cases array<struct<input:map<string,string>,output:string>>")


def test_two_level_scoring(spark):
    p = problems(spark, [("a", ["1", "2"]), ("b", ["1", "2"]), ("c", ["1"])])
    pred = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1", "99"]), ("zz", ["1"])], "task_id string, outputs array<string>")
    one = scoring.summary(scoring.per_problem(scoring.score_cases(scoring.align(p, pred)))).first()
    assert (one.case_accuracy, one.problem_accuracy, one.n_problems) == (0.75, 0.5, 2)
    strict = scoring.summary(scoring.per_problem(scoring.score_cases(scoring.align(p, pred, "fail")))).first()
    assert (strict.n_problems, strict.problems_passed) == (3, 1)
    short = spark.createDataFrame([("a", [None])], "task_id string, outputs array<string>")
    assert scoring.summary(scoring.per_problem(scoring.score_cases(scoring.align(p, short)))).first().case_accuracy == 0.0
    assert scoring.summary(scoring.per_problem(scoring.score_cases(scoring.align(p.limit(0), pred)))).first().problem_accuracy == 0.0


def test_lengths_that_differ(spark):
    p = problems(spark, [("a", ["1", "2"]), ("b", ["1"])])
    pred = spark.createDataFrame([("a", ["1"]), ("b", ["1"])], "task_id string, outputs array<string>")
    assert sorted((r.task_id, r.got) for r in scoring.align(p, pred).collect() if r.got) == [("a", "1"), ("b", "1")]
    with pytest.raises(Exception, match="task a has 1 outputs for 2 cases"):
        scoring.align(p, pred, lengths="error").collect()
    assert scoring.align(p.where("task_id = 'b'"), pred, lengths="error").count() == 1


def test_missing_truth_is_an_error(spark):
    with pytest.raises(Exception, match="expected output"):
        scoring.score_cases(spark.createDataFrame([("1", None)], "got string, expected string")).collect()


def test_bootstrap(spark):
    df = spark.createDataFrame([(i < 90,) for i in range(100)], "all_passed boolean")
    a, b = bootstrap.bootstrap_ci(df, resamples=500).first(), bootstrap.bootstrap_ci(df.repartition(7), resamples=500).first()
    assert a == b and 0.8 <= a.lo <= 0.9 <= a.hi <= 1.0
    assert bootstrap.bootstrap_ci(df.where("all_passed")).first()[2:] == (1.0, 1.0)
    assert bootstrap.bootstrap_ci(df.limit(0)).first()[2:] == (0.0, 0.0)


def test_keep_first(spark):
    df = spark.createDataFrame([("a", "x + 1", 0), ("b", "x + 1", 1), ("c", "x + 2", 2)], "task_id string, latex string, row_no int")
    for parts in (1, 5):
        assert sorted(r.task_id for r in dedup.keep_first(df.repartition(parts), ["latex"], ["row_no"]).collect()) == ["a", "c"]


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    shares = spark.createDataFrame([(0, 0.5), (1, 0.3)], "g long, share double")
    for make in (
        lambda d: sampling.exact_sample(d, 17, "id", "s"), lambda d: sampling.stratified_split(d, ["g"], "id", "s", 20, 10),
        lambda d: sampling.proportional(d, "g", shares, 30, "id", "s"), lambda d: sampling.shard_ranges(d, 7, "id"),
    ):
        assert sorted(make(df.repartition(1)).collect()) == sorted(make(df.repartition(7)).collect())
    assert sampling.exact_sample(df, 500, "id", "s").count() == 200
    sizes = sorted(r["count"] for r in sampling.shard_ranges(df, 7, "id").groupBy("worker").count().collect())
    assert sizes == [28] * 3 + [29] * 4


def test_contamination(spark):
    df, frozen = spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), (None,)], "k string")
    kept, dropped = contamination.split(df, contamination.frozen_keys([frozen], "k"), "k")
    assert sorted(kept.collect(), key=str) == sorted([("a",), (None,)], key=str) and [r.k for r in dropped.collect()] == ["b"]
    with pytest.raises(ValueError, match="contaminated"):
        contamination.require_clean(df, frozen, "k")
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "xone two"), (3, None)], "doc_id int, text string")
    needles = spark.createDataFrame([(1, "ne two three four five six seven eight ni"), (2, "one two"), (3, "")], "item_id int, text string")
    assert sorted(tuple(r) for r in contamination.substring_hits(docs, needles).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_short_needles_by_brute_force(spark):
    """Needles of 1 to 40 bytes, some of several bytes a character, at the ends of texts and across rows that must not run together."""
    import random

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abé 中") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(900, None), (901, "x" * 3_000_000 + "needle")]
    needles = [(i, text(rng.choice([1, 2, 3, 5, 8, 13]))) for i in range(60)] + [(100 + i, docs[i][1][-6:]) for i in range(20)] + [(200, "xneedle"), (201, docs[0][1][-2:] + docs[1][1][:2])]
    want = sorted((d, i) for d, t in docs for i, n in needles if t and n and n in t)
    got = contamination.substring_hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(needles, "item_id int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 200


@pytest.mark.parametrize("code", ["import os", "from subprocess import run", "open('x')", "eval('1')", "().__class__", "from . import x", "def f(:", "import typing", "help()", "quit()", "memoryview(b'')", "x.connect()", "x.subprocess()", "f.__init__"])
def test_unsafe(code):
    assert sandbox.safety_error(code)


@pytest.mark.parametrize("code", ["import math\ndef f(x): return math.sqrt(x)", "def f(x): return x", "import numpy as np\ndef f(x): return np.sin(x)", "from collections import Counter\ndef f(x): return x", "def f(input): return input", "__name__"])
def test_safe(code):
    assert sandbox.safety_error(code) is None


def test_execute(spark):
    rows = [
        ("a", "def calculate(x, y):\n    return x**2 + y", {"x": "3", "y": "1"}), ("b", "def f(x_val, y_val):\n    return x_val + y_val", {"x": "1", "y": "2"}), ("c", "def f(x, y):\n    return x", {"x": "1"}),
        ("d", "def f(x):\n    while True: pass", {"x": "1"}), ("e", "def f(x):\n    return len([0] * 50_000_000)", {"x": "1"}), ("f", "import os", {}), ("g", "def f(x):\n    return x * 2j + 1", {"x": "1"}), ("h", None, None),
    ]
    df = spark.createDataFrame(rows, "task_id string, code string, input map<string,string>")
    got = {r.task_id: r.run for r in sandbox.execute(df, timeout_s=1.0, memory_mb=64).collect()}
    assert (got["a"].stdout, got["b"].stdout, got["g"].stdout) == ("10.0", "3.0", "1.0+2.0j")
    assert "missing" in got["c"].stderr and got["d"].timed_out and got["e"].exit_code and got["f"].safety_error and got["h"].safety_error == "no code"


def test_one_program_many_inputs(spark):
    """Inputs that end the fork, run out of time or give long outputs cost themselves only; the rest keep their places."""
    code = "seen = []\ndef calculate(x):\n    seen.append(x)\n    if x == 3:\n        while True: pass\n    if x == 5:\n        raise SystemExit\n    if x == 6:\n        return 'a' * 70_000\n    if x == 7:\n        return 'a' * 2_000_000\n    return x + len(seen)"
    df = spark.createDataFrame([(i, code if i != 4 else "def calculate(x):\n    return -x", {"x": str(i)}) for i in range(140)], "k int, code string, input map<string,string>").coalesce(1)
    got = {r.k: r.run for r in sandbox.execute(df, timeout_s=0.5, memory_mb=256).collect()}
    assert got[3].timed_out and got[5].exit_code == 1 and got[6].stdout == "a" * 70_000 and "longer than" in got[7].stderr and not got[7].timed_out
    assert all(got[i].stdout == f"{float(i + 1)}" for i in range(140) if i not in (3, 4, 5, 6, 7)) and got[4].stdout == "-4.0"


def test_rows_that_share_a_task(spark):
    """Rows are judged one by one, whatever their ids."""
    good, bad = "def calculate(x):\n    return 2*x + 1", "def calculate(x):\n    return x - 9"
    cases, kind = [({"x": "3"}, "7.0")], "task_id string, solution string, sympy_exp string, test_cases array<struct<input:map<string,string>,output:string>>"
    p = spark.createDataFrame([("t", good, "2*x + 1", cases), ("t", bad, "2*x + 1", cases), ("t", good, "2*x + 1", cases), ("t", "", "2*x + 1", cases), ("u", bad, "", cases), ("u", good, "", cases)], kind)
    assert sorted((r.task_id, r.solution, r.accepted) for r in verify.curate(p, n=2).collect()) == sorted([("t", good, True), ("t", bad, False), ("t", good, True), ("t", "", False), ("u", bad, False), ("u", good, True)])
    accepted, rejected = verify.verify_generated(p.where("task_id = 't'"), n=2)
    assert sorted(r.solution for r in accepted.collect()) == [good, good] and sorted(r.solution for r in rejected.collect()) == ["", bad] and accepted.columns == p.columns
    said = lambda c: f"<execute>{c}</execute>"
    t = spark.createDataFrame([("t", said(good)), ("t", said(bad)), ("t", said(good)), ("t", "no block"), ("x", said(good))], "task_id string, trajectory string")
    one = p.where("task_id = 't'").limit(1).withColumn("solution", F.lit(good))
    assert sorted((r.task_id, r.total) for r in verify.rewards(t, one).collect()) == [("t", 0.0), ("t", 1.1), ("t", 3.1), ("t", 3.1), ("x", 0.0)]


def test_wrong_output_fails_verification(spark):
    p = problems(spark, [("a", ["2.0"]), ("b", ["3.0"])]).withColumn("code", F.lit("def calculate(x):\n    return x + 1"))
    scored = scoring.per_problem(scoring.score_cases(sandbox.run_solutions(p)))
    assert {r.task_id: r.all_passed for r in scored.collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="gold accuracy"):
        verify.gold_check(p).collect()


def test_oracle(spark):
    code = {"good": "def calculate(x):\n    return 2*x + 1", "bad": "def calculate(x):\n    return x + 1", "none": ""}
    p = spark.createDataFrame([(k, c, "def calculate(x):\n    return 2*x + 1", [({"x": "3"}, None)]) for k, c in code.items()], "task_id string, code string, truth_code string, test_cases array<struct<input:map<string,string>,output:string>>")
    got = {r.task_id: r for r in verify.oracle_verify(p, n=3).collect()}
    assert got["good"].accepted and "mismatch" in got["bad"].reason and got["none"].reason == "empty solution"


def test_oracle_kinds_of_truth(spark):
    """An expression is the truth where there is no code; neither, or a failing run, rejects."""
    right, wrong, fails = "def calculate(x):\n    return 2*x + 1", "def calculate(x):\n    return x - 99", "def calculate(x):\n    return [][1]"
    rows = [
        ("exp", right, None, "2*x + 1"), ("exp wrong", wrong, "", "2*x + 1"), ("neither", right, None, None), ("unreadable", right, None, "2*+*x"), ("code first", right, right, "x - 99"), ("fails", fails, None, "2*x + 1"),
        ("nowhere", wrong, None, "log(x - x)"), ("nowhere fails", fails, None, "log(x - x)"), ("bad truth", right, fails, "2*x + 1"), ("text", "def calculate(x):\n    return 'abc'", right, None),
    ]
    p = spark.createDataFrame([(k, c, t, e, [({"x": "3"}, None)]) for k, c, t, e in rows] + [("no cases", right, None, None, [])], "task_id string, code string, truth_code string, sympy_exp string, test_cases array<struct<input:map<string,string>,output:string>>")
    got = {r.task_id: r.reason for r in verify.oracle_verify(p, n=3).collect()}
    none, failed = "no truth to compare with", "candidate failed to run"
    assert got == {
        "exp": None, "exp wrong": "mismatch with the truth", "neither": none, "unreadable": none, "code first": None, "fails": failed, "nowhere": None, "nowhere fails": failed,
        "bad truth": "truth code failed to run", "text": "output is no number", "no cases": none,
    }
    accepted, rejected = verify.verify_generated(p.withColumnRenamed("code", "solution"), n=2)
    assert {r.task_id for r in accepted.collect()} == {"exp", "code first", "nowhere"} and rejected.where("reason is null").count() == 0


def test_combine_reports(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "task_id string, n int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "task_id string, n int")
    assert sorted(tuple(r) for r in verify.combine_reports(a, b).collect()) == [("x", 1), ("y", 3), ("z", 4)]


def test_families_agree_with_a_second_route(spark):
    """Derivatives and integrals against differences of the functions they belong to."""
    import numpy as np

    keys = spark.range(40).withColumnRenamed("id", "i")
    rows = [r for r in generators.generate(keys, "integration", "3").collect() if r.variant == 0 and r.kind == "rational"]
    for r in rows:
        t = np.linspace(0, r.x, 20001)
        assert abs(np.trapezoid(1 / (1 + t * t), t) - r.expected) < 1e-6
    assert rows and sorted(generators.generate(keys.repartition(5), "limits").collect()) == sorted(generators.generate(keys, "limits").collect())
    with pytest.raises(ValueError, match="gated"):
        generators.generate(keys, "stats_moments")
    assert generators.pool(spark, 2).select("slice").distinct().count() > 10


def test_example_failures_and_orders(spark):
    df = spark.createDataFrame([(i % 7, i, str(i), "x", i % 3 == 0) for i in range(60)], "task_id int, case_index int, got string, expected string, passed boolean")
    got = [(r.task_id, r.got) for r in scoring.example_failures(df, ["case_index"], 4).collect()]
    assert got == [(1, "1"), (2, "2"), (4, "4"), (5, "5")]
    counted = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "value string, failures int")
    assert [r.value for r in scoring.by_count(counted).collect()] == ["c", "a", "b"] and [r.value for r in scoring.by_value(counted).collect()] == ["a", "b", "c"]


def test_ranks_in_two_levels(spark):
    from millrace.operators import sampling

    df = sampling.ordered(spark.range(5000).selectExpr("id", "if(id % 10 = 0, null, 'big') AS g"), "id", "s")
    rows = sampling.ranked(df, ["g"], "id").collect()
    for g in (None, "big"):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (r["_h"], r.id))
        assert [r["_r"] for r in mine] == list(range(1, len(mine) + 1))


def test_solutions_agree_with_truths(spark):
    """Every template has a Python solution, which gives its truth at each point, complex ones too."""
    keys, seen = spark.range(70).withColumnRenamed("id", "i"), set()
    for name in generators.FAMILIES:
        rows = generators.with_solutions(generators.generate(keys, name, "5", include_gated=True), name, "5").where("variant = 0 and case_index < 2").collect()
        for r in rows:
            space: dict = {}
            exec(r.solution, space)
            got, want = space["calculate"](r.x, r.y), complex(r.expected, r.expected_im)
            assert abs(got - want) <= 1e-9 * max(1, abs(want)), (r.kind, r.solution, r.x, r.y)
        seen |= {(name, r.kind) for r in rows}
    assert seen == {(name, t.kind) for name, f in generators.FAMILIES.items() for t in f.templates}


def test_generation_run(spark):
    rows = generators.problems(generators.with_solutions(generators.generate(spark.range(22).withColumnRenamed("id", "i"), "complex_eval", "2"), "complex_eval", "2"), "solution")
    spoilt = F.col("task_id").startswith("complex_eval_7:")
    rows = rows.withColumn("solution", F.when(spoilt, "def calculate(x, y):\n    return [][1]").otherwise(F.col("solution")))
    frozen = rows.where("task_id = 'complex_eval_3:v0'").select("latex_expression")
    accepted, rejected = generators.generation_run(rows, frozen)
    why = {r.task_id: r.reason for r in rejected.collect()}
    assert why.pop("complex_eval_3:v0") == "contaminated" and why and all(t.startswith("complex_eval_7:") and w.startswith("error: IndexError") for t, w in why.items())
    r = generators.generation_report(accepted, rejected).first()
    assert (r.generated, r.contamination_dropped, r.rejected) == (rows.count(), 1, len(why)) and r.accepted == r.generated - 1 - len(why)
    assert "j" in accepted.first().test_cases[0].output or accepted.count() > 20


def test_every_template_has_notations():
    """More than two ways to write each problem, and choices don't multiply the text."""
    for name, f in generators.FAMILIES.items():
        for t in f.templates:
            pieces, _ = trees.written(t.latex)
            assert trees.ways(pieces) > 2 and len(trees.text_sql(pieces, "s", "sql")) < 4000, (name, t.kind)


def test_trees_print_alike(spark):
    """SQL and Python of a tree give the same values."""
    texts = [
        "2 * x ** n + a / b - -x", "sum(k * x for k in range(1, n + 1) if k % 2 == 0)", "prod(k for k in range(2, m))", "sum(1 for k in range(5, 2))", "1.0 if a <= n < m and x > 0 or b == 3 else -1.0",
        "(3, 5, 7, 9)[n - 3]", "sum(sum(j for j in range(0, k)) for k in range(0, 6))", "gcd(m, 12) + m // 4", "power(2, n) + factorial(5) / sqrt(x)",
    ]
    row = {"x": 2.5, "a": 3, "b": 4, "c": 1, "m": 8, "n": 5}
    df = spark.createDataFrame([tuple(row.values())], "x double, a int, b int, c int, m int, n int")
    got = df.select(*[F.expr(trees.sql(trees.parse(t))).cast("double").alias(str(i)) for i, t in enumerate(texts)]).first()
    space: dict = {}
    exec(generators._PRELUDE, space)
    for i, t in enumerate(texts):
        code = trees.python(trees.parse(t))
        for p in trees.PARAMETERS:
            code = code.replace(f"<{p}>", str(row[p]))
        assert abs(got[i] - eval(code, space | row)) < 1e-9, t
    with pytest.raises(trees.Unprintable):
        trees.sql(trees.parse("erf(x)"))


def test_points_keep_off_poles(spark):
    near = lambda t: trees.near_pole(trees.parse(t), "x", 0.15)
    df = spark.createDataFrame([(float(x) / 10,) for x in range(-30, 31)], "x double")
    hit = lambda t: {round(r.x, 1) for r in df.where(near(t)).collect()}
    assert hit("1 / (x - 1)") == {0.9, 1.0, 1.1} and hit("2 / power(x * x - 4, 3) + 1 / 3") == {-2.1, -2.0, -1.9, 1.9, 2.0, 2.1}
    assert hit("1 / (x * x + 1)") == hit("x + exp(x)") == set() and hit("1 / (x * (2 * x + 1))") == {-0.6, -0.5, -0.4, -0.1, 0.0, 0.1}


def test_samples_run_out(spark):
    """As many points as 200 numbered draws give, the same however rows are dealt out."""
    f = ("s", generators.Family("s", [generators.Template("rare", "x", "sqrt(x - 99.0D)"), generators.Template("never", "x", "ln(-1.0D - x * x)"), generators.Template("often", "x", "x")], {"x": (0, 999)}))
    keys = spark.range(90).withColumnRenamed("id", "i")
    rows = generators.generate(keys, f, "1").where("variant = 0").collect()
    n = {k: [0] * 30 for k in ("rare", "never", "often")}
    for r in rows:
        n[r.kind][int(r.task_id.split("_")[1].split(":")[0]) // 3] += 1
    assert set(n["often"]) == {5} and set(n["never"]) == {0} and 0 < sum(n["rare"]) < 150 and min(n["rare"]) < 5
    assert sorted(rows, key=str) == sorted(generators.generate(keys.repartition(7), f, "1").where("variant = 0").collect(), key=str)


def test_user_family_states_its_columns(spark):
    from millrace.operators import user_families
    from millrace.plans.generation import Collatz

    keys = spark.createDataFrame([(5,), (None,), (26,)], "i int")
    for peaks in (False, True):
        user_families.register(spark, "collatz_test", Collatz(peaks))
        df = user_families.generate(keys, "collatz_test", "1")
        assert df.columns == ["i", "task_id", "latex", "start", "steps"] + ["peak"] * peaks
        assert sorted(r.steps for r in df.collect()) == [8, 111]
    with pytest.raises(ValueError, match="no name"):
        user_families.register(spark, "x y", Collatz(True))


def test_gates_find_a_wrong_truth():
    """What can be checked is; a truth that doesn't belong to its text is found, here by values."""
    ode = dict((t.kind, t) for t in generators.FAMILIES["differential_c1"].templates)
    assert len(gates.checkable("derivative", generators.FAMILIES["derivative"])) == 18 and "second" in ode and gates.sides("limits", generators.FAMILIES["limits"].templates[0]) is None


def test_calculus_in_truths(spark):
    said = [
        ("Integral(2*t, (t, 0, x))", {"x_val": "3"}, 9), ("Integral(t, (t, x, 0))", {"x": "2"}, -2), ("Integral(exp(-t**2), (t, -oo, oo))", {}, math.pi**0.5), ("Integral(exp(t), (t, -oo, 0))", {}, 1),
        ("Integral(x*y, (x, 0, 1), (y, 0, 2))", {}, 1), ("Integral(1/sqrt(t), (t, 0, 4))", {}, 4), ("Integral(I*t, (t, 0, 2))", {}, 2j), ("Integral(1/t, (t, -1, 1))", {}, "undefined"),
        ("Sum(k, (k, 1, n)) + 1", {"n": "10000"}, 50005001), ("Sum(k, (k, 5, 4))", {}, 0), ("Product(k, (k, 1, n))", {"n": "5"}, 120), ("Product(I*k, (k, 1, 3))", {}, -6j), ("Product(k, (k, 2, 1))", {}, 1),
        ("Sum(1/k, (k, 0, 3))", {}, "undefined"), ("Sum(1/k, (k, 1, oo))", {}, "undefined"), ("Sum(k, (k, 1, 2.5))", {}, "undefined"), ("Sum(x, (x, 1, 3)) + x", {"x": "10"}, 16),
        ("Derivative(x**3, x)", {"x_value": "2"}, 12), ("Derivative(sin(x), (x, 2))", {"x": "1"}, -math.sin(1)), ("Derivative(x**2*y, x, y)", {"x": "3", "y": "5"}, 6), ("Derivative(log(x), x)", {"x": "0.1"}, 10),
        ("Derivative(Abs(x), x)", {"x": "0"}, 0), ("Derivative(1/x, x)", {"x": "0"}, "undefined"), ("Derivative(Abs(x), (x, 2))", {"x": "0"}, "undefined"), ("Derivative(x**2, x)", {"y": "1"}, "undefined"), ("Integral(Sum(t**k, (k, 0, 3)), (t, 0, 1))", {}, 25 / 12),
        ("Integral(t, t)", {"t": "1"}, "parse error"), ("Sum(", {}, "parse error"), ("Sum(k, (k, 1, Sum(j, (j, 1, 3))))", {}, "parse error"), ("Sum(Sum(Sum(i, (i, 1, 2)), (j, 1, 2)), (k, 1, 2))", {}, "undefined"),
        ("Integral(t, (t, 0, 2))", None, 2), ("x + 1", {"x": "1", "z": None}, 2), ("", {}, "empty"), (None, {}, "empty"), ("Sum(k, (k, 1, n))", {"n": "4", "z": None}, 10),
    ]
    rows = [(i, t, m, "kept") for i, (t, m, _) in enumerate(said)]
    df = spark.createDataFrame(rows + rows[:9], "i int, text string, given map<string,string>, row string")
    got = calculus.values(df, "text", "given").collect()
    assert len(got) == len(rows) + 9 and {r.row for r in got} == {"kept"}
    for r in got:
        text, _, want = said[r.i]
        assert (r.v.status == want) if isinstance(want, str) else abs(complex(r.v.re, r.v.im) - want) <= 1e-7 * max(1, abs(want)), (text, r.v)
    assert calculus.values(df.limit(0), "text", "given").count() == 0
    assert abs(sum(w * o**3 for w, o in zip(calculus.stencil(3), range(-4, 5), strict=True)) - 6) < 1e-12


def test_matrices_against_numpy(spark):
    rng = np.random.default_rng(5)
    ms = [rng.integers(-3, 4, (n, n)).tolist() for n in (1, 2, 3, 4, 5) for _ in range(12)] + [[[0, 1], [1, 0]], [[0, 0], [0, 0]], [[0, 2, 1], [0, 1, 3], [4, 0, 0]]]
    df = spark.createDataFrame(list(enumerate(ms)), "i int, m array<array<bigint>>")
    m, last = F.col("m"), F.size("m") - 1
    for r in df.select("i", matrices.determinant(m).alias("det"), matrices.characteristic(m).alias("poly"), matrices.cofactor(m, F.lit(0), last).alias("cofactor"), matrices.trace(m).alias("trace")).collect():
        a = np.array(ms[r.i], float)
        n = len(a)
        assert (r.det, r.trace) == (round(np.linalg.det(a)), a.trace()) and np.allclose(r.poly, np.poly(a), atol=1e-6)
        assert n == 1 or r.cofactor == round((-1) ** (n - 1) * np.linalg.det(np.delete(a[1:], n - 1, 1)))
    odd = spark.createDataFrame([(None,), ([],)], "m array<array<bigint>>")
    assert [r.d for r in odd.select(matrices.determinant(m).alias("d")).collect()] == [None, 1]
    huge = spark.createDataFrame([([[2**40, 1], [1, 2**40]],)], "m array<array<bigint>>")
    with pytest.raises(Exception, match="OVERFLOW"):
        huge.select(matrices.determinant(m)).collect()


def test_resultants(spark):
    rows = [([1, 0, -1], [1, -1], 0), ([1, 0, -1], [1, -3], 8), ([2, 3], [5], 5), ([5], [2, 3], 5), ([1, -3, 2], [1, 1, 1], 21)]
    df = spark.createDataFrame(rows, "p array<bigint>, q array<bigint>, want bigint")
    assert all(r.got == r.want for r in df.select("want", matrices.resultant(F.col("p"), F.col("q")).alias("got")).collect())
    cubics = spark.createDataFrame([([1, 5, 6], 1), ([1, 2, 3, 4], -200), ([2, 3], 1), ([1, -6, 12, -8], 0)], "p array<bigint>, want bigint")
    assert all(r.got == r.want for r in cubics.select("want", matrices.discriminant(F.col("p")).alias("got")).collect())


def test_training_mixture(spark):
    made_schema = "task_id string, latex_expression string, slice string, gated boolean, row_no long, test_cases array<struct<input:map<string,string>,output:string>>"
    case = lambda out: [({"x": "1"}, out)]
    slices = [*training_mixture.SHARES, *training_mixture.GATED_SHARES, None]
    made = spark.createDataFrame([(f"g{i}", f"y + {i}", slices[i % len(slices)], slices[i % len(slices)] in training_mixture.GATED_SHARES or None, i, case("1")) for i in range(2000)], made_schema)
    main = spark.createDataFrame([(f"m{i}", f"x + {i}", f"tag{i}") for i in range(300)], "task_id string, latex_expression string, tag string")
    none = main.limit(0)
    for gated in (False, True):
        assert abs(sum(training_mixture.slice_shares(gated).values()) - 1) < 1e-9
        got = training_mixture.training_mixture(main, made, none, 400, "1", gated).collect()
        assert len(got) == len({r.task_id for r in got}) == 400 and sum(r.task_id[0] == "m" for r in got) == 260
        assert [r.task_id for r in got] == [r.task_id for r in training_mixture.training_mixture(main, made.repartition(7), none, 400, "1", gated).collect()]
        quota = {name: round(140 * share) for name, share in training_mixture.slice_shares(gated).items()}
        over = max(0, sum(quota.values()) - 140)  # what rounding gives too many is cut
        assert sum(max(0, q - sum(r.slice == name for r in got)) for name, q in quota.items()) == over
        assert gated or not any(r.gated for r in got)
    short = training_mixture.training_mixture(main.limit(10), made.limit(50), none, 400, "1", True).count()
    assert short == 60 and training_mixture.training_mixture(none, made.limit(0), none, 10, "1").count() == 0
    with pytest.raises(ValueError, match="contaminated"):
        training_mixture.training_mixture(main, made, main, 400, "1")
    rows = [("a", "t", "ode", None, 1, case("1")), ("b", "t", "ode", None, 0, case("1")), ("c", "t", "ode", None, 2, case("2")), ("d", "x + 3", "ode", None, 3, case("1")), ("e", "u", "sets", True, 4, case("1")), ("f", None, "ode", False, 5, None)]
    few = spark.createDataFrame(rows, made_schema)
    assert {r.task_id for r in training_mixture.candidates(main, few).collect()} == {"b", "c", "f"}
    assert {r.task_id for r in training_mixture.candidates(main, few, True).collect()} == {"b", "c", "e", "f"}
