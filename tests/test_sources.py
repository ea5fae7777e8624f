import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.sources import readers, writers
from millrace.streaming import resume

ROW = {"task_id": "a", "latex_expression": "x", "test_cases": [{"input": {"x": 1, "y": 2.5}, "output": 3}], "domain": "NaN", "complexity": 2}


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([ROW, {**ROW, "task_id": "b", "domain": "real"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"items": [ROW]}))
    (tmp_path / "c.jsonl").write_text(json.dumps(ROW) + "\n\n" + json.dumps(ROW) + "\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.json", json.dumps([ROW]))
    counts = [readers.problems(spark, str(tmp_path / n)).count() for n in ("a.json", "b.json", "c.jsonl", "d.zip")]
    assert counts == [2, 1, 2, 1]
    row = readers.problems(spark, str(tmp_path / "a.json")).orderBy("row_no").first()
    assert row.domain is None and row.output_type == "unknown" and row.test_cases[0].input == {"x": "1", "y": "2.5"} and row.test_cases[0].output == "3"
    assert readers.problems(spark, str(tmp_path / "none.json"), missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.problems(spark, str(tmp_path / "none.json"))


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["1.0", None]), ("b", ['x "y", z'])], "task_id string, outputs array<string>")
    writers.predictions(df, str(tmp_path / "p"))
    assert sorted(readers.predictions(spark, str(tmp_path / "p")).collect()) == sorted(df.collect())
    (tmp_path / "q.csv").write_text('id,outputs\n a ,"[1, null]"\nb,3.5\nc,"[1, oops"\n')
    got = {r.task_id: r.outputs for r in readers.predictions(spark, str(tmp_path / "q.csv")).collect()}
    assert got == {"a": ["1", None], "b": ["3.5"], "c": [None]}


def test_code_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("a", 'def f(x):\n    return "q, r"\n')], "task_id string, code string")
    writers.code(df, str(tmp_path / "c"))
    assert readers.code_table(spark, str(tmp_path / "c")).first().code.rstrip("\n") == df.first().code.rstrip("\n")
    (tmp_path / "log").write_text("done 1\nnoise\ndone 7\n")
    assert readers.last_match(spark, str(tmp_path / "log"), r"done (\d+)").first().found == "7"
    (tmp_path / "rec").write_text("p1 Python Solution: s1=====broken=====p2 Python Solution: s2")
    assert [tuple(r) for r in readers.records(spark, str(tmp_path / "rec")).collect()] == [("p1", "s1"), ("p2", "s2")]
    assert len(writers.manifest(spark, str(tmp_path / "log"))["log"]) == 64


def test_stream_resumes(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    verify = lambda df: df.select("task_id", F.size("test_cases").alias("n"))
    for k, ids in enumerate((["a", "b"], ["b", "c"])):
        (source / f"{k}.jsonl").write_text("".join(json.dumps({**ROW, "task_id": i}) + "\n" for i in ids))
        query = resume.verify_stream(spark, str(source), schemas.PROBLEM, verify, target, mark)
        query.processAllAvailable()
        query.stop()
    assert sorted(r.task_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_json_array_and_report(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, 'a "q"'), (2, None)], "n int, s string").repartition(3)
    for rows in (df, df.limit(1), df.limit(0)):
        writers.json_array(rows, str(tmp_path / "a"), ["n"])
        text = "\n".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
        assert json.loads(text) == [{k: v for k, v in r.asDict().items() if v is not None} for r in sorted(rows.collect())]
    path = writers.report(spark.createDataFrame([("m/1", 0.5)], "model string, accuracy double"), str(tmp_path), "m/1 x")
    row = spark.read.json(path).first()
    assert row.model == "m/1" and row.accuracy == 0.5 and path.endswith(f"m_1_x_{row.timestamp}")
    writers.jsonl(spark.createDataFrame([(1, 2)], "b int, a int"), str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("part-*")) == '{"a":2,"b":1}\n'


def test_publishable_rows(spark, tmp_path):
    cases = [({"y": "2", "x": "1"}, "3"), ({"x": "1"}, "1+-2j"), (None, None), ({"x": "0"}, "1.50+2j")]
    df = spark.createDataFrame([("a", "x", "s", None, None, cases, '{"k": 2, "b": "z"}'), ("b", "y", "s", "x", "c", [], None)], "task_id string, latex_expression string, solution string, sympy_exp string, truth_code string, test_cases array<struct<input:map<string,string>,output:string>>, metadata string")
    rows = {r.task_id: r for r in writers.publishable(df).collect()}
    assert list(rows["a"].asDict()) == list(writers.PUBLISHED) and (rows["a"].sympy_exp, rows["a"].truth_code, rows["b"].metadata) == ("", "", "{}")
    assert [(c.input, c.output) for c in rows["a"].test_cases] == [('{"x":"1","y":"2"}', "3.0"), ('{"x":"1"}', "1.0-2.0j"), ("{}", None), ('{"x":"0"}', "1.5+2.0j")]
    assert rows["a"].metadata == '{"b":"z","k":"2"}'
    assert [tuple(r) for r in writers.stage({"pool": df, "probe": df.limit(1)}, str(tmp_path / "s")).collect()] == [("pool", 2), ("probe", 1)]
    bad = df.where("task_id = 'a'").withColumn("test_cases", F.array(F.struct(F.create_map(F.lit("x"), F.lit("1")).alias("input"), F.lit("abc").alias("output"))))
    with pytest.raises(Exception, match="no number"):
        writers.publishable(bad).collect()


def test_metadata_of_other_keys(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({**ROW, "solution": "s", "zeta": [1, {"a": None}], "note": 'q "x"', "n": 2.5}) + "\n\n")
    row = readers.with_metadata(spark, str(tmp_path / "m.jsonl")).first()
    assert json.loads(row.metadata) == {"complexity": 2, "domain": "NaN", "n": 2.5, "note": 'q "x"', "zeta": [1, {"a": None}]} and row.solution == "s" and row.domain is None
    assert list(json.loads(row.metadata)) == sorted(json.loads(row.metadata))
