"""What the generated problems' plans hold, and results that only some keys show."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import gates, matrices, trees
from millrace.operators import generators as g
from millrace.plans import generation


def parts(tmp_path, keys):
    duckdb.sql(f"COPY (SELECT unnest({list(keys)})::BIGINT AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["numtheory", "special_functions", "ntheory_ext", "sets_cardinality", "matrix_scalars"])
def test_points_are_found_once_by_many_tasks(spark, name):
    df = g.generate(spark.range(100, numPartitions=1).withColumnRenamed("id", "i"), name, "1", include_gated=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1  # no inferred filter repeats the search
    assert df.rdd.getNumPartitions() > 1


def test_readback_plans_each_family_once(spark):
    plan = generation.notation_readback(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == len(generation.READABLE)


def test_number_theory_looks_values_up():
    t = next(t for t in g.FAMILIES["ntheory_ext"].templates if t.kind == "prime_count")
    assert "aggregate" not in g.truth("ntheory_ext", t)[0]


def test_blocks_find_the_points_of_the_plain_search(spark):
    name, f = generation.SAMPLING
    df = g.sampled(g.objects(spark.range(60).withColumnRenamed("id", "i"), name, f, "11"), name, f, "11")
    counts = {r["_t"]: r["n"] for r in df.groupBy("_t").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == counts[1] == counts[3] == 50 and 5 not in counts and 0 < counts[4] <= 50


def test_determinant_steps_are_values(spark):
    plan = spark.range(1).select(matrices.determinant(F.expr("array(array(2L, 1L), array(1L, 3L))")).alias("d"))
    assert plan.first()[0] == 5
    m = spark.range(1).selectExpr("transform(sequence(1, 4), r -> transform(sequence(1, 4), c -> CAST(r * c + id AS BIGINT))) AS m").select(matrices.determinant(F.col("m")).alias("d"))
    assert m.first()[0] == 0 and m._jdf.queryExecution().analyzed().toString().count("lambdafunction") < 20


def test_ties_are_rounded_as_sql_does(spark):
    values = [-1.825155, -2.396355, 0.5, -0.0000051, 1e11 + 0.3, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(generation.rounded(F.col("v"))).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchall()[0][0] for v in values]


def test_sampled_inputs_at_ties(spark, tmp_path):
    sf = parts(tmp_path, [1041, 1635])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    got = generation.QUERIES["sampled_inputs"](spark, sf).select("task_id", "case_index", "expected").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT task_id, case_index, expected FROM ({generation.ORACLES['sampled_inputs']})").fetchall())


def test_planted_faults_don_t_cancel(spark):
    """d/dx 4 / (x + 1) is -1 at x = 1: where x * truth is -1, the two parts of the fault used to add up to nothing."""
    f = g.FAMILIES["derivative"]
    t = next(k for k, t in enumerate(f.templates) if t.kind == "quotient")
    df = spark.range(1).selectExpr(f"{t} AS _t", "4 AS a", "1 AS b", "1 AS c", "2 AS m", "2 AS n", "1.0D AS x", "1.0D AS y", "1.0D AS bad")
    assert trees.names(trees.parse(generation.PLANTED_IN_VALUE)) == {"truth", "bad", "x"}
    assert not df.select(gates.holds("derivative", f, trees.parse(generation.PLANTED_IN_VALUE))).first()[0]
