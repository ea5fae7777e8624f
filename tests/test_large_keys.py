"""Queries that run code, at keys as large as larger tables have, against their SQL."""

import duckdb
import pytest

from millrace.plans import execution

NAMES = ["sandbox_exec", "oracle_verify", "curated", "rewards", "verified_stream", "resampled_cases", "model_benchmark"]


@pytest.fixture(scope="module")
def suppliers(tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("large"))
    duckdb.sql(f"COPY (SELECT k::BIGINT AS s_suppkey FROM (SELECT unnest(range(5000, 5030)) AS k UNION ALL SELECT unnest(range(59900, 59930)))) TO '{sf}/supplier.parquet' (FORMAT parquet)")
    return sf


@pytest.mark.parametrize("name", NAMES)
def test_query_at_large_keys(spark, suppliers, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{suppliers}/supplier.parquet'")
    df = execution.QUERIES[name](spark, suppliers)
    want = con.sql(execution.ORACLES[name])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


def test_a_spoilt_solution_is_wrong_on_both_sides_of_a_condition(spark):
    code = "def calculate(x, y):\n    return 1.0 if x > 2 else -1.0\n"
    said = spark.createDataFrame([(code,)], "s string").select(execution.spoilt(execution.F.col("s"))).first()[0]
    space = {}
    exec(said, space)
    assert {space["calculate"](x, 0) for x in (1, 3)} == {"no"}
