"""Every library query against its SQL over the smallest tables."""

import duckdb
import pytest

from millrace.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=key) == sorted((plain(tuple(r[i] for i in order)) for r in want.fetchall()), key=key)


def test_every_query_but_the_drawn_ones_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"bootstrap_interval"}
