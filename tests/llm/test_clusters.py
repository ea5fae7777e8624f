"""Exponion clustering against a plain search, in exact arithmetic, with ties."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import clusters as c

TYPES = "id long, embedding array<double>"


def plain(v, at, rounds):
    """Lloyd's rounds in Python's integers; argmin gives the smaller number of equals."""
    for r in range(rounds + 1):
        d = ((v[:, None, :] - at[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            at = np.array([[sum(map(int, column)) // len(column) for column in v[own == k].T] if (own == k).any() else at[k] for k in range(len(at))])
    return own, d[np.arange(len(v)), own], at


def packed(rows):
    return {i: x for i, x in rows}


@pytest.mark.parametrize(("seed", "spread", "size"), [(1, 3, 2), (2, 40, 2), (3, 5, 8), (4, 1, 3)])
def test_like_a_plain_search(spark, seed, spread, size):
    """Coarse grids, on which many distances tie, equal centroids and clusters that run empty."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (400, size)).astype(float)
    x[:60] = x[0]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    found, at = c.clustered(spark.createDataFrame(rows, TYPES).repartition(5), clusters=9, rounds=5, size=size, scale=1)
    first = sorted(range(400), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:9]
    own, d, want = plain(x.astype(np.int64), x.astype(np.int64)[first], 5)
    got = {r.id: (r.cluster, r.distance) for r in found.collect()}
    assert [got[i] for i in range(400)] == list(zip(own.tolist(), d.tolist(), strict=True)) and (at == want).all()


def test_search_spares_distances():
    """Far groups: after the first round hardly a vector is measured against all centroids, and results stay exact."""
    rng = np.random.default_rng(7)
    v = (rng.integers(0, 30, (2000, 1)) * 1000 + rng.integers(-20, 20, (2000, 6))).astype(np.int64)
    at, before, took = v[:30].copy(), None, []
    cluster, upper, lower = np.full(2000, -1, np.int32), np.zeros(2000), np.zeros(2000)
    for _ in range(6):
        cluster, upper, lower, n = c.search(v, cluster, upper, lower, c.Centroids.of(at, before))
        d = ((v[:, None, :] - at[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all() and (np.sqrt(d.min(axis=1)) <= upper).all()
        assert (np.sqrt(np.partition(d, 1, axis=1)[:, 1]) >= lower).all()
        took.append(n)
        before, at = at, np.array([v[cluster == k].sum(axis=0) // max(1, (cluster == k).sum()) if (cluster == k).any() else at[k] for k in range(30)])
    assert took[0] == 60_000 and max(took[1:]) < 20_000


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(None if i == 5 else i % 30, rng.normal(size=64).tolist()) for i in range(40)] + [(50, [0.25] * 64)] * 7
    bad = [(60, None), (61, []), (62, [1.0] * 63), (63, [1.0] * 65), (64, [None] + [1.0] * 63), (65, [float("nan")] + [1.0] * 63), (66, [float("inf")] + [1.0] * 63), (67, [-float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({x: F.lit("z") for x in ("id", "v", "cluster", "upper", "sums", "of", "distance", "label")})
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want, got = con.sql(c.ORACLE), c.op11_clusters(spark, str(tmp_path))
    assert want.columns == got.columns
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str) and len(got) == len(good)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0]), (2, [3.0, 9.5])], TYPES)
    found, at = c.clustered(df, size=2, scale=1)
    assert sorted((r.id, r.distance) for r in found.collect()) == [(1, 0), (2, 0)] and len(at) == 2
    found, at = c.clustered(df.limit(0), size=2)
    assert found.count() == 0 and len(at) == 0
    with pytest.raises(Exception, match="would not fit a long"):
        c.clustered(spark.createDataFrame([(1, [1e30, 0.0])], TYPES), size=2)
