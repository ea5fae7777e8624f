"""Centroid clustering of whole-number vectors by Exponion search, exact to the last unit.

Each vector carries its cluster, an upper bound of its distance to that centroid and a lower bound of its distance to all others. When
centroids have moved, the bounds widen by the moves. A vector whose upper bound stays under its lower bound, or under half the way from its centroid to
the next one, keeps its cluster unseen. Any other is measured against its own centroid, and if that doesn't settle it, against the centroids in a ball around its own one:
those of the centroid's sorted distance list up to twice its distance plus the way to the next centroid. The ball holds the two nearest centroids.

Distances are compared as whole numbers, and ties go to the smaller number. Bounds are floats with a margin outwards, skips need a strict
inequality, and the ball's radius is inclusive, so that no tie is skipped.

A round is one pass over the vectors, without a shuffle. A task hands on only what its vectors that changed cluster add to the clusters' sums; Spark adds those up
to one row a cluster. Each round's table lies in the shared folder and replaces the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, stored, table

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: Beyond this, squared distances could leave a 64-bit integer.
LARGEST = 2**27
#: Added to components that are packed as unsigned 32-bit numbers, the highest byte first, so that packed vectors sort as vectors do.
ZERO = 2**31
#: Relative margin of the bounds; a float's rounding is under a thousandth of it.
MARGIN = 1e-12
#: Vectors that are measured at once.
STRETCH = 4096
TYPES = "id long, v binary, cluster int, upper double, lower double, sums array<struct<cluster:int,count:long,sum:array<long>>>"


class Centroids(NamedTuple):
    """Centroids, and what a round needs to know of them."""

    at: np.ndarray  # whole numbers, a row a centroid
    order: np.ndarray  # the other centroids of each, nearest first; itself stands first
    far: np.ndarray  # their distances in that order
    moved: np.ndarray  # how far each came since the round before

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        squared = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(squared, -1)  # itself first, also among equals
        order = np.argsort(squared, axis=1, kind="stable")
        far = np.sqrt(np.maximum(np.take_along_axis(squared, order, axis=1), 0).astype(float))
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(float))
        return Centroids(at, order, far, moved)

    def next(self) -> np.ndarray:
        """The way from each centroid to the next one."""
        return self.far[:, 1] if len(self.at) > 1 else np.full(len(self.at), np.inf)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to its own row of c, or to c where that is one centroid."""
    return ((v - c) ** 2).sum(axis=1)


def nearest(v: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the centroids `numbers`: each vector's nearest (the smaller number of equals), its squared distance, and that of the next nearest."""
    numbers = np.sort(numbers)
    d = np.stack([distances(v, x) for x in at[numbers]], axis=1)
    best = d.argmin(axis=1)
    least = d[np.arange(len(v)), best]
    if len(numbers) == 1:
        return numbers[best], least, np.full(len(v), np.inf)
    return numbers[best], least, np.partition(d, 1, axis=1)[:, 1].astype(float)


def search(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The vectors' clusters and bounds for c's centroids, and how many distances it took. cluster -1: not yet in any."""
    cluster, upper, lower, took = cluster.copy(), upper.copy(), lower.copy(), 0
    new = np.flatnonzero(cluster < 0)
    if len(new):
        cluster[new], least, second = nearest(v[new], np.arange(len(c.at)), c.at)
        upper[new], lower[new] = np.sqrt(least.astype(float)) * (1 + MARGIN), np.sqrt(second) * (1 - MARGIN)
        took += len(new) * len(c.at)
    old = np.ones(len(v), bool)
    old[new] = False
    others = c.moved.copy()
    if len(c.at) > 1:  # the largest move of any other centroid
        top = np.argsort(-c.moved, kind="stable")[:2]
        others[:] = c.moved[top[0]]
        others[top[0]] = c.moved[top[1]]
    upper[old] = (upper[old] + c.moved[cluster[old]]) * (1 + MARGIN)
    lower[old] = np.maximum(lower[old] - others[cluster[old]], 0) * (1 - MARGIN)
    safe = np.maximum(lower, c.next()[cluster] / 2 * (1 - MARGIN))
    open_ = np.flatnonzero(old & (upper >= safe))
    if len(open_):
        own = distances(v[open_], c.at[cluster[open_]])
        took += len(open_)
        upper[open_] = np.sqrt(own.astype(float)) * (1 + MARGIN)
        open_ = open_[upper[open_] >= safe[open_]]
    for home in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == home]
        radius = (2 * upper[rows] + c.next()[home]) * (1 + MARGIN)
        inside = np.searchsorted(c.far[home], radius, "right")
        for n in np.unique(inside):
            some = rows[inside == n]
            cluster[some], least, second = nearest(v[some], c.order[home][:n], c.at)
            upper[some], lower[some] = np.sqrt(least.astype(float)) * (1 + MARGIN), np.sqrt(second) * (1 - MARGIN)
            took += len(some) * int(n)
    return cluster, upper, lower, took


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """A column of packed vectors as rows of whole numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, size).astype(np.int64) - ZERO


def whole(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, v, ..) of vectors(id, embedding): those of `size` components, none null or non-finite, as packed whole numbers floor(scale * x).

    Vectors beyond 32 bits, whose distances a long can't hold, stop the job with an error.
    """
    kept = vectors.select("id", F.col("embedding").cast("array<double>").alias("e"))
    kept = kept.where((F.size("e") == size) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("e")
            x = np.floor(e.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is larger than {LARGEST / scale:g}: squared distances would not fit a long")
            rows = pa.array([r.tobytes() for r in (x.astype(np.int64) + ZERO).astype(">u4")], pa.binary())
            n = len(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), rows, pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.nulls(n, SUMS)], NAMES)

    return kept.mapInArrow(run, TYPES)


SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("count", pa.int64()), ("sum", pa.list_(pa.int64()))]))
NAMES = [x.split()[0] for x in TYPES.split(", ")]


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, size: int = SIZE) -> np.ndarray:
    """The vectors with the least SHA-256 of `seed:id`, one a row; those without id come last, equal ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).toArrow()
    return unpacked(rows.column("v").combine_chunks(), size)


def one_round(state: DataFrame, c: Centroids, size: int = SIZE) -> DataFrame:
    """The state after a search, and per task a row with what it adds to the clusters' sums."""
    k = len(c.at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for i in range(0, len(batch), STRETCH):
                b = batch.slice(i, STRETCH)
                v = unpacked(b.column("v"), size)
                was = b.column("cluster").to_numpy()
                now, upper, lower, _ = search(v, was, b.column("upper").to_numpy(), b.column("lower").to_numpy(), c)
                other = np.flatnonzero(was != now)
                for rows, of, sign in ((other, now, 1), (other[was[other] >= 0], was, -1)):
                    np.add.at(count, of[rows], sign)
                    np.add.at(total, of[rows], sign * v[rows])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(now.astype(np.int32)), pa.array(upper), pa.array(lower), pa.nulls(len(b), SUMS)], NAMES)
        some = np.flatnonzero(count.astype(bool) | total.any(axis=1))
        if len(some):
            sums = [{"cluster": int(j), "count": int(count[j]), "sum": total[j].tolist()} for j in some]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([sums], SUMS)], NAMES)

    return state.where("v is not null").select(*NAMES).mapInArrow(run, TYPES)


def added(state: DataFrame, k: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """What the state's tasks add to the counts and sums of the clusters: one row a cluster reaches the driver."""
    rows = state.where("sums is not null").select(F.inline("sums"))
    rows = rows.groupBy("cluster").agg(F.sum("count").alias("count"), F.array(*(F.sum(F.col("sum")[i]) for i in range(size))).alias("sum"))
    count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for r in rows.collect():  # clusters' number of rows
        count[r["cluster"]], total[r["cluster"]] = r["count"], r["sum"]
    return count, total


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance) of vectors(id, embedding), and the centroids of the last assignment.

    Null embeddings, those of another length and those with null or non-finite components are left out. Equal vectors, repeated and
    null ids are rows of their own. With fewer vectors than clusters there are as many centroids as vectors; without vectors none and no row.
    """
    state = stored(whole(vectors, size, scale), "clusters")
    at, before = first_centroids(state, clusters, seed, size), None
    count, total = np.zeros(len(at), np.int64), np.zeros_like(at)
    for r in range(rounds + 1 if len(at) else 0):
        old, state = state, stored(one_round(state, Centroids.of(at, before), size), "clusters")
        discard(old)
        if r < rounds:
            more, sums = added(state, len(at), size)
            count, total, before = count + more, total + sums, at
            at = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], at)
    last = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, own = unpacked(b.column("v"), size), b.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("cluster"), pa.array(distances(v, last[own]))], ["id", "v", "cluster", "distance"])

    return state.where("v is not null").select("id", "v", "cluster").mapInArrow(run, "id long, v binary, cluster int, distance long"), at


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its cluster, squared distance, the inertia of the cluster and of all, and the hash of the cluster's centroid."""
    vectors = table(spark, sf_dir, "embeddings", F.col("vec_id").cast("long").alias("id"), "embedding")
    found, at = clustered(vectors)
    found = stored(found.drop("v"), "clusters-found")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()  # a row a cluster
    everything = sum(int(r["i"]) for r in per)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    schema = T.StructType([T.StructField("of", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    facts = spark.createDataFrame([(r["cluster"], int(r["i"]), everything, hashes[r["cluster"]]) for r in per], schema)
    joined = found.join(F.broadcast(facts), F.col("cluster") == F.col("of"))  # CLUSTERS rows at most
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, each vector against all centroids."""
    d2 = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    place = lambda r: f"a{r} AS MATERIALIZED (SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.row, c.k, {d2} AS d FROM v, c{r} c) q GROUP BY row)"
    move = lambda r: f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS c FROM (
      SELECT k, i, (s - ((s % n) + n) % n) // n AS floor_sum FROM (
        SELECT a.k, i, sum(v.v[i]) AS s, count(*) AS n FROM a{r} a JOIN v ON v.row = a.row, range(1, {SIZE + 1}) t(i) GROUP BY a.k, i) s1) s2 GROUP BY k) m ON m.k = c.k)"""  # noqa: E731
    steps = ",\n".join(x for r in range(ROUNDS) for x in (place(r), move(r)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {SIZE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM v ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v LIMIT {CLUSTERS}),
{steps},
{place(ROUNDS)}
SELECT v.vec_id, CAST(a.k AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.row = a.row JOIN c{ROUNDS} c ON c.k = a.k
"""


ORACLE = _oracle()
