"""Guards against rows that also stand in held-out data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of at most so many rows and bytes of text is broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: 64-bit words of the filter that sifts texts' windows; a full one only saves less.
FILTER_WORDS = 1 << 18
#: Bytes of text that are hashed at once.
STRETCH = 1 << 20
#: An odd number, powers of which weigh the bytes of a window modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def _sized(df: DataFrame) -> DataFrame:
    bytes_ = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    n, size = df.agg(F.count("*"), sum(bytes_, F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def frozen_keys(parts: list[DataFrame], column: str) -> DataFrame:
    """The distinct keys of all held-out parts."""
    out = parts[0].select(column)
    for p in parts[1:]:
        out = out.union(p.select(column))
    return out.where(F.col(column).isNotNull()).distinct()


def _digest(key: str) -> Column:
    """What a key is joined by: 32 bytes, however long it is."""
    return F.unhex(F.sha2(F.col(key).cast("string"), 256))


def _guarded(df: DataFrame, frozen: DataFrame, key: str, how: str) -> DataFrame:
    guard = _sized(frozen.select(_digest(key).alias("_digest")).distinct())
    return df.withColumn("_digest", _digest(key)).join(guard, "_digest", how).drop("_digest")


def split(df: DataFrame, frozen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key isn't frozen, rows whose key is, with `reason`)."""
    return _guarded(df, frozen, key, "left_anti"), _guarded(df, frozen, key, "left_semi").withColumn("reason", F.lit("contaminated"))


def require_clean(df: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """df, or an error if any of its keys is frozen; to be called before anything is written."""
    hits = _guarded(df, frozen, key, "left_semi").limit(5).collect()
    if hits:
        raise ValueError(f"contaminated: {[h[key] for h in hits]}")
    return df


def leaked(cases: str = "test_cases") -> Column:
    """Whether a row that should hide its truth shows any of it."""
    return F.exists(F.col(cases), lambda c: c["output"].isNotNull()) | F.coalesce(F.trim("solution") != "", F.lit(False)) | F.coalesce(F.trim("sympy_exp") != "", F.lit(False))


def complete(required: list[str], line: Column) -> Column:
    """Whether a JSON object has all the keys."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")))) == 0


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive bytes, from one running sum: taking a difference and a power of BASE out makes it independent of the place."""
    n = max(0, len(data) - size + 1)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), BASE, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), pow(BASE, -1, 2**64), np.uint64)]))[:n]
    h = (total[size:] - total[:n]) * back
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _spread(hashes: np.ndarray, size: int) -> np.ndarray:
    return hashes * np.uint64(2 * size + 1)


def _short_windows(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, item_id, needle) proposed for needles with few words, of docs(doc_id, text).

    A needle is looked for by its first 1, 2, 4, .. bytes, as many as it has. Texts' windows of those sizes pass a filter of fixed size and are joined by hash.
    """
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, hashes = [], []
            for t in b.column("needle").to_pylist():
                raw = np.frombuffer(t.encode(), np.uint8)
                sizes.append(1 << (len(raw).bit_length() - 1))
                hashes.append(_spread(window_hashes(raw[: sizes[-1]], sizes[-1]), sizes[-1])[0])
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("needle"), pa.array(sizes, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))], ["item_id", "needle", "size", "hash"])

    kind = needles.schema["item_id"].dataType.simpleString()
    keyed = needles.select("item_id", "needle").mapInArrow(first, f"item_id {kind}, needle string, size int, hash long")
    sizes = sorted(r[0] for r in keyed.select("size").distinct().collect())  # a size a power of two
    place = F.pmod("hash", F.lit(FILTER_WORDS * 64))
    marks = keyed.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")).toArrow()  # FILTER_WORDS rows at most
    mask = np.zeros(FILTER_WORDS, np.int64)
    mask[marks.column("w").to_numpy()] = marks.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(mask)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text").cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STRETCH, "right")))
                raw = np.frombuffer(b"".join(text.slice(i, j - i).to_pylist()), np.uint8)
                until = ends[i:j] - (ends[i - 1] if i else 0)
                for size in sizes:
                    h = _spread(window_hashes(raw, size), size).view(np.int64)
                    p = np.mod(h, FILTER_WORDS * 64)
                    at = np.flatnonzero((shared.value[p >> 6] >> (p & 63)) & 1)
                    of = np.searchsorted(until, at, "right")
                    inside = at + size <= until[of]
                    pair = np.unique(np.stack([of[inside], h[at[inside]]]), axis=1)
                    if pair.shape[1]:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(pair[0] + i)), pa.array(np.full(pair.shape[1], size, np.int32)), pa.array(pair[1])], ["doc_id", "size", "hash"])
                i = j

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(windows, f"doc_id {kind}, size int, hash long")
    return found.join(_sized(keyed), ["size", "hash"]).select("doc_id", "item_id", "needle")


def substring_hits(docs: DataFrame, needles: DataFrame, k: int = 5) -> DataFrame:
    """(doc, needle ids) where a needle's text occurs in a document's: docs(doc_id, text), needles(item_id, text).

    A needle's words, its first and last left out as they may be cut in the document, give its longest-looking k-word
    sequence; an equality join on sequences' hashes proposes, contains() decides. Needles with too few words are proposed by windows of bytes.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    seq = lambda a, i: F.slice(a, i, k)
    n = needles.where("text is not null and text <> ''").select("item_id", F.col("text").alias("needle"))
    n = n.withColumn("_w", words(F.col("needle")))
    n = n.withColumn("_in", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    long_of = lambda i: F.struct(F.length(F.array_join(seq(F.col("_in"), i), " ")).alias("l"), F.xxhash64(seq(F.col("_in"), i)).alias("s"))
    longest = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_in") - k + 1), long_of))["s"]
    long_ones = n.where(F.size("_in") >= k).withColumn("_s", longest).select("item_id", "needle", "_s")
    short_ones = n.where(F.size("_in") < k).select("item_id", "needle")
    d = docs.where("text is not null").select("doc_id", "text")
    grams = d.withColumn("_w", words(F.col("text"))).where(F.size("_w") >= k)
    grams = grams.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.xxhash64(seq(F.col("_w"), i))))).alias("_s"))
    proposed = grams.join(_sized(long_ones), "_s").select("doc_id", "item_id", "needle")
    if not short_ones.isEmpty():
        proposed = proposed.union(_short_windows(d, short_ones))
    return proposed.distinct().join(d, "doc_id").where(F.contains("text", "needle")).select("doc_id", "item_id")
