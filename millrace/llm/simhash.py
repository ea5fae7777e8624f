"""SimHash fingerprints, and all links of at most NEAR differing bits by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together. If the parts' thresholds (a part's threshold is -1 where it is left out) sum to NEAR + 1 less than
the number of parts, any two fingerprints that link differ, in some part, by no more than its threshold. So each fingerprint may choose its own thresholds, looks
up all values within them, and misses none of its links. It chooses by dynamic programming over the parts: the least sum of estimated candidates and
lookups. Candidates are estimated from counts of all fingerprints' bit patterns (at most 16 bits at a time, patterns of a part taken as independent), by distance.

A part has at least as many values as there are fingerprints (up to 32 bits), so that a chance candidate is rare at any size. Where all choices are
crowded, a fingerprint gives out the 65 points within one bit of it: two fingerprints link exactly if they share such a point, and a point has 65 owners at
most. A link between a crowded fingerprint and another is found by that one's lookups. So no choice emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens as tk
from millrace.llm.common import components, discard, stored, table

BITS, NEAR, SHINGLE, SEED = 64, 2, 3, 42
#: Estimated candidates and lookups above which a fingerprint's choices count as crowded.
CROWDED = 256
#: Bits of the patterns that are counted.
CELL = 16
#: Shingles whose bits are counted at once.
STRETCH = 1 << 16
U = np.uint64


def to_bits(fingerprints: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each number, the highest bit first."""
    return np.unpackbits(fingerprints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), axis=1).reshape(-1).view(">u8").astype(U)


def simhash(texts: pa.Array, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text: the bits that more than half of its k-word shingles' hashes have."""
    w = tk.split_words(texts, lower=True)
    length = w.end - w.start
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)  # the words with one space behind each
    solid = np.flatnonzero(~tk.SPACE[w.data])
    joined[np.arange(len(solid)) + np.repeat(np.arange(len(length)), length)] = w.data[solid]
    end = np.cumsum(length + 1) - 1
    start = end - length
    words = np.diff(w.first)
    n = np.where(words < k, np.minimum(words, 1), words - k + 1)
    of = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + w.first[of]
    low, high, body = start[at], end[np.minimum(at + k - 1, w.first[of + 1] - 1)], joined.tobytes()
    count = np.zeros((len(words), BITS), np.int64)
    for i in range(0, len(of), STRETCH):
        j = min(len(of), i + STRETCH)
        h = np.fromiter((xxhash.xxh64_intdigest(body[a:b], seed) for a, b in zip(low[i:j].tolist(), high[i:j].tolist(), strict=True)), U, j - i)
        own, first = np.unique(of[i:j], return_index=True)
        count[own] += np.add.reduceat(to_bits(h), first, axis=0, dtype=np.int64)
    return from_bits(2 * count > n[:, None])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text), fp a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), tk.signed(simhash(b.column("text")))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def together(nodes: DataFrame) -> np.ndarray:
    """How often each two bits are both set, over all fingerprints; each task hands on 64 rows, and the sum reaches the driver as 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = to_bits(b.column("fp").to_numpy().view(U)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS)), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "n"])

    rows = nodes.select("fp").mapInArrow(run, "i long, n array<long>").groupBy("i").agg(F.array(*(F.sum(F.col("n")[j]) for j in range(BITS))).alias("n"))
    total = np.zeros((BITS, BITS), np.int64)
    for r in rows.collect():
        total[r["i"]] = r["n"]
    return total


def arranged(both: np.ndarray, n: int, widths: list[int]) -> list[list[int]]:
    """The bits of each part: a part starts with the bit that is most correlated to those left, and takes the most correlated to its own."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = list(range(BITS)), []
    for width in widths:
        own = [max(left, key=lambda b: (r[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (r[b, own].sum(), -b)))
            left.remove(own[-1])
        parts.append(own)
    return parts


def part_widths(n: int) -> list[int]:
    """As many parts as have at least n values each, four at most and two at least."""
    m = max(2, min(4, BITS // max(1, (n - 1).bit_length())))
    return [BITS // m + (i < BITS % m) for i in range(m)]


class Layout:
    """Parts of the turned fingerprints (bits in the order of the parts), cells of at most CELL bits in them, and the ways to share out thresholds."""

    def __init__(self, parts: list[list[int]]) -> None:
        self.order = [b for part in parts for b in part]
        self.widths = [len(p) for p in parts]
        self.shifts = [BITS - sum(self.widths[: i + 1]) for i in range(len(parts))]
        self.cells: list[list[tuple[int, int]]] = []  # of each part: (shift, width)
        for shift, width in zip(self.shifts, self.widths, strict=True):
            k = -(-width // CELL)
            sizes = [width // k + (i < width % k) for i in range(k)]
            self.cells.append([(shift + width - sum(sizes[: i + 1]), s) for i, s in enumerate(sizes)])

    def turned(self, fp: np.ndarray) -> np.ndarray:
        return from_bits(to_bits(fp)[:, self.order])

    def masks(self, part: int, distance: int) -> list[int]:
        """What to XOR a part's value with for all values within a distance."""
        return [sum(1 << b for b in some) for d in range(distance + 1) for some in combinations(range(self.widths[part]), d)]

    def value(self, t: Column, part: int) -> Column:
        return F.shiftrightunsigned(t, self.shifts[part]).bitwiseAND(F.lit((1 << self.widths[part]) - 1).cast("long"))


def counted(turned: DataFrame, layout: Layout) -> list[np.ndarray]:
    """For each cell, how many fingerprints have each pattern, are one bit from it, and two: an array (3, 2**width).

    At most 4 * 2**CELL rows reach the driver, whatever the number of fingerprints.
    """
    cells = [c for part in layout.cells for c in part]
    patterns = F.array(*(F.shiftrightunsigned("t", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in cells))
    rows = turned.select(F.posexplode(patterns).alias("cell", "pattern")).groupBy("cell", "pattern").count().toArrow()
    cell, pattern, count = (rows.column(c).to_numpy() for c in ("cell", "pattern", "count"))
    out = []
    for i, (_, w) in enumerate(cells):
        here, every = np.zeros(1 << w), np.arange(1 << w)
        here[pattern[cell == i]] = count[cell == i]
        one = sum(here[every ^ (1 << b)] for b in range(w))
        out.append(np.stack([here, one, (sum(one[every ^ (1 << b)] for b in range(w)) - w * here) / 2]))
    return out


def chosen(t: np.ndarray, layout: Layout, counts: list[np.ndarray], n: int) -> np.ndarray:
    """Each fingerprint's thresholds plus one, a digit to the base NEAR + 2 a part; -1 if all choices are crowded."""
    units, cell = NEAR + 1, 0
    best = np.full((len(t), units + 1), np.inf)
    best[:, 0] = 0
    code = np.zeros((len(t), units + 1), np.int64)
    for part, cells in enumerate(layout.cells):
        # How many fingerprints are expected at each distance in this part.
        near = None
        for shift, width in cells:
            h = counts[cell][:, ((t >> U(shift)) & U((1 << width) - 1)).astype(np.int64)]
            near = h if near is None else np.stack([sum(near[i] * h[d - i] for i in range(d + 1)) / n for d in range(NEAR + 1)])
            cell += 1
        lookups = [len(layout.masks(part, d)) for d in range(NEAR + 1)]
        price = [np.zeros(len(t)), *(np.cumsum(near, axis=0) + np.array(lookups)[:, None])]
        new, digits = np.full_like(best, np.inf), np.zeros_like(code)
        for had in range(units + 1):
            for more in range(units + 1 - had):
                cost = best[:, had] + price[more]
                better = cost < new[:, had + more]
                new[better, had + more] = cost[better]
                digits[better, had + more] = code[better, had] + more * (NEAR + 2) ** part
        best, code = new, digits
    return np.where(best[:, units] > CROWDED, -1, code[:, units])


def lookups(spark: SparkSession, layout: Layout) -> DataFrame:
    """(choice, part, mask) of every way to share out NEAR + 1 units: some thousand rows at most."""
    m, base = len(layout.widths), NEAR + 2
    rows = []
    for choice in range(base**m):
        digits = [choice // base**p % base for p in range(m)]
        if sum(digits) == NEAR + 1:
            rows += [(choice, p, x) for p, d in enumerate(digits) if d for x in layout.masks(p, d - 1)]
    return spark.createDataFrame(rows, "choice long, part int, mask long")


def links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, t) of nodes(fp), t being the turned fingerprint, and links (a, b) between t's that join all of each component.

    All links of fingerprints that aren't crowded are there; crowded ones are linked to the least owner of each point that they share.
    """
    spark, n = nodes.sparkSession, nodes.count()
    layout = Layout(arranged(together(nodes), n, part_widths(n)))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("fp"), tk.signed(layout.turned(b.column("fp").to_numpy().view(U)))], ["fp", "t"])

    turned = stored(nodes.select("fp").mapInArrow(turn, "fp long, t long"), "simhash-turned")
    shared = spark.sparkContext.broadcast(counted(turned, layout))  # 6 MiB at most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(chosen(b.column("t").to_numpy().view(U), layout, shared.value, n))], ["t", "choice"])

    plans = stored(turned.select("t").mapInArrow(choose, "t long, choice long"), "simhash-plans")
    t, parts = F.col("t"), range(len(layout.widths))
    of_part = lambda part: F.element_at(F.array(*(layout.value(t, p) for p in parts)), part + 1)
    probes = plans.where("choice >= 0").join(F.broadcast(lookups(spark, layout)), "choice").select("t", "part", of_part(F.col("part")).bitwiseXOR(F.col("mask")).alias("value"))
    index = turned.select(t.alias("x"), F.posexplode(F.array(*(layout.value(t, p) for p in parts))).alias("of", "own"))
    met = (F.col("part") == F.col("of")) & (F.col("value") == F.col("own")) & (F.col("t") != F.col("x")) & (F.bit_count(F.col("t").bitwiseXOR(F.col("x"))) <= NEAR)
    found = probes.join(index, met).select(t.alias("a"), F.col("x").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)))
    points = plans.where("choice < 0").select("t", F.explode(flips).alias("flip")).select("t", t.bitwiseXOR(F.col("flip")).alias("point"))
    owners = points.groupBy("point").agg(F.collect_list("t").alias("owners")).where(F.size("owners") > 1)  # 65 at most
    stars = owners.select(F.array_min("owners").alias("b"), F.explode("owners").alias("a")).where("a <> b").select("a", "b")
    out = stored(found.union(stars), "simhash-links")
    discard(plans)
    return turned, out


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fp, component_id (the least doc_id that links lead to).

    Null, empty and blank texts have fingerprint 0, which links like any other. Texts of any length count whole. Rows that share a doc_id are documents of
    their own; rows without one have the component of their fingerprint, null if no row with a doc_id is in it. Other columns don't matter.
    """
    rows = stored(fingerprints(docs), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    turned, pairs = links(nodes)
    parts = components(pairs)
    linked = turned.join(parts, F.col("t") == F.col("node")).select("fp", "component").join(nodes, "fp")
    linked = stored(linked, "simhash-linked")  # only fingerprints that have links
    least = linked.groupBy("component").agg(F.min("least").alias("first"))
    label = nodes.join(linked.join(least, "component").select("fp", "first"), "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    # Stored, so that nothing above the join with rows keeps a group of copies from being split.
    label = stored(label.select(F.col("fp").alias("of"), "component_id"), "simhash-labels")
    done = stored(rows.join(label, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id"), "simhash-done")
    discard(rows, nodes, turned, pairs, linked, label)
    return done


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint in hexadecimal and its component."""
    found = near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
