"""Fuzzy line dedup by MinHash.

Lines are compared without the white space around them and with A-Z in lower case; blank lines stay and are compared with none.

1. Each distinct line gets a one-permutation MinHash of its character shingles, cut into bands. Lines that agree in a band
   share a group; BANDS bands of ROWS values find a pair of similarity 0.8 with probability 0.986, if bins were independent, and
   one of 0.3, as unrelated lines of a language have, with 0.01.
2. Groups are cut where the numbers of distinct shingles leave no similar pair. Lines that meet in groups with the same least member become one
   signature tree (see jaccard), so that no group is too large for a task.
3. Pairs that the trees let through are verified by the exact Jaccard similarity of their shingles, and distributed union-find makes components.
4. Of each component the line that comes first, by doc_id, then place, then text, stays; all other occurrences go.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard
from millrace.llm import tokens as tk
from millrace.llm.common import bit_filter, components, discard, passes, stored, table

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 14, 6
U = tk.U
#: A shingle's hash below the number of its line, in one 64-bit integer; a stretch has fewer lines than the rest can tell apart.
HASH_BITS = U(50)
LINES_AT_ONCE = 1 << 14
#: Bytes of a stretch: what fits a core's cache.
STRETCH = 1 << 16


class Lines(NamedTuple):
    data: np.ndarray
    doc: np.ndarray  # the text of each line
    number: np.ndarray  # its place in the text
    start: np.ndarray  # without white space around
    end: np.ndarray


def split_lines(texts: pa.Array) -> Lines:
    """The lines that aren't blank."""
    data, offsets = tk.column_bytes(texts, lower=True)
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A text's first line begins at its offset; empty texts share theirs with the next.
    doc = np.searchsorted(offsets, begin, "right") - 1
    stop = np.append(begin[1:], len(data))
    at_break = np.zeros(len(data) + 1, bool)
    at_break[breaks + 1] = True
    keep = (doc < len(offsets) - 1) & (begin < np.append(offsets[1:], 0)[np.minimum(doc, len(offsets) - 1)])
    begin, stop, doc = begin[keep], stop[keep], doc[keep]
    new = np.concatenate([[True], begin[1:] != begin[:-1]]) if len(begin) else np.zeros(0, bool)
    begin, doc = begin[new], doc[new]
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[doc + 1])
    first = np.searchsorted(doc, doc)
    number = np.arange(len(doc)) - first
    solid = np.flatnonzero(~tk.SPACE[data])
    i, j = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
    some = j > i
    return Lines(data, doc[some], number[some], solid[i[some]], solid[j[some] - 1] + 1)


def segments(lines: Lines) -> Iterator[tuple[int, int]]:
    """Stretches of lines of about STRETCH bytes."""
    i = 0
    while i < len(lines.start):
        j = min(i + LINES_AT_ONCE, max(i + 1, int(np.searchsorted(lines.end, lines.start[i] + STRETCH))))
        yield i, j
        i = j


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = tk.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(tk.BYTE[data] * up[:-1], out=total[1:])
    return total, down


def line_hashes(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each line."""
    out = np.empty(len(lines.start), U)
    for i, j in segments(lines):
        at = lines.start[i]
        total, down = _prefix(lines.data[at : lines.end[j - 1]])
        s, e = lines.start[i:j] - at, lines.end[i:j] - at
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(U)
    return tk.mix(out), tk.mix(out * U(0xD1342543DE82EF95) + U(1))


def line_shingles(lines: Lines) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, found) stretch by stretch: the distinct shingle hashes of lines [i, j), sorted, each below its line's number less i."""
    for i, j in segments(lines):
        at, n = lines.start[i], j - i
        data = lines.data[at : lines.end[j - 1]]
        total, down = _prefix(data)
        s, e = lines.start[i:j] - at, lines.end[i:j] - at
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        low, high = np.searchsorted(chars, s), np.searchsorted(chars, e)
        t, d = total[chars], down[chars[:-1]]
        last = max(0, len(chars) - SHINGLE)  # shingles that the stretch has, those over a line's end included
        every = (t[SHINGLE:] - t[:last]) * d[:last]
        m = high - low - SHINGLE + 1
        full = np.flatnonzero(m > 0)
        inside = np.zeros(last + 1, np.int8)
        inside[low[full]] += 1
        inside[high[full] - SHINGLE + 1] -= 1
        line = np.repeat(full, m[full])
        found = every[np.cumsum(inside[:last], dtype=np.int8).view(bool)]
        if len(full) < n:  # a shorter line is one shingle
            short = np.flatnonzero(m <= 0)
            line, found = np.append(line, short), np.append(found, (t[high[short]] - t[low[short]]) * d[low[short]])
        found = tk.mix(found)
        found >>= U(64) - HASH_BITS
        found |= line.astype(U) << HASH_BITS
        found.sort()
        yield i, j, found[np.concatenate([[True], found[1:] != found[:-1]])]


def signatures(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of each line, a row a line, and its number of distinct shingles."""
    bins = BANDS * ROWS
    out, size = np.empty((len(lines.start), BANDS), U), np.empty(len(lines.start), np.int32)
    weight = tk.mix(np.arange(1, ROWS + 1, dtype=U)) | U(1)
    for i, j, found in line_shingles(lines):
        line, h = (found >> HASH_BITS).astype(np.int64), found & U((1 << int(HASH_BITS)) - 1)
        size[i:j] = np.bincount(line, minlength=j - i)
        cell = line * bins + (((h >> (HASH_BITS - U(32))) * U(bins)) >> U(32)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # a bin's least hash comes first
        least, full = np.zeros((j - i) * bins, U), np.zeros((j - i) * bins, bool)
        least[cell[new]], full[cell[new]] = tk.mix(h[new]), True
        # An empty bin borrows from the next full one, round the end.
        place = np.where(full.reshape(-1, bins), np.arange(bins), 2 * bins)
        place = np.concatenate([place, place + bins], axis=1)
        place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :bins]
        final = np.take_along_axis(least.reshape(-1, bins), place % bins, axis=1) + (place - np.arange(bins)).astype(U) * tk.BASE
        final = final.reshape(-1, BANDS, ROWS)
        band = final[:, :, 0] * weight[0]
        for r in range(1, ROWS):
            band += final[:, :, r] * weight[r]
        out[i:j] = tk.mix(band + np.arange(BANDS, dtype=U))
    return out, size


def registry(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, node, node2, n, keys): every line of docs(doc_id, row, text) that isn't blank, with 128 bits of hash.

    n (distinct shingles) and keys (of bands) stand where a task meets a line for the first time, mostly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in tk.slices(batch):
                lines = split_lines(b.column("text"))
                node, node2 = line_hashes(lines)
                first = _new(node, seen)
                keys, size = signatures(Lines(lines.data, *(x[first] for x in lines[1:])))
                there = np.zeros(len(node), bool)
                there[first] = True
                place = np.cumsum(there) - 1
                doc_id, row = (b.column(c).take(pa.array(lines.doc)) for c in ("doc_id", "row"))
                of = pa.array(place, mask=~there)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BANDS), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())
                columns = [doc_id, row, pa.array(lines.number.astype(np.int32)), tk.signed(node), tk.signed(node2), pa.array(size).take(of), packed.take(of)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "line", "node", "node2", "n", "keys"])

    return docs.mapInArrow(run, "doc_id long, row long, line int, node long, node2 long, n int, keys binary")


def _new(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """The places where a node comes for the first time that isn't in seen, which it is added to."""
    at = np.sort(np.unique(node, return_index=True)[1])
    at = at[np.array([x not in seen for x in node[at].tolist()], bool)]
    if len(seen) > 200_000:
        seen.clear()
    seen.update(node[at].tolist())
    return at


def bands(known: DataFrame) -> DataFrame:
    """(key, node, n): the band keys of every line of registry(), mostly once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys").cast(pa.binary(8 * BANDS))
            key = np.frombuffer(keys.buffers()[1], np.int64, len(keys) * BANDS, 8 * BANDS * keys.offset) if len(keys) else np.zeros(0, np.int64)
            node, n = (np.repeat(b.column(c).to_numpy(), BANDS) for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n)], ["key", "node", "n"])

    return known.where("n is not null").select("node", "n", "keys").mapInArrow(run, "key long, node long, n int")


def bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): the texts of the lines of wanted(node), each once. One pass over docs; only wanted lines leave it, and a few more."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, F.col("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in tk.slices(batch):
                lines = split_lines(b.column("text"))
                node = line_hashes(lines)[0]
                able = passes(shared.value, node)
                able = np.flatnonzero(able)
                able = able[_new(node[able], seen)]
                lines, node = Lines(lines.data, *(x[able] for x in lines[1:])), node[able]
                data = lines.data.tobytes()
                out = [data[s:e] for s, e in zip(lines.start.tolist(), lines.end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([tk.signed(node), pa.array(out, pa.binary())], ["node", "items"])

    found = docs.select("text").mapInArrow(run, "node long, items binary").dropDuplicates(["node"])
    return found.join(wanted.select("node"), "node", "left_semi")


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def body_sets(column: pa.Array) -> list[np.ndarray]:
    """The shingle hashes of each line, sorted; their high bits are low, for jaccard.bitmap()."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    nothing = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    for i, j, found in line_shingles(Lines(data, nothing, nothing, offsets[:-1], offsets[1:])):
        cuts = np.searchsorted(found, np.arange(1, j - i, dtype=U) << HASH_BITS)
        out += np.split(found & U((1 << int(HASH_BITS)) - 1), cuts)
    return out


def line_components(docs: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the lines of docs(text) that are similar to another one. known: registry(docs)."""
    met = stored(jaccard.groups(bands(known), percent).groupBy("tree", "node").agg(F.first("n").alias("n")), "line-groups")
    items = jaccard.work_items(met)
    texts = stored(bodies(docs, met.select("node").distinct()), "line-texts")
    links = jaccard.tree_links(items.join(texts, "node"), percent, sets_from=body_sets, bits=int(HASH_BITS))
    out = stored(components(links.where("a is not null").select("a", "b")), "line-components")
    discard(met, texts)
    return out


def same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("id")) & F.col("row").eqNullSafe(F.col("id_row"))


def unique_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_lines, n_removed, kept (the lines left, with their line breaks between).

    A null text is empty. n_lines counts blank lines too. Rows that are alike in doc_id and text are one place: they
    share their lines' fate. Rows of one doc_id with different texts come in the order of the texts' hashes, line number first. A row without a doc_id
    comes first of all. Texts of any length are cut in slices.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    known = stored(registry(docs), "line-registry")
    same = line_components(docs, known, percent)
    # A line's class: its component, or itself by 128 bits.
    tagged = known.join(same, "node", "left").select("doc_id", "row", "line", "node", F.coalesce("component", "node").alias("c1"), F.when(F.col("component").isNull(), F.col("node2")).otherwise(0).alias("c2"))
    place = F.struct("doc_id", "line", "row")
    first = tagged.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = tagged.join(first, ["c1", "c2"]).where(~place.eqNullSafe(F.col("first")))
    # Rows that are alike give each line more than once; a set has it once, so that it is no longer than a text.
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.collect_set("line").alias("gone"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                rows = []
                for text, bad in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                    every = (text or "").split("\n")
                    bad = set(bad or ())
                    left = [x for i, x in enumerate(every) if i not in bad]
                    rows.append((len(every), len(every) - len(left), "\n".join(left)))
                n, removed, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept"])

    done = docs.join(gone, same_row(), "left").select("doc_id", "text", "gone")
    return done.mapInArrow(remove, "doc_id long, n_lines long, n_removed long, kept string")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = unique_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
