"""N-gram Jaccard self-join with signature trees.

A document's set is that of its distinct `k`-word shingles, kept as 64-bit hashes. Two documents link when
100 * |A & B| >= percent * |A | B|. No link is lost:

1. profile(): every document's set size, a 128-bit digest of the set, and its token bitmap (each shingle sets one of 2n
   bits or more). Documents with equal digests are one node, so copies cost nothing further.
2. A link needs a shared shingle among the rarest n - ceil(percent * n / 100) + 1 of each set, in any one order of all
   shingles. The order puts shingles from crowded hash buckets last, which keeps common passages out. A node is dealt to
   the groups of its rarest shingles. A shingle's place in that order bounds the overlap of a pair that meets there first, and so the
   sizes of the partners that it can bring; groups are cut where sizes leave no pair, and groups with one node end there.
3. All nodes that meet in groups with the same least member become one signature tree: nodes sorted by size, joined
   bottom-up; each tree node holds the OR of the bitmaps below it and their range of sizes. Two tree nodes are
   entered together only if the largest overlap that their bitmaps and sizes allow can make a link.
4. Nodes that keep a possible partner are fetched with their whole sets, in trees again. Pairs that the trees let through are verified at
   once; one that meets in several trees is judged in the first one only. A tree gives out each node's number of links, and as many links as
   join its components.
5. Distributed union-find joins all links.

link_pairs() gives out every link instead. Their number can be that of the pairs of a group; all else is linear in rows and in the
nodes' trees. Trees beyond CHUNK nodes or CHUNK_ITEMS shingles are cut into chunks, and each pair of chunks is a work item of its own,
so no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import tokens as tk
from millrace.llm.common import WORD, bit_filter, components, discard, free_name, passes, stored, table

SHINGLE, PERCENT = 5, 80
#: A chunk of a tree holds about so many nodes, and so many shingles, at most.
CHUNK, CHUNK_ITEMS, FAN = 4096, 1 << 21, 16
#: Hash buckets whose counts order the shingles.
BUCKET_BITS = 18
U = tk.U
LOW = U((1 << (64 - BUCKET_BITS)) - 1)
#: Above every set size.
BIG = 1 << 31
#: A set's size below its key, in one 64-bit integer.
SIZE_BITS = 16
MOST_SIZE = (1 << SIZE_BITS) - 1
#: A work item of so few members and shingles is judged with others, until they have so many shingles together.
FEW, FEW_ITEMS, BUNDLE_ITEMS = 8, 1 << 14, 1 << 18


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. With fewer than k words, the whole sequence is one shingle."""
    w = tk.split_words(texts, lower=True)
    h = tk.word_hashes(w)
    s = tk.windows(h, k)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if j - i >= k:
            x = np.sort(s[i : j - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(tk.windows(h[i:j], j - i, 100 + j - i) if j > i else np.zeros(0, U))
    return out


def digest(s: np.ndarray, salt: int) -> np.uint64:
    """A sum over the set, whatever its order."""
    return tk.mix(s * U(2 * salt + 1) + U(salt)).sum(dtype=U) + U(len(s))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(max(64, 1 << (2 * len(s) - 1).bit_length()), bool)
    bits[(s & U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def profile(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, n, node, digest, bits, counts): a row per row of docs(doc_id, h, text), and one a task with the counts of hash buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n", "node", "digest", "bits", "counts"]
        total = np.zeros(1 << BUCKET_BITS, np.int32)  # a task reads far fewer than 2**31 shingles
        for batch in batches:
            for b in tk.slices(batch):
                sets = shingle_sets(b.column("text"), k)
                total += np.bincount((np.concatenate(sets) >> U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
                sums = [tk.signed(np.array([digest(s, salt) for s in sets], U)) for salt in (1, 2)]
                bits = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([len(s) for s in sets], pa.int64()), *sums, bits, pa.nulls(b.num_rows, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n long, node long, digest long, bits binary, counts binary")


def bucket_order(counts: DataFrame) -> np.ndarray:
    """The rank of each hash bucket, the least crowded first, from counts(counts). Its size is fixed."""

    def add(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << BUCKET_BITS, np.int64)
            for b in batches:
                for x in b.column("counts"):
                    total += np.frombuffer(x.as_buffer(), kind)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

        return run

    row = counts.mapInArrow(add(np.int32), "counts binary").repartition(1).mapInArrow(add(np.int64), "counts binary").first()
    rank = np.empty(1 << BUCKET_BITS, U)
    rank[np.argsort(np.frombuffer(row[0], np.int64), kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=U)
    return rank


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of size n has with any that it links to."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """(key, node, n, most): each set's rarest shingles, as many as a link needs one of. Copies in one task are left out.

    most: the largest set that can link to this one if this is the first shingle, in order, that they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for batch in batches:
            for b in tk.slices(batch):
                keys, nodes, sizes, most = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for s in shingle_sets(b.column("text"), k):
                    node = digest(s, 1)
                    if len(s) and node not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(node)
                        o = (rank[(s >> U(64 - BUCKET_BITS)).astype(np.int64)] << U(64 - BUCKET_BITS)) | (s & LOW)
                        p = len(s) - int(needed(len(s), percent)) + 1
                        keys.append(np.sort(np.partition(o, p - 1)[:p]))
                        nodes.append(np.full(p, node)), sizes.append(np.full(p, len(s)))
                        most.append((100 + percent) * (len(s) - np.arange(p)) // percent - len(s))
                columns = [tk.signed(np.concatenate(keys)), tk.signed(np.concatenate(nodes)), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, most))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "most"])

    return docs.mapInArrow(run, "key long, node long, n int, most int")


def groups(rows: DataFrame, percent: int | None = None) -> DataFrame:
    """(tree, node, n) of the groups of rows(key, node, n, most) that can hold a link; tree: the group's first node.

    With percent, most follows from n alone and rows come without it. Key and size are one number then, which sorts faster: the key's high bits above
    the size, or above MOST_SIZE, which allows all partners from there on. Keys that share those bits share a group, which loses no pair.

    Rows come sorted by key, then size, and stream through. A group is cut before a row that no earlier one allows as a partner. Rows
    that allow no earlier one go too, and what then stands alone. A cut group's state is its first row and its reach.
    """

    def numbered(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        key, node, n, most = (b.column(c).to_numpy() for c in ("key", "node", "n", "most"))
        return key, node, n, most, n

    def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        place, node, known = (b.column(c).to_numpy() for c in ("place", "node", "n"))
        tied = np.concatenate([[False], place[1:] == place[:-1]])
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        if len(at):  # by node, so that groups alike have the same first one
            order = at[np.lexsort((node[at], place[at]))]
            node, known = node.copy(), known.copy()
            node[at], known[at] = node[order], known[order]
        n = place & MOST_SIZE
        return place >> SIZE_BITS, node, n, np.where(n == MOST_SIZE, BIG - 1, n * 100 // percent), known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the previous batch's last cut group: key, its first node and size, its reach, its last node, and whether the first node is still alone
        for b in batches:
            if not b.num_rows:
                continue
            key, node, n, most, known = unpacked(b) if percent is not None else numbered(b)
            again = np.concatenate([[last is not None and key[0] == last[0] and node[0] == last[4]], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
            if again.any():
                key, node, n, most, known = (x[~again] for x in (key, node, n, most, known))
                if not len(key):
                    continue
            start = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            group = np.cumsum(start).astype(np.int64)  # 0 goes on with the last batch's group
            reach = np.maximum.accumulate(np.concatenate([[-1 if last is None else last[3]], group * BIG + most]))
            start |= n > reach[:-1] - group * BIG
            part = np.cumsum(start)
            at = np.flatnonzero(start)
            first, least = np.concatenate([[0 if last is None else last[1]], node[at]])[part], np.concatenate([[0 if last is None else last[2]], n[at]])[part]
            able = start | (most >= least)
            size = np.bincount(part, able, len(at) + 1)
            size[0] += 0 if last is None else 2 - last[5]
            alone = bool(size[part[-1]] == 1)
            keep = able & (size[part] > 1)
            before = ([], [], [])
            if last is not None and last[5] and size[0] > 1:
                before = ([last[1]], [last[1]], [last[6]])
            known_first = np.concatenate([[0 if last is None else last[6]], known[at]])[part[-1]]
            last = (key[-1], first[-1], least[-1], int(reach[-1] - group[-1] * BIG), node[-1], alone, known_first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(x, y.dtype), y[keep]])) for x, y in zip(before, (first, node, known), strict=True)], ["tree", "node", "n"])

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if percent is None:
        return rows.repartition(parts, "key").sortWithinPartitions("key", "n", "node").select("key", "node", "n", "most").mapInArrow(run, "tree long, node long, n int")
    place = F.col("key").bitwiseAND(F.lit(~MOST_SIZE)).bitwiseOR(F.least("n", F.lit(MOST_SIZE)).cast("long"))
    rows = rows.select(place.alias("place"), "node", "n").repartition(parts, F.shiftright("place", SIZE_BITS))
    return rows.sortWithinPartitions("place").mapInArrow(run, "tree long, node long, n int")


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded by OR to so many words; shingles keep to the same bits modulo the size."""
    return bits if bits.shape[-1] == words else np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def may_link(n_a, n_b, most, percent: int) -> np.ndarray:
    """Whether sets of these sizes with an overlap of `most` at best can link: 100 * i >= percent * (a + b - i)."""
    return (100 + percent) * most >= percent * (n_a + n_b)


class Tree:
    """A signature-tree node: the members at [low, high), their sizes, their OR, and how far sizes exceed set bits."""

    def __init__(self, low: int, high: int, below: list[Tree], sizes: np.ndarray, maps: list[np.ndarray]):
        self.low, self.high, self.below = low, high, below
        self.least, self.most = int(sizes[low]), int(sizes[high - 1])
        parts = [t.bits for t in below] if below else maps[low:high]
        words = min(len(p) for p in parts)
        self.bits = np.bitwise_or.reduce([fold(p, words) for p in parts], axis=0)
        if below and all(len(p) == words for p in parts):
            self.slack = max(t.slack for t in below)
        else:  # folding hides bits, so it is counted anew
            self.slack = max(int(sizes[i]) - int(np.bitwise_count(fold(maps[i], words)).sum()) for i in range(low, high))


def grow(low: int, high: int, sizes: np.ndarray, maps: list[np.ndarray]) -> Tree:
    """A tree over the members [low, high), which are sorted by size."""
    level = [Tree(i, min(i + FAN, high), [], sizes, maps) for i in range(low, high, FAN)]
    while len(level) > 1:
        level = [Tree(c[0].low, c[-1].high, c, sizes, maps) for c in (level[i : i + FAN] for i in range(0, len(level), FAN))]
    return level[0]


def let_through(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of members (left x right) may link: each bit that only one has is at least one shingle that only it has."""
    words = min(len(maps[i]) for side in (left, right) for i in side)
    p, q = (np.stack([fold(maps[i], words) for i in side]) for side in (left, right))
    only_p = np.bitwise_count(p[:, None] & ~q[None]).sum(axis=2, dtype=np.int64)
    only_q = np.bitwise_count(~p[:, None] & q[None]).sum(axis=2, dtype=np.int64)
    a, b = sizes[left][:, None], sizes[right][None]
    return may_link(a, b, np.minimum(np.minimum(a - only_p, b - only_q), np.minimum(a, b)), percent)


def descend(x: Tree, y: Tree, sizes: np.ndarray, maps: list[np.ndarray], percent: int, done: Callable[[Tree, Tree], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: the pairs of members (places i, j) that sizes and bitmaps let through, leaf pair by leaf pair.

    done(a, b) tells whether a pair of tree nodes needs no look any more.
    """
    pairs = [(x, y)]
    while pairs:
        a, b = pairs.pop()
        if done(a, b) or percent * a.least > 100 * b.most or percent * b.least > 100 * a.most:
            continue
        most = min(a.most, b.most)
        if len(a.bits) == len(b.bits) and a is not b:
            # A member's bits outside the other's OR are shingles that it doesn't share; slack counts those that share a bit.
            most = min(most, int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack))
        if not may_link(a.least, b.least, most, percent):
            continue
        if a.below or b.below:
            if a is b:
                pairs += [(s, t) for i, s in enumerate(a.below) for t in a.below[i:]]
            elif a.below and (not b.below or a.high - a.low >= b.high - b.low):
                pairs += [(s, b) for s in a.below]
            else:
                pairs += [(a, t) for t in b.below]
            continue
        left, right = np.arange(a.low, a.high), np.arange(b.low, b.high)
        near = let_through(left, right, sizes, maps, percent)
        i, j = np.nonzero(np.triu(near, 1) if a is b else near)
        if len(i):
            yield left[i], right[j]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two whole sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the pairs of members link, by their whole sets."""
    members, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    size = np.array([len(sets[i]) for i in members])
    if len(left) < 6 or size.sum() > 100_000:
        return np.array([linked(sets[i], sets[j], percent) for i, j in zip(left.tolist(), right.tolist(), strict=True)], bool)
    items, place = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    has = np.zeros((len(members), len(items)), np.float32)
    has[np.repeat(np.arange(len(members)), size), place] = 1
    i, j = at[: len(left)], at[len(left) :]
    both = (has @ has.T)[i, j].astype(np.int64)
    return 100 * both >= percent * (size[i] + size[j] - both)


class Judge:
    """Verifies a work item's pairs. trees: each member's trees, of which a pair is judged in the least that both have (None: in this one).

    links: as many as join what links join, or all if `every`; found: each member's links, counted if `whole`. Else pairs
    in one component need no look.
    """

    def __init__(self, tree: int, percent: int, whole: bool, every: bool):
        self.tree, self.percent, self.whole, self.every = tree, percent, whole, every

    def look_at(self, sets: list[np.ndarray], trees: list[frozenset] | None) -> None:
        self.sets, self.root, self.found, self.links = sets, np.arange(len(sets)), np.zeros(len(sets), np.int64), []
        kinds: dict[frozenset, int] = {}
        self.kind = np.array([kinds.setdefault(t, len(kinds)) for t in trees]) if trees else None
        self.kinds, self.mine = list(kinds), {}

    def done(self, i: int, j: int, p: int, q: int) -> bool:
        return not self.whole and bool((self.root[i:j] == self.root[i]).all() and (self.root[p:q] == self.root[i]).all())

    def is_mine(self, code: int) -> bool:
        if code not in self.mine:
            p, q = divmod(code, len(self.kinds))
            self.mine[code] = min(self.kinds[p] & self.kinds[q]) == self.tree
        return self.mine[code]

    def take(self, left: np.ndarray, right: np.ndarray) -> None:
        ok = np.ones(len(left), bool) if self.whole else self.root[left] != self.root[right]
        if self.kind is not None:
            code, at = np.unique(self.kind[left] * len(self.kinds) + self.kind[right], return_inverse=True)
            ok &= np.array([self.is_mine(c) for c in code.tolist()])[at]
        left, right = left[ok], right[ok]
        ok = verified(left, right, self.sets, self.percent) if len(left) else ok[:0]
        left, right = left[ok], right[ok]
        if self.whole:
            np.add.at(self.found, np.concatenate([left, right]), 1)
        if self.every:
            self.links += zip(left.tolist(), right.tolist(), strict=True)
            return
        for at in np.flatnonzero(self.root[left] != self.root[right]).tolist():
            i, j = int(left[at]), int(right[at])
            p, q = self.root[i], self.root[j]
            if p != q:
                self.root[self.root == max(p, q)] = min(p, q)
                self.links.append((i, j))


def work_items(rows: DataFrame) -> DataFrame:
    """rows(tree, node, n) as work items (.., x, y, mine): each pair of a tree's chunks, `mine` telling a row's chunk. Trees of one node are left out."""
    sizes = rows.groupBy("tree").agg(F.count("*").alias("members"), F.sum("n").alias("items")).where("members > 1")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("items") / CHUNK_ITEMS)).cast("int")
    rows = rows.join(sizes.select("tree", chunks.alias("chunks")), "tree")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("chunks", "other")


class Bundle:
    """Small work items, judged many at a time: all pairs of each, by one sort of their hashes below the pairs' numbers. Hashes have `bits` bits."""

    def __init__(self, percent: int, bits: int):
        self.percent, self.bits = percent, bits
        self.clear()

    def clear(self) -> None:
        self.node, self.sets, self.members, self.items = [], [], [], 0

    def takes(self, x: int, y: int, node: np.ndarray, sets: list[np.ndarray]) -> bool:
        """Whether the work item is small, and so has been put in."""
        if x != y or len(sets) > FEW or (items := sum(map(len, sets))) > FEW_ITEMS:
            return False
        self.node.append(node)
        self.sets += sets
        self.members.append(len(sets))
        self.items += items
        return True

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The links (a, b) of what was put in, all of them."""
        node, members = np.concatenate(self.node), np.array(self.members)
        n, flat = np.array([len(s) for s in self.sets], np.int64), np.concatenate(self.sets)
        start, first = np.cumsum(n) - n, np.cumsum(members) - members
        sides = [(first[members == k][:, None] + side[None]).ravel() for k in range(2, FEW + 1) for side in np.triu_indices(k, 1)]
        left, right = np.concatenate(sides[::2]), np.concatenate(sides[1::2])
        near = self.percent * np.maximum(n[left], n[right]) <= 100 * np.minimum(n[left], n[right])
        left, right = left[near], right[near]
        both, most = np.zeros(len(left), np.int64), 1 << (64 - self.bits)
        for i in range(0, len(left), most):
            side = np.concatenate([left[i : i + most], right[i : i + most]])
            pair = np.tile(np.arange(len(side) // 2, dtype=U), 2)
            size = n[side]
            at = np.arange(size.sum()) + np.repeat(start[side] - (np.cumsum(size) - size), size)
            found = flat[at] | np.repeat(pair << U(self.bits), size)
            found.sort()
            both[i : i + most] = np.bincount((found[1:][found[1:] == found[:-1]] >> U(self.bits)).astype(np.int64), minlength=len(side) // 2)
        ok = 100 * both >= self.percent * (n[left] + n[right] - both)
        a, b = node[left[ok]], node[right[ok]]
        return np.minimum(a, b), np.maximum(a, b)


def per_item(rows: DataFrame, run: Callable[..., pa.RecordBatch | None], columns: dict[str, Callable[[pa.Array], list | np.ndarray]], schema: str, bundle: Callable[[], Bundle] | None = None, many: Callable[[Bundle], pa.RecordBatch | None] | None = None) -> DataFrame:
    """run(tree, x, y, *columns) for each work item of rows(tree, x, y, ..) of two rows or more. Items stream by; one is held at a time.

    With bundle, columns are mine, node and items; small items are held in one, and many() is called for all of them at once instead.

    columns: by name, what makes a list or array of an Arrow column; it is called a batch at a time.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, small = [], None, bundle() if bundle else None
        for b in batches:
            if not b.num_rows:
                continue
            tree, x, y = (b.column(c).to_numpy() for c in ("tree", "x", "y"))
            made = [f(b.column(c)) for c, f in columns.items()]
            cut = np.flatnonzero((tree[1:] != tree[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(tree)], strict=True):
                key = int(tree[i]), int(x[i]), int(y[i])
                if key != last and held:
                    yield from said(last, held, small)
                    held = []
                held.append([m[i:j] for m in made])
                last = key
        if held:
            yield from said(last, held, small)
        if small and small.members and (got := many(small)) is not None:
            yield got

    def said(key: tuple, held: list, small: Bundle | None) -> Iterator[pa.RecordBatch]:
        parts = held[0] if len(held) == 1 else [np.concatenate(m) if isinstance(m[0], np.ndarray) else [v for part in m for v in part] for m in zip(*held, strict=True)]
        if small and len(parts[0]) > 1 and small.takes(*key[1:], *parts[1:]):
            if small.items >= BUNDLE_ITEMS:
                got = many(small)
                small.clear()
                if got is not None:
                    yield got
        elif len(parts[0]) > 1 and (got := run(*key, *parts)) is not None:
            yield got

    keys = ["tree", "x", "y"]
    dealt = rows.select(*keys, *columns).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(whole, schema)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy()


def arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(i.as_buffer(), U) for i in column]


def tree_sets(column: pa.Array) -> list[frozenset]:
    return [frozenset(x) for x in column.to_pylist()]


def candidates(x: int, y: int, mine: np.ndarray, node: np.ndarray, n: np.ndarray, maps: list[np.ndarray], percent: int, done: Callable[[int, int, int, int], bool]) -> tuple[np.ndarray, Iterator]:
    """A work item's members (places) in their trees' order, and the pairs of places in that order that may link, some at a time.

    done(i, j, p, q) tells whether members [i, j) and [p, q) need no look at each other any more.
    """
    sides = [np.flatnonzero(mine == k) for k in dict.fromkeys((x, y))]
    order = np.concatenate([side[np.lexsort((node[side], n[side]))] for side in sides])
    n, maps = n[order], [maps[i] for i in order]
    if len(order) <= FAN and len(sides) == 1:
        every = np.arange(len(order))
        near = np.nonzero(np.triu(let_through(every, every, n, maps, percent), 1))
        return order, iter([near] if len(near[0]) else [])
    if not all(map(len, sides)):
        return order, iter([])
    trees = [grow(0, len(sides[0]), n, maps)]
    if len(sides) > 1:
        trees.append(grow(len(sides[0]), len(order), n, maps))
    return order, descend(trees[0], trees[-1], n, maps, percent, lambda a, b: done(a.low, a.high, b.low, b.high))


def tree_survivors(rows: DataFrame, percent: int) -> DataFrame:
    """(tree, node, n): the nodes of the work items rows(tree, x, y, mine, node, n, bits) that sizes and bitmaps leave a possible partner."""

    def run(tree: int, x: int, y: int, mine: np.ndarray, node: np.ndarray, n: np.ndarray, maps: list) -> pa.RecordBatch | None:
        marked = np.zeros(len(node), bool)
        order, pairs = candidates(x, y, mine, node, n.astype(np.int64), maps, percent, lambda i, j, p, q: bool(marked[i:j].all() and marked[p:q].all()))
        for i, j in pairs:
            marked[i] = marked[j] = True
        kept = order[marked]
        if len(kept):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), tree)), pa.array(node[kept]), pa.array(n[kept])], ["tree", "node", "n"])

    return per_item(rows, run, {"mine": numbers, "node": numbers, "n": numbers, "bits": arrays}, "tree long, node long, n int").distinct()


def tree_links(rows: DataFrame, percent: int, whole: bool = False, every: bool = False, sets_from: Callable[[pa.Array], list[np.ndarray]] = arrays, bits: int = 64) -> DataFrame:
    """(a, b, node, found): links (a, b) between nodes of the work items rows(tree, x, y, mine, node, trees, items), and nodes with the links found there.

    items: what sets_from() makes each node's sorted 64-bit shingle hashes of. trees (all of the node's trees) only matters if whole. Links
    are as many as join a work item's components, or all if every; nodes' links are counted if whole. bits: how many the hashes have; where that leaves
    some for the pairs' numbers, and links aren't counted, small items are judged many at a time and give all their links.
    """

    def run(tree: int, x: int, y: int, mine: np.ndarray, node: np.ndarray, sets: list, trees: list | None = None) -> pa.RecordBatch | None:
        if len(sets) == 2:  # no tree to speak of
            if (x != y and mine[0] == mine[1]) or (whole and min(trees[0] & trees[1]) != tree) or not linked(*sets, percent):
                return None
            return said(np.sort(node)[:1], np.sort(node)[1:], node[: 2 * whole], np.ones(2 * whole, np.int64))
        maps = [np.frombuffer(bitmap(i), U) for i in sets]
        judge = Judge(tree, percent, whole, every)
        order, pairs = candidates(x, y, mine, node, np.array([len(i) for i in sets], np.int64), maps, percent, judge.done)
        judge.look_at([sets[i] for i in order], [trees[i] for i in order] if trees else None)
        for left, right in pairs:
            judge.take(left, right)
        some = np.flatnonzero(judge.found)
        i, j = np.array(judge.links, np.int64).reshape(-1, 2).T
        node = node[order]
        return said(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), node[some], judge.found[some])

    def said(a: np.ndarray, b: np.ndarray, node: np.ndarray, found: np.ndarray) -> pa.RecordBatch | None:
        if not len(a) + len(node):
            return None
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [[pa.array(a), none(len(node))], [pa.array(b), none(len(node))], [none(len(a)), pa.array(node)], [none(len(a)), pa.array(found)]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "node", "found"])

    columns = {"mine": numbers, "node": numbers, "items": sets_from} | ({"trees": tree_sets} if whole else {})
    none = np.zeros(0, np.int64)
    small = {} if whole or bits > 52 else {"bundle": lambda: Bundle(percent, bits), "many": lambda small: said(*small.links(), none, none)}
    return per_item(rows, run, columns, "a long, b long, node long, found long", **small)


def sets_of(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, items): the whole sets of wanted(node, rid), rid a document that has the set. One pass over docs.

    A filter of fixed size on rid keeps most other documents from being cut into shingles; a full one would only save less.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, F.xxhash64("rid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch.filter(pa.array(passes(shared.value, batch.column("h").to_numpy())))):
                sets = shingle_sets(b.column("text"), k)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), tk.signed(np.array([digest(s, 1) for s in sets], U)), pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "node", "items"])

    read = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    # Joined by node alone, so that dropDuplicates needn't deal the sets out again.
    found = read.mapInArrow(run, "rid long, node long, items binary").join(wanted.select("node", F.col("rid").alias("of")), "node").where("rid = of").dropDuplicates(["node"])
    return stored(found.select("node", "items"), "jaccard-sets")


def joined(docs: DataFrame, k: int, percent: int, whole: bool = True, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows(doc_id, h, n, node, ..) of docs, h a hash of the text, nodes(node, rid, n, bits), links(a, b) between nodes, and counts(node, found) of each node's links.

    Links are enough to join components, or all if every; counts are whole if `whole`, else empty.
    """
    found = stored(profile(docs.withColumn("h", F.xxhash64("text")), k), "jaccard-profile")
    rows = found.where("n is not null").select("doc_id", "h", "n", "node", "digest", "bits")
    shared = docs.sparkSession.sparkContext.broadcast(bucket_order(found.where("counts is not null").select("counts")))
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("node", "digest").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = stored(nodes.drop("digest"), "jaccard-nodes")

    met = groups(prefixes(docs.where("doc_id is not null"), k, percent, shared)).groupBy("tree", "node").agg(F.first("n").alias("n"))
    met = stored(met, "jaccard-groups")
    trees = tree_survivors(work_items(met).join(nodes.select("node", "bits"), "node"), percent)
    trees = stored(trees, "jaccard-trees")
    discard(met)
    sets = sets_of(trees.select("node").distinct().join(nodes.select("node", "rid"), "node"), docs, k)
    if whole:  # a node's trees are fewer than its set's shingles
        sets = sets.join(trees.groupBy("node").agg(F.collect_set("tree").alias("trees")), "node")
    links = stored(tree_links(work_items(trees).join(sets, "node"), percent, whole, every), "jaccard-links")
    discard(trees, sets)
    counts = links.where("node is not null").groupBy("node").agg(F.sum("found").alias("found"))
    return rows, nodes, links.where("a is not null").select("a", "b"), counts


def labelled(rows: DataFrame, nodes: DataFrame, links: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): a row per row of joined()'s rows."""
    # Rows of one doc_id are one document, which may have several nodes.
    same = rows.where("n > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b and doc_id is not null").select("doc_id")
    same = rows.where("n > 0").join(same, "doc_id").select("doc_id", F.col("node").alias("b"))
    same = same.join(same.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b").where("a <> b")
    parts = components(links.union(same))
    least = parts.join(nodes.select("node", "rid"), "node").groupBy("component").agg(F.min("rid").alias("least"))
    final = parts.join(least, "component").select("node", "least")
    label = nodes.groupBy("node").agg(F.min("rid").alias("rid")).join(final, "node", "left").join(counts, "node", "left")
    # Stored, so that nothing above the join with rows keeps a group of copies from being split.
    label = stored(label.select("node", F.coalesce("least", "rid").alias("component_id"), F.coalesce("found", F.lit(0)).alias("n_links")), "jaccard-labels")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return rows.select("doc_id", "n", "node").join(label, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(own, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (the least doc_id that links lead to), n_links.

    n_links: how many other shingle sets in the table the row's own set links to. A text without words (null, empty, blank) has no shingles and no
    links. Rows that share a doc_id are one document: what one links to, all do; each row's n_links is that of its own text. A row without a doc_id has no links and component null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, nodes, links, counts = joined(docs, k, percent)
    done = stored(labelled(rows, nodes, links, counts), "jaccard-done")
    discard(rows, nodes, links)
    return done


def link_pairs(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_a, doc_b, node_a, node_b): every link between different shingle sets once, each set by its digest and the least doc_id that has it."""
    _, nodes, links, _ = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent, every=True)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("rid").alias(f"doc_{c}"))
    return links.join(side("a"), "a").join(side("b"), "b").select("doc_a", "doc_b", F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each group that links join, the row of the least doc_id stays; texts without words and rows without doc_id all stay.

    Rows are known by doc_id and text, so that unlike texts which share a doc_id don't stand for each other; of a group's texts that share the least doc_id the one of
    the least hash stays, and of rows alike in both the first by a hash of the whole row. doc_id is a whole number. Columns of any type, maps too, come along.
    Only components matter here, so that pairs already in one are left alone.
    """
    rows, nodes, links, _ = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent, whole=False)
    parts = components(links)
    own = rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    own = own.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    found = stored(own.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h")), "jaccard-first")
    discard(rows, nodes, links)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place, h = free_name(docs, "_place"), free_name(docs, "_h")
    linkless = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rest = docs.where(~linkless).withColumn(h, F.xxhash64("text")).join(found, (F.col("doc_id").cast("long") == F.col("first_id")) & (F.col(h) == F.col("first_h")), "left_semi")
    by = W.partitionBy("doc_id", h).orderBy(F.xxhash64(F.to_json(F.struct(*columns))))  # Spark takes the first of each task before it shuffles
    rest = rest.withColumn(place, F.row_number().over(by)).where(F.col(place) == 1)
    return rest.select(*columns).union(docs.where(linkless).select(*columns))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS t
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {SHINGLE - 1}) + 1)) AS i FROM w WHERE len(words) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PERCENT} * (na.n + nb.n - i)),
class AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY t) AS c FROM s GROUP BY doc_id),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id, coalesce(found.n, 0) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT l.a, count(DISTINCT y.c) AS n FROM both_ways l JOIN class x ON x.doc_id = l.a JOIN class y ON y.doc_id = l.b WHERE x.c <> y.c GROUP BY l.a) found ON found.a = w.doc_id
"""
