"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision (the bits before it in the byte) has a tree of contexts: the last 0, 1, ..
`depth` bytes before the byte. A node's counts of zeros and ones give a Krichevsky-Trofimov (KT) estimate, and its
weighted probability is the mean of its own KT probability and the product of its children's. After training, the
probability of a bit is the mixture, over all depths, of the KT estimates on its path, with the weights that the
training data left on them. The text is taken in lower case (A-Z), as UTF-8, starts after zero bytes and ends with one.

How it runs: documents are cut into blocks of BLOCK bytes. A block sends each of its distinct words and (depth + 1)-grams of
bytes once, with its training count. Counts are added up by key; the tree is evaluated from its leaves to
depth 3 in parts dealt out by the last two context bytes and cut at the third, its nodes of depth 2 are sums of those, and its top
(65,535 nodes at most) is evaluated on the driver. Each block then gets back the totals of its words and the log-probabilities of its
grams, sorted, and behind them its documents, which it scores as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens as tk
from millrace.llm.common import discard, stored, table
from millrace.llm.substrings import FingerprintIndex

DEPTH = 5
BLOCK = 24 << 20
#: Grams that a task evaluates at once; it goes on to the next group of contexts beyond that.
AT_ONCE = 1 << 18
WORD, GRAM, TEXT = 0, 1, 2
U = tk.U


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series, after moving x up by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - shift


#: log_gamma(n + 1/2) and log_gamma(n + 1) of small counts, which most are.
SMALL = 4096
HALVES, WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def _gamma_at(n: np.ndarray, known: np.ndarray, more: float) -> np.ndarray:
    out = known[np.minimum(n, SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= SMALL)
    out[large] = log_gamma(n[large] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the KT probability of any order of so many zeros and ones."""
    return _gamma_at(zeros, HALVES, 0.5) + _gamma_at(ones, HALVES, 0.5) - _gamma_at(zeros + ones, WHOLES, 1.0) - np.log(np.pi)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the weighted probability, and the weight of the node's own estimate in it."""
    total = np.logaddexp(own, below) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


class Level:
    """The nodes of one depth for one bit: ids (context, then bits before, with a leading one), counts, weights."""

    def __init__(self, key: np.ndarray, n: np.ndarray, bit: int):
        of = self.ids_of(key, bit)
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        one = ((key >> U(7 - bit)) & U(1)).astype(bool)
        self.ids = of[new]
        self.zeros = np.add.reduceat(np.where(one, 0, n), new).astype(float) if len(new) else np.zeros(0)
        self.ones = np.add.reduceat(np.where(one, n, 0), new).astype(float) if len(new) else np.zeros(0)
        self.own = log_kt(self.zeros, self.ones)
        self.total, self.weight = self.own, np.ones(len(new))

    @staticmethod
    def ids_of(key: np.ndarray, bit: int) -> np.ndarray:
        """The node's id: the context bytes, then the bits before, above which a one is put."""
        return (key & ~U(255)) | ((U(256) | (key & U(255))) >> U(8 - bit))

    def add_children(self, deeper: Level, mask: np.uint64) -> None:
        at = np.searchsorted(self.ids, deeper.ids & mask)
        self.total, self.weight = weigh(self.own, np.bincount(at, deeper.total, len(self.ids)))

    def chance(self, key: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """The KT estimate of each key's own bit, and the node's weight."""
        at = np.searchsorted(self.ids, self.ids_of(key, bit))
        one = ((key >> U(7 - bit)) & U(1)).astype(bool)
        n = self.zeros[at] + self.ones[at]
        return (np.where(one, self.ones[at], self.zeros[at]) + 0.5) / (n + 1), self.weight[at]


def mask_of(depth: int) -> np.uint64:
    """Keeps `depth` context bytes and the byte itself."""
    return U((1 << 8 * (depth + 1)) - 1)


def subtree(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> Iterator[list[Level]]:
    """For each bit, its levels top..depth; n: each gram's training count (0 allowed). One bit's levels at a time are in memory."""
    keys = []
    for d in range(top, depth + 1):
        key, at = np.unique(gram & mask_of(d), return_inverse=True)
        keys.append((key, np.bincount(at, n, len(key)).astype(np.int64)))
    for bit in range(8):
        levels = [Level(*kept, bit) for kept in keys]
        for d in range(depth - 1, top - 1, -1):
            levels[d - top].add_children(levels[d - top + 1], mask_of(d))
        yield levels


def mixed(levels: list[Level], gram: np.ndarray, bit: int, top: int, below: np.ndarray | None = None) -> np.ndarray:
    """The mixture of the estimates of depths top, top + 1, .. (one a level), given that of the depths below them."""
    for d in range(top + len(levels) - 1, top - 1, -1):
        p, w = levels[d - top].chance(gram & mask_of(d), bit)
        below = p if below is None else w * p + (1 - w) * below
    return below


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All (depth + 1)-grams of the texts, each with its end, one after the other; and where each text's start."""
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    n = len(size)
    padded = np.zeros(len(data) + n * (depth + 1), np.uint8)
    text = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + depth + text * (depth + 1)] = data
    gram = np.zeros(len(padded) - depth if n else 0, U)
    for k in range(depth + 1):
        gram = (gram << U(8)) | padded[k : k + len(gram)]
    keep = np.arange(first[-1]) + np.repeat(np.arange(n), size + 1) * depth
    return gram[keep], first


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key (below 2**63) once, and how often it occurs in training rows."""
    both = np.sort((keys << U(1)) | train.astype(U))
    keys = both >> U(1)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[new], np.add.reduceat((both & U(1)).astype(np.int64), new) if len(new) else np.zeros(0, np.int64)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of several (keys, counts) together."""
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, of 63 bits, and where each text's start."""
    w = tk.split_words(texts, lower=True)
    return tk.word_hashes(w) >> U(1), w.first


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the blocks: a partition's number, and within it a new one every BLOCK bytes."""
    from pyspark import TaskContext

    at, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for b in tk.slices(batch):
            if size > BLOCK:
                at, size = at + 1, 0
            size += b.column("text").nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, at)), *b.columns], ["block", *b.schema.names])


def _gather(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(block: int, kind: int, got: tuple) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(got[0]), 1 << 18):
            keys, n = (x[i : i + (1 << 18)] for x in got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), tk.signed(keys), pa.array(np.full(len(n), block)), pa.array(n)], ["kind", "key", "block", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = None, ([], [])
        for batch in batches:
            for piece in tk.slices(batch):
                numbers = piece.column("block").to_numpy()
                for at in np.unique(numbers).tolist():
                    b = piece.filter(pa.array(numbers == at))
                    if at != block:
                        for kind in (WORD, GRAM) if block is not None else ():
                            yield from rows(block, kind, added(got[kind]))
                        block, got = at, ([], [])
                    train = ~b.column("held_out").to_numpy(zero_copy_only=False)
                    h, first = words_of(b.column("text"))
                    got[WORD].append(counted(h, np.repeat(train, np.diff(first))))
                    gram, first = grams(*tk.column_bytes(b.column("text"), lower=True), depth)
                    got[GRAM].append(counted(gram, np.repeat(train, np.diff(first))))
        for kind in (WORD, GRAM) if block is not None else ():
            yield from rows(block, kind, added(got[kind]))

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of rows sorted by part, AT_ONCE rows or more at a time, never cutting a part. A gram's part has 2**24 grams at most."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def said(rows: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(rows)
        return {c: t.column(c).to_numpy() for c in t.column_names}

    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("part").to_numpy()
        cut = int(np.searchsorted(part, part[-1]))  # where the last part starts
        if size + cut > AT_ONCE and (cut or part[0] != last):
            yield said([*held, b.slice(0, cut)])
            held, size = [], 0
            b = b.slice(cut)
        held.append(b)
        size, last = size + b.num_rows, part[-1]
    if held:
        yield said(held)


def _node(zeros: np.ndarray, ones: np.ndarray, ids: np.ndarray, below: np.ndarray) -> Level:
    """A level from its counts and the log of what its children say."""
    level = Level.__new__(Level)
    level.ids, level.zeros, level.ones, level.own = ids, zeros, ones, log_kt(zeros, ones)
    level.total, level.weight = weigh(level.own, below)
    return level


def evaluate(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, log10p) of counts(key, n): the log-probability of each gram's last byte after the others. depth is 3 or more."""
    spark = counts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A part: the last two context bytes, a bit (0: nodes, which come first; 1: grams), the third last byte.
    two = F.shiftright("part", 9)
    of_key = F.shiftright("key", 8).bitwiseAND(0xFFFF) * 512
    counts = counts.select((of_key + 256 + F.shiftright("key", 24).bitwiseAND(0xFF)).alias("part"), "key", "n")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            for bit, (level, *_) in enumerate(subtree(t["key"].view(U), t["n"], depth, 3)):
                ids, at = np.unique(level.ids & mask_of(2), return_inverse=True)
                sums = [np.bincount(at, x, len(ids)) for x in (level.zeros, level.ones, level.total)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bit, np.int8)), tk.signed(ids), *map(pa.array, sums)], ["bit", "key", "zeros", "ones", "total"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level = _node(*(b.column(c).to_numpy() for c in ("zeros", "ones")), b.column("key").to_numpy(), b.column("total").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bit", "key", "zeros", "ones")), pa.array(level.total), pa.array(level.weight)], ["bit", "key", "zeros", "ones", "total", "weight"])

    found = counts.repartition(partitions, two).sortWithinPartitions("part").mapInArrow(roots, "bit byte, key long, zeros double, ones double, total double")
    sums = lambda df: df.groupBy("bit", "key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "total")])
    nodes = stored(sums(found).mapInArrow(weighed, "bit byte, key long, zeros double, ones double, total double, weight double"), "score-nodes")
    rows = sums(nodes.withColumn("key", F.col("key").bitwiseAND(int(mask_of(1))))).orderBy("bit", "key").toArrow()  # a node for each byte and bits before: 65,280 at most
    levels: list[list[Level]] = []
    column = {c: rows.column(c).to_numpy() for c in rows.column_names}
    for bit in range(8):
        at = column["bit"] == bit
        one = _node(column["zeros"][at], column["ones"][at], column["key"][at].view(U), column["total"][at])
        ids, to = np.unique(one.ids & mask_of(0), return_inverse=True)
        levels.append([_node(np.bincount(to, one.zeros, len(ids)), np.bincount(to, one.ones, len(ids)), ids, np.bincount(to, one.total, len(ids))), one])
    shared = spark.sparkContext.broadcast(levels)

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bit", "key", "zeros", "ones", "weight"]
        kept = None  # the nodes of the last two context bytes so far: 255 rows
        for t in _parts(batches):
            is_node = t["part"] & 256 == 0
            mine = {c: t[c][is_node] if kept is None else np.concatenate([kept[c], t[c][is_node]]) for c in [*names, "part"]}
            last = mine["part"] >> 9 == t["part"][-1] >> 9
            kept = {c: x[last] for c, x in mine.items()}
            gram, n = t["key"][~is_node].view(U), t["n"][~is_node]
            if not len(gram):
                continue
            total = np.zeros(len(gram))
            for bit, levels in enumerate(subtree(gram, n, depth, 3)):
                at = np.flatnonzero(mine["bit"] == bit)
                at = at[np.argsort(mine["key"][at])]
                level = Level.__new__(Level)
                level.ids, level.zeros, level.ones, level.weight = mine["key"][at].view(U), *(mine[c][at] for c in ("zeros", "ones", "weight"))
                total += np.log10(mixed([*shared.value[bit], level], gram, bit, 0, mixed(levels, gram, bit, 3)))
            yield pa.RecordBatch.from_arrays([tk.signed(gram), pa.array(total)], ["key", "log10p"])

    none = lambda *names: [F.lit(0.0).alias(c) for c in names]
    grams_in = counts.select("part", F.lit(0).cast("byte").alias("bit"), "key", "n", *none("zeros", "ones", "weight"))
    nodes_in = nodes.select(of_key.alias("part"), "bit", "key", F.lit(0).cast("long").alias("n"), "zeros", "ones", "weight")
    dealt = grams_in.union(nodes_in).repartition(partitions, two).sortWithinPartitions("part")
    return dealt.mapInArrow(chances, "key long, log10p double")


def _scored(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores the texts of rows sorted by block and kind: a block's words with their totals, its grams with their chances, its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers, known = None, {WORD: [], GRAM: []}, {}
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            for of in dict.fromkeys(numbers.tolist()):
                at = np.flatnonzero(numbers == of)
                rows = batch.slice(at[0], len(at))
                if of != block:
                    block, answers, known = of, {WORD: [], GRAM: []}, {}
                kind = rows.column("kind").to_numpy()
                for k in (WORD, GRAM):
                    i, j = np.searchsorted(kind, [k, k + 1])
                    if j > i:
                        answers[k].append((rows.column("key").to_numpy()[i:j], rows.column("value").to_numpy()[i:j]))
                texts = rows.slice(int(np.searchsorted(kind, TEXT)))
                if texts.num_rows and not known:
                    for k, got in answers.items():
                        keys, values = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0))
                        new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]  # a block read by two tasks asks twice
                        known[k] = pd.Index(keys[new]), values[new]
                    answers = {WORD: [], GRAM: []}
                for b in tk.slices(texts):
                    yield _score(b, depth, *known[WORD], *known[GRAM])

    return run


def _score(b: pa.RecordBatch, depth: int, words: pd.Index, count: np.ndarray, known_grams: pd.Index, chance: np.ndarray) -> pa.RecordBatch:
    """(doc_id, held_out, n_tokens, known, logs, score, bits_per_byte) of some texts; known and logs are of words, without the end token."""
    n = b.num_rows
    h, first = words_of(b.column("text"))
    c = count[words.get_indexer(h.view(np.int64))]
    doc = np.repeat(np.arange(n), np.diff(first))
    gram, start = grams(*tk.column_bytes(b.column("text"), lower=True), depth)
    total = np.add.reduceat(chance[known_grams.get_indexer(gram.view(np.int64))], start[:-1])
    columns = [np.diff(first) + 1, np.bincount(doc, c > 0, n).astype(np.int64), np.bincount(doc, np.log10(c + 1), n), total, -total / np.log10(2) / np.diff(start)]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "known", "logs", "score", "bits_per_byte"])


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id counts as the text null). Words are
    known by 63 bits of hash. A null text is empty: one end token, one end byte. A text of any length is scored whole; repeated rows each count.
    """
    spark = docs.sparkSession
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (number % 7 == 2).alias("held_out"), "text")
    blocks = stored(docs.mapInArrow(_cut, "block long, doc_id long, held_out boolean, text string"), "score-blocks")
    ends = blocks.where("not held_out").count()

    keeper = FingerprintIndex(spark)  # for its bucketed tables
    sent = blocks.mapInArrow(_gather(depth), "kind byte, key long, block long, n long")
    sent = keeper.write(sent.repartition(keeper.buckets, "key"), "key")
    totals = sent.where(f"kind = {WORD}").groupBy("key").agg(F.sum("n").alias("n"))
    words, kinds = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n_all, v_all = words + ends, kinds + (ends > 0)

    chances = evaluate(sent.where(f"kind = {GRAM}").groupBy("key").agg(F.sum("n").alias("n")), depth)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held_out", "boolean"), ("text", "string"))]
    answers = (
        sent.where(f"kind = {WORD}").join(totals.select("key", F.col("n").cast("double").alias("value")), "key").select("block", "kind", "key", "value", *nothing)
        .union(sent.where(f"kind = {GRAM}").join(chances.hint("merge"), "key").select("block", "kind", "key", "log10p", *nothing))
        .union(blocks.select("block", F.lit(TEXT).cast("byte"), F.lit(0).cast("long"), F.lit(0.0), "doc_id", "held_out", "text"))
    )
    dealt = answers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "kind", "key")
    found = dealt.mapInArrow(_scored(depth), "doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, bits_per_byte double")
    base = F.col("logs") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1.0)))
    done = found.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")
    done = stored(done, "scores")
    keeper.forget()
    discard(blocks, sent)
    return done


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents", "doc_id", "text"))
