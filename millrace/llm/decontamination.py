"""Benchmark decontamination by spaced seeds.

A mask picks some of nine consecutive words and ignores the others, so that a hash of the picked words still agrees when an
ignored one was replaced. MASKS is such that any two copies of WINDOW words that differ in at most two of them agree
under some mask at some place. A text holds an item when some WINDOW words of it, against WINDOW of the item's, have NEEDED equal ones.

One rule for all lengths: of the n words compared, n * (WINDOW - NEEDED) // WINDOW may be replaced, so two of 13, one of 7 to 12, none of fewer. Shorter
items are compared as wholes (masks for one replaced word: every other word, from the first and from the second). An item under `least` words must
be the whole text, as within a text so few words don't tell a leak from chance; least = 1 looks for all items anywhere.

Seeds of texts and of items are joined by hash in Spark, each with the words around it (as hashes), on which the overlap is verified. A
filter of fixed size sifts the texts' seeds first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens as tk
from millrace.llm.common import WORD, bit_filter, free_name, maybe, passes, stored, table

WINDOW, NEEDED, LEAST = 13, 11, 5
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 7, 8))
SPAN = 9
LEAD = WINDOW - SPAN
HIT = "array<struct<item_id:long,word:int,item_word:int,matched:int,compared:int>>"
U = tk.U


def seeds(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash of the picked words at each place."""
    n = max(0, len(h) - mask[-1])
    weight = tk.mix(np.arange(1, len(mask) + 1, dtype=U) * U(2 * salt + 3)) | U(1)
    out = np.zeros(n, U)
    for p, w in zip(mask, weight, strict=True):
        out += h[p : p + n] * w
    return tk.mix(out)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """The masks of an item of n < WINDOW words."""
    return [tuple(range(n))] if not replaced(n) else [tuple(range(0, n, 2)), tuple(range(1, n, 2))]


def replaced(n: int) -> int:
    """How many of n compared words may differ."""
    return n * (WINDOW - NEEDED) // WINDOW


def sown(w: tk.Words, h: np.ndarray, short: list[int], items: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words to compare, text, place, seed) for each mask. short: the lengths below WINDOW that items have, negative if the item must be the whole text.

    Items have short seeds only for their own length; texts for each of those.
    """
    n, doc = np.diff(w.first), w.doc()
    for k, mask in enumerate(MASKS):
        s = seeds(h, mask, k)
        at = np.flatnonzero(tk.whole(w.first, len(h), SPAN)[: len(s)] & (n[doc[: len(s)]] >= WINDOW))
        yield WINDOW, doc[at], at - w.first[doc[at]], s[at]
    for size in map(abs, short):
        for k, mask in enumerate(short_masks(size)):
            s = seeds(h, mask, 10 * size + k)[: max(0, len(h) - size + 1)]
            own = n[doc[: len(s)]]
            at = np.flatnonzero(tk.whole(w.first, len(h), size)[: len(s)] & ((own == size) if items or -size in short else (own >= size)))
            yield size, doc[at], at - w.first[doc[at]], s[at]


def around(w: tk.Words, h: np.ndarray, size: int, doc: np.ndarray, place: np.ndarray, beyond: int) -> np.ndarray:
    """The words to compare: LEAD more on either side of a full seed; beyond a text's ends stands what no word equals."""
    lead, total = (LEAD, SPAN + 2 * LEAD) if size == WINDOW else (0, size)
    at = (w.first[doc] + place - lead)[:, None] + np.arange(total)
    inside = (at >= w.first[doc][:, None]) & (at < w.first[doc + 1][:, None])
    return np.where(inside, h[np.clip(at, 0, len(h) - 1)] | U(2), U(beyond))


def _sow(batches: Iterator[pa.RecordBatch], short: list[int], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(hash, size, place, words, *names) of seeds; those that a text repeats with the same words around count once. Copies in a row are passed over."""
    last: set[tuple] = set()
    for batch in batches:
        for b in tk.slices(batch):
            if shared is not None:  # texts that this task has had
                keys = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
                b = b.filter(pa.array([not (k in last or last.add(k)) for k in keys], pa.bool_()))
                if len(last) > 200_000:
                    last.clear()
            w = tk.split_words(b.column("text"), lower=True)
            h = tk.word_hashes(w)
            for size, doc, place, seed in sown(w, h, short, shared is None):
                if shared is not None:
                    ok = passes(shared.value, seed)
                    doc, place, seed = doc[ok], place[ok], seed[ok]
                if not len(seed):
                    continue
                words = around(w, h, size, doc, place, int(shared is None))
                same = tk.mix(words * (np.arange(1, words.shape[1] + 1, dtype=U) * tk.BASE)).sum(axis=1, dtype=U)
                keep = np.sort(np.unique(np.stack([doc.astype(U), seed, same]), axis=1, return_index=True)[1])
                body = pa.array([x.tobytes() for x in words[keep]], pa.binary())
                columns = [tk.signed(seed[keep]), pa.array(np.full(len(keep), size, np.int32)), pa.array(place[keep].astype(np.int32)), body]
                yield pa.RecordBatch.from_arrays([*columns, *(b.column(c).take(pa.array(doc[keep])) for c in names)], ["hash", "size", "place", "words", *names])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The joined seeds whose words agree well enough, with the best window: matched, word, item_word."""
    for b in batches:
        sizes, out = b.column("size").to_numpy(), []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            r = b.take(pa.array(rows))
            mine, its = (np.array([np.frombuffer(x.as_buffer(), U) for x in r.column(c)]) for c in ("words", "item_words"))
            equal = np.concatenate([np.zeros((len(rows), 1), int), np.cumsum(mine == its, axis=1)], axis=1)
            sums = equal[:, size:] - equal[:, :-size]
            k = sums.argmax(axis=1)
            matched = sums[np.arange(len(rows)), k]
            ok = np.flatnonzero(matched >= size - replaced(size))
            shift = (k - (LEAD if size == WINDOW else 0))[ok].astype(np.int32)
            r = r.take(pa.array(ok))
            places = [pa.array(r.column(c).to_numpy() + shift) for c in ("place", "item_place")]
            out.append(pa.RecordBatch.from_arrays([r.column("h1"), r.column("h2"), r.column("item_id"), *places, pa.array(matched[ok].astype(np.int32)), r.column("size")], ["h1", "h2", "item_id", "word", "item_word", "matched", "compared"]))
        yield from out


def text_hash() -> list[Column]:
    """128 bits of hash of a text: what a text holds depends on nothing else."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def found(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, hits): the texts of docs(text), by hash, that hold an item, and which, with the best place of each."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))
    short = sorted(r[0] if r[0] >= least else -r[0] for r in items.select(count.alias("n")).where(f"n between 1 and {WINDOW - 1}").distinct().collect())  # 12 at most
    kind = "hash long, size int, place int, words binary"
    seeded = stored(items.mapInArrow(lambda it: _sow(it, short, None, ["item_id"]), f"{kind}, item_id long"), "leak-items")
    shared = spark.sparkContext.broadcast(bit_filter(seeded, F.col("hash"), seeded.count()))
    mine = docs.select("text", *text_hash()).mapInArrow(lambda it: _sow(it, short, shared, ["h1", "h2"]), f"{kind}, h1 long, h2 long")
    both = mine.join(seeded.select("hash", "size", F.col("place").alias("item_place"), F.col("words").alias("item_words"), "item_id"), ["hash", "size"])
    held = both.drop("hash").mapInArrow(_verify, "h1 long, h2 long, item_id long, word int, item_word int, matched int, compared int")
    best = held.groupBy("h1", "h2", "item_id").agg(F.max(F.struct("matched", (-F.col("word")).alias("early"), (-F.col("item_word")).alias("item_early"), "compared")).alias("b"))
    hit = F.struct("item_id", (-F.col("b.early")).alias("word"), (-F.col("b.item_early")).alias("item_word"), F.col("b.matched").alias("matched"), F.col("b.compared").alias("compared"))
    return stored(best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(hit)).cast(HIT).alias("hits")), "leaks")


def _parted(docs: DataFrame, leaky: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs' rows that surely hold nothing, and the others, both with their texts' hashes, whose names come last."""
    names = [free_name(docs, "_h1"), free_name(docs, "_h2")]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(text_hash(), names, strict=True)])
    may = maybe(docs.sparkSession, bit_filter(leaky, F.col("h1")))(F.col(names[0]))
    return docs.where(~may), docs.where(may), names


def leaks(docs: DataFrame, benchmark: DataFrame, into: str = "leaks", least: int = LEAST) -> DataFrame:
    """docs with one more column: the benchmark items found in each text, with the place and the count of equal words.

    docs has a column text; benchmark item_id and text. Null and empty texts hold nothing, and null, empty or blank items are held by none;
    repeated item texts are looked for like any other, under each item_id, null ones too; item_id is a whole number. All rows of docs stay, repeated ones too. Of places that tie in equal words the
    first counts. Texts of any length are cut into words in slices of whole texts. A column named like `into`, in whatever case, is replaced. Only rows that may hold something are shuffled.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    leaky = found(docs, benchmark, least)
    clean, rest, (h1, h2) = _parted(docs, leaky)
    of1, of2, held = (free_name(rest, c) for c in ("_of1", "_of2", "_hits"))
    hits = leaky.select(F.col("h1").alias(of1), F.col("h2").alias(of2), F.col("hits").alias(held))
    rest = rest.select(*columns, h1, h2).join(hits, (F.col(h1) == F.col(of1)) & (F.col(h2) == F.col(of2)), "left")
    nothing = F.array().cast(HIT)
    return clean.select(*columns, nothing.alias(into)).union(rest.select(*columns, F.coalesce(held, nothing).alias(into)))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs without a leak, with docs' columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    leaky = found(docs, benchmark, least)
    kept, rest, (h1, h2) = _parted(docs, leaky)
    hits = leaky.select(F.col("h1").alias(h1), F.col("h2").alias(h2))
    return kept.select(*columns).union(rest.join(hits, [h1, h2], "left_anti").select(*columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether a benchmark item leaked into it, which, and the most equal words in a window."""
    docs = leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids"),
        F.array_max("leaks.matched").alias("matched"),
    )
