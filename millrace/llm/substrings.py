"""Substring dedup by a log-structured index of window fingerprints.

A window is `window` consecutive words. Its fingerprint is the least hash among the `part`-word sequences in it, so that equal
windows have equal fingerprints, while neighbouring windows mostly share theirs: a document yields one posting
(fingerprint, row, places) for some 12 % of its words. row is a hash of the text: what goes depends on nothing else.

FingerprintIndex keeps sorted, immutable runs (fingerprint, n), bucketed by fingerprint. A batch is merge-joined with the runs there are,
without a shuffle, as all have the same buckets and order, and becomes a run of its own. compact() merges runs into one, adding up counts.

Fingerprints seen twice only propose: each window that has one is then compared by 128 bits of hash of all its words, over
the whole input. The windows that turn out to stand alone are few, so it is those that go back to the documents.

repeats() handles one input in batches. With an index that is kept and the texts that it was made of, it handles a later input against those.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens as tk
from millrace.llm.common import discard, new_path, release, stored, table

WINDOW, PART, BATCHES = 35, 20, 2
#: Runs beyond this number are compacted.
RUNS = 4


def _fingerprints(w: tk.Words, h: np.ndarray, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's fingerprint, which windows lie within one text, and the part hashes."""
    g = tk.windows(h, part)
    n = max(0, len(h) - window + 1)
    least = g[: n + window - part].copy()
    reach = 1
    while reach < window - part + 1:
        step = min(reach, window - part + 1 - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return least[:n], tk.whole(w.first, len(h), window), g


def postings(docs: DataFrame, window: int, part: int) -> DataFrame:
    """(f, row, n): the fingerprints of docs(row, text), and at how many places a row has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                w = tk.split_words(b.column("text"))
                h = tk.word_hashes(w)
                f, ok, g = _fingerprints(w, h, window, part)
                chosen = np.zeros(len(g), bool)
                for k in range(window - part + 1):
                    chosen[k : k + len(f)] |= ok & (f == g[k : k + len(f)])
                at = np.flatnonzero(chosen)
                doc, value = w.doc()[at], g[at]
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])[: len(doc)])
                n = np.diff(np.append(new, len(doc))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([tk.signed(value[new]), b.column("row").take(pa.array(doc[new])), pa.array(n)], ["f", "row", "n"])

    return docs.select("row", "text").mapInArrow(run, "f long, row long, n int")


class FingerprintIndex:
    """Sorted runs of (f, n) and the postings (f, row, n) behind them, bucketed alike, in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.runs, self.parts, self.made = spark, [], [], []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, key: str = "f") -> DataFrame:
        """df as a table bucketed and sorted by key. It must be dealt out by key already, or be so by this call's shuffle."""
        name, path = f"run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        df.write.bucketBy(self.buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
        self.made.append(name)
        release(self.spark)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of postings. Returns the fingerprints (f) that it shares with earlier runs, or has more than once."""
        kept = self.write(batch.repartition(self.buckets, "f"))
        run = self.write(kept.groupBy("f").agg(F.sum("n").alias("n")))
        shared = run.where("n > 1").select("f")
        if self.runs:
            shared = shared.union(self.probe(run).select("f")).distinct()
        shared = stored(shared, "repeat-shared")
        self.parts.append(kept), self.runs.append(run)
        if len(self.runs) > RUNS:
            self.compact()
        return shared

    def probe(self, batch: DataFrame) -> DataFrame:
        """(f, seen) of the batch's fingerprints that earlier runs hold: one merge join a run."""
        found, batch = None, batch.groupBy("f").agg(F.lit(0)).select("f")
        for run in self.runs:
            hit = batch.join(run.hint("merge"), "f").select("f", F.col("n").alias("seen"))
            found = hit if found is None else found.union(hit)
        return found.groupBy("f").agg(F.sum("seen").alias("seen")) if found is not None else batch.selectExpr("f", "0L seen").limit(0)

    def compact(self) -> DataFrame:
        """Merges all runs into one and forgets the old ones."""
        while len(self.runs) > 1:
            a, b = self.runs[0], self.runs[1].withColumnRenamed("n", "m")
            both = a.hint("merge").join(b, "f", "full").select("f", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            merged = self.write(both)
            discard(*self.runs[:2])
            self.runs = [merged, *self.runs[2:]]
        return self.runs[0]

    def forget(self) -> None:
        """Deletes the index."""
        discard(*self.parts, *self.runs)
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.parts, self.made = [], [], []


def _candidates(b: pa.RecordBatch, window: int, part: int) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """Words, their hashes, and the places of windows whose fingerprint is among the document's column fs."""
    w = tk.split_words(b.column("text"))
    h = tk.word_hashes(w)
    f, ok, _ = _fingerprints(w, h, window, part)
    fs = b.column("fs")
    values = fs.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(tk.U)
    owner = np.repeat(np.arange(len(fs)), np.diff(fs.offsets.to_numpy()))
    doc = w.doc()[: len(f)]
    # A fingerprint seen twice is so in every document, so membership in the slice's set is enough.
    known = np.unique(values)
    at = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
    hit = ok & (known[at] == f) if len(known) else np.zeros(len(f), bool)
    return w, h, np.flatnonzero(hit & np.isin(doc, owner))


def repeats(docs: DataFrame, window: int = WINDOW, part: int = PART, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept.

    Removes every word that lies in a window whose words also start anywhere else, in any document or the same one. kept: the
    words left, joined by one space, or null where nothing was removed. Null texts have no words. Rows that
    repeat a doc_id, or have none, are documents of their own, and so are rows alike in all. Texts of any length are cut in slices.

    index: where the fingerprints go, and stay; by default one that is deleted at the end. history(text): what an index that is
    not empty was made of; its windows count as places elsewhere.
    """
    spark = docs.sparkSession
    row = F.xxhash64("text").alias("row")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, "text")
    own = index is None
    index = index or FingerprintIndex(spark)
    shared = [index.add(postings(docs.where(F.pmod("row", F.lit(batches)) == k), window, part)) for k in range(batches)]
    twice = shared[0]
    for more in shared[1:]:
        twice = twice.union(more)
    twice = stored(twice.distinct().repartition(index.buckets, "f").sortWithinPartitions("f"), "repeat-twice")
    found = None
    for kept in index.parts:
        hit = kept.hint("merge").join(twice, "f").select("row", "f")
        found = hit if found is None else found.union(hit)
    # A set, as copies have one row: no longer than a text.
    lists = stored(found.groupBy("row").agg(F.collect_set("f").alias("fs")), "repeat-lists")
    discard(*shared, twice)
    if own:
        index.forget()

    of = lists.select(F.col("row").alias("id"), "fs")
    flagged = stored(docs.join(of, F.col("row") == F.col("id")).select("doc_id", "row", "text", "fs"), "repeat-texts")
    old = history.select(row, "text").join(of, F.col("row") == F.col("id")).select("row", "text", "fs") if history is not None else None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                w, h, at = _candidates(b, window, part)
                sums = [tk.windows(h, window, salt)[at] for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([*map(tk.signed, sums), b.column("row").take(pa.array(w.doc()[at]))], ["w1", "w2", "row"])

    texts = flagged.select("row", "text", "fs")
    seen = (texts.union(old) if old is not None else texts).mapInArrow(windows, "w1 long, w2 long, row long").groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    alone = seen.where("n = 1").groupBy("row").agg(F.collect_list("w1").alias("alone"))  # of one text, as it has no copies

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                w, h, at = _candidates(b, window, part)
                free = b.column("alone").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(tk.U)
                at = at[~np.isin(tk.windows(h, window, 1)[at], free)]
                edge = np.zeros(len(h) + 1, int)
                np.add.at(edge, at, 1), np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                data, rows = w.data.tobytes(), []
                for k, n in enumerate(removed.tolist()):
                    i, j = w.first[k], w.first[k + 1]
                    keep = np.flatnonzero(~gone[i:j]) + i
                    text = b" ".join([data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                    rows.append((int(j - i), n, hashlib.sha256(text).hexdigest(), text.decode() if n else None))
                n_words, n_removed, sha, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t.as_py() or "").encode().split() for t in b.column("text")]
            sha = [hashlib.sha256(b" ".join(x)).hexdigest() for x in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(list(map(len, words)), pa.int64()), pa.array(sha, pa.string())], ["doc_id", "row", "n_words", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    done = flagged.join(alone.withColumnRenamed("row", "id"), F.col("row") == F.col("id"), "left")
    done = done.select("doc_id", "text", "fs", F.coalesce("alone", F.array().cast("array<long>")).alias("alone")).mapInArrow(remove, schema)
    rest = docs.mapInArrow(unchanged, "doc_id long, row long, n_words long, kept_sha256 string").join(lists, "row", "left_anti")
    return done.union(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


#: Windows as texts of their words.
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS t
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w) q),
twice AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (
  SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win SEMI JOIN twice USING (t)) q GROUP BY doc_id),
j AS (SELECT w.doc_id, words, coalesce(ps, []) AS ps FROM w LEFT JOIN gone ON w.doc_id IS NOT DISTINCT FROM gone.doc_id),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM j) x
  ANTI JOIN (SELECT doc_id, unnest(ps) AS i FROM j) g ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT j.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM j LEFT JOIN k ON j.doc_id IS NOT DISTINCT FROM k.doc_id
"""
