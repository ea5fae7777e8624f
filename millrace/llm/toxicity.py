"""Toxicity by a classifier chain.

The categories are predicted one after the other, in CHAIN's order. A category's linear model sees the document's
features and the probabilities of the categories before it. For training, those probabilities come from models that
haven't seen the document (FOLDS folds), so that a later model learns how far to trust an earlier one.

Features: log2(1 + count) of the most telling hashed words (runs of letters, digits and non-ASCII bytes, lower case), picked by
chi-square on the training rows alone, and a few ratios of the text's form. Thresholds are learned from the out-of-fold probabilities as well, by the share of
false alarms that is allowed, so that toxic words diluted in a long text count.
The models are fitted in one task on SAMPLE labelled documents at most, those first by a hash of doc_id; all else covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import tokens as tk
from millrace.llm.common import free_name, table

#: Category -> the label that makes it true.
CHAIN = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
#: The most labelled documents that a fit reads.
SAMPLE = 10_000
WORDS, FOLDS, RIDGE, STEPS, BITS = 192, 5, 0.3, 8, 20
#: A category's threshold is what this share of its negatives reach out of fold, within these bounds.
FALSE_SHARE, THRESHOLDS = 0.004, (0.1, 0.5)
FORMS = ("log_words", "word_length", "upper", "marks", "distinct")

NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = [not chr(c).isalnum() for c in range(128)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word, weight) of each document's words, each once, sorted; and the form ratios, a row per document."""
    w = tk.split_words(texts, lower=True, space=NOT_WORD)
    n = np.diff(w.first)
    bucket = (tk.word_hashes(w) >> tk.U(64 - BITS)).astype(np.int64)
    pair, times = np.unique((w.doc() << BITS) | bucket, return_counts=True)
    doc, word = pair >> BITS, pair & ((1 << BITS) - 1)
    raw, offsets = tk.column_bytes(texts)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    upper, marks = count((raw >= 65) & (raw <= 90)), count(NOT_WORD[raw] & ~tk.SPACE[raw])
    some = np.maximum(n, 1)
    letters = np.diff(np.concatenate([[0], np.cumsum(w.end - w.start)])[w.first])
    forms = np.stack([np.log1p(n), letters / some, upper / size, marks / size, np.bincount(doc, minlength=len(n)) / some], 1)
    return doc, word, np.log2(1.0 + times), forms


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """A ridge logistic regression over picked words, forms and earlier probabilities."""

    threshold = THRESHOLDS[1]

    def __init__(self, doc: np.ndarray, word: np.ndarray, value: np.ndarray, dense: np.ndarray, y: np.ndarray):
        n, pos = len(y), max(1, int(y.sum()))
        inside = np.bincount(word[y[doc] > 0], minlength=1 << BITS)
        overall = np.bincount(word, minlength=1 << BITS)
        outside = overall - inside
        a, b, c, d = inside, outside, pos - inside, (n - pos) - outside
        chi = n * (a * d - b * c).astype(float) ** 2 / np.maximum(1.0, overall * (n - overall) * float(pos) * max(1, n - pos))
        top = np.lexsort((np.arange(len(chi)), -chi))[:WORDS]
        self.words = np.sort(top[overall[top] > 1])
        self.mean, self.scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
        x = self.matrix(doc, word, value, dense)
        self.w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], RIDGE)
        penalty[0] = 1e-6
        for _ in range(STEPS):  # Newton
            p = _sigmoid(x @ self.w)
            s = np.maximum(p * (1 - p), 1e-4)
            self.w += np.linalg.solve((x.T * s) @ x + np.diag(penalty), x.T @ (y - p) - penalty * self.w)

    def matrix(self, doc: np.ndarray, word: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        k = len(self.words)
        x = np.zeros((len(dense), 1 + k + dense.shape[1]))
        x[:, 0] = 1
        at = np.minimum(np.searchsorted(self.words, word), max(0, k - 1))
        if k:
            hit = self.words[at] == word
            x[doc[hit], 1 + at[hit]] = value[hit]
        x[:, 1 + k :] = (dense - self.mean) / self.scale
        return x

    def probability(self, doc: np.ndarray, word: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Without the matrix: a lookup and a sum per document."""
        k = len(self.words)
        z = self.w[0] + ((dense - self.mean) / self.scale) @ self.w[1 + k :]
        if k:
            at = np.minimum(np.searchsorted(self.words, word), k - 1)
            hit = self.words[at] == word
            z = z + np.bincount(doc[hit], self.w[1 + at[hit]] * value[hit], len(dense))
        return _sigmoid(z)


def _subset(doc: np.ndarray, word: np.ndarray, value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number = np.full(len(rows), -1)
    number[rows] = np.arange(rows.sum())
    keep = rows[doc]
    return number[doc[keep]], word[keep], value[keep]


def fit_chain(doc: np.ndarray, word: np.ndarray, value: np.ndarray, forms: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray) -> list[tuple[str, Linear]]:
    """One model per category that has both kinds of rows. labels: category -> 1, 0 or -1 (unknown)."""
    chain, dense = [], forms
    for name, y in labels.items():
        known = y >= 0
        if len(np.unique(y[known])) < 2:
            continue
        fitted = lambda rows, x=dense, t=y: Linear(*_subset(doc, word, value, rows), x[rows], t[rows].astype(float))
        p = np.zeros(len(y))
        for k in range(FOLDS):
            held, rest = fold == k, known & (fold != k)
            if held.any() and len(np.unique(y[rest])) == 2:
                p[held] = fitted(rest).probability(*_subset(doc, word, value, held), dense[held])
        model = fitted(known)
        clean = p[y == 0]
        model.threshold = float(np.clip(np.quantile(clean, 1 - FALSE_SHARE), *THRESHOLDS)) if len(clean) else THRESHOLDS[1]
        chain.append((name, model))
        dense = np.column_stack([dense, p])
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, Linear]]:
    """Fits the chain on `sample` labelled documents at most.

    Of rows of labels with one doc_id, the least quality and the greatest toxicity count. Null labels are unknown.
    """
    wanted = {c for c, _ in CHAIN.values()}
    votes = [(F.max if good else F.min)(c).alias(f"y_{k}") for k, (c, good) in CHAIN.items()]
    once = labels.where("doc_id is not null").select("doc_id", *wanted).groupBy("doc_id").agg(*votes)
    once = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    truth = [F.when(F.col(f"y_{k}").isNull(), -1).otherwise((F.col(f"y_{k}") == v).cast("int")).alias(f"y_{k}") for k, (_, v) in CHAIN.items()]
    rows = docs.select("doc_id", "text").join(F.broadcast(once.select("doc_id", *truth)), "doc_id")
    names = [f"y_{k}" for k in CHAIN]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                doc, word, value, forms = features(b.column("text"))
                words = tk.lists(pa.array(word.astype(np.int32)), np.bincount(doc, minlength=b.num_rows))
                values = tk.lists(pa.array(value), np.bincount(doc, minlength=b.num_rows))
                shape = tk.lists(pa.array(forms.ravel()), np.full(b.num_rows, forms.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(n) for n in names], words, values, shape], ["doc_id", *names, "words", "values", "forms"])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        lists = table.column("words").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        doc, word = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy().astype(np.int64)
        value = table.column("values").combine_chunks().flatten().to_numpy()
        forms = table.column("forms").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        fold = (tk.mix(ids.astype(np.int64).view(tk.U)) % tk.U(FOLDS)).astype(int)
        chain = fit_chain(doc, word, value, forms, {k: table.column(f"y_{k}").to_numpy() for k in CHAIN}, fold)
        return pa.table({"name": [n for n, _ in chain], **{c: [getattr(m, c).tolist() for _, m in chain] for c in ("words", "w", "mean", "scale")}, "threshold": [m.threshold for _, m in chain]}, model)

    model = pa.schema([("name", pa.string()), ("words", pa.list_(pa.int64())), *((c, pa.list_(pa.float64())) for c in ("w", "mean", "scale")), ("threshold", pa.float64())])
    got = rows.mapInArrow(extract, f"doc_id long, {', '.join(f'{n} int' for n in names)}, words array<int>, values array<double>, forms array<double>")
    got = got.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "name string, words array<long>, w array<double>, mean array<double>, scale array<double>, threshold double")
    fitted = {r["name"]: r for r in got.collect()}
    chain = []
    for name in CHAIN:
        if name in fitted:
            m = Linear.__new__(Linear)
            for c in ("words", "w", "mean", "scale"):
                setattr(m, c, np.array(fitted[name][c], np.int64 if c == "words" else float))
            m.threshold = fitted[name]["threshold"]
            chain.append((name, m))
    return chain


def threshold(chain: list[tuple[str, Linear]], category: str = "toxic") -> float:
    """From which probability on a document counts as of the category."""
    return dict(chain)[category].threshold if category in dict(chain) else THRESHOLDS[1]


def _score(chain: list[tuple[str, Linear]], kept: list[str], new: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                doc, word, value, dense = features(b.column("text"))
                p = dict.fromkeys(CHAIN, np.zeros(b.num_rows))
                for name, model in chain:
                    p[name] = model.probability(doc, word, value, dense)
                    dense = np.column_stack([dense, p[name]])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(p[k]) for k in CHAIN]], [*kept, *new])

    return run


def score(docs: DataFrame, chain: list[tuple[str, Linear]], prefix: str = "p_") -> DataFrame:
    """docs with <prefix><category> for each category of CHAIN; 0 for those that couldn't be learned (no labels of both kinds).

    A null text is scored as an empty one, texts of any length whole; rows alike in text score alike. All rows stay, and columns named like the new ones, in
    whatever case, are replaced.
    """
    new = [f"{prefix}{k}" for k in CHAIN]
    kept = [c for c in docs.columns if c.lower() not in new]
    df = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]])
    return df.mapInArrow(_score(chain, kept, new), schema)


def acceptable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the chain doesn't call toxic, with docs' columns. A probability equal to the threshold is toxic; rows alike in text share their fate."""
    prefix = "p_"
    while any(free_name(docs, f"{prefix}{k}") != f"{prefix}{k}" for k in CHAIN):
        prefix += "_"
    chain = train(docs, labels)
    return score(docs, chain, prefix).where(F.col(f"{prefix}toxic") < threshold(chain)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).select("doc_id", *[f"p_{k}" for k in CHAIN], (F.col("p_toxic") >= threshold(chain)).alias("toxic"))
