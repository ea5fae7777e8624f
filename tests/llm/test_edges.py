"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing column names; and the parts of the methods."""

import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, decontamination, jaccard, lines, media, mixing, pii, scoring, sharding, substrings, toxicity
from millrace.llm import tokens as tk

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [
    (1, "a b c d e f g", "s1"), (2, "A b c d e f g", "s1"), (3, None, "s1"), (4, "", None), (5, " \n\t ", "s2"), (6, LONG, "s2"), (7, LONG + " tail", None), (7, "other text of the same id", "s1"),
    (None, "a b c d e f g", "s1"), (None, None, None), (8, "a b c d e f g", "s1"), (8, "a b c d e f g", "s1"), (9, f"start {PASSAGE} end", "s3"), (10, f"begin {PASSAGE} stop", "s3"), (11, "é" * 50 + "\n" + "é" * 50, "s3"),
]
OPERATORS = {
    "mix": mixing.mix, "near_duplicates": jaccard.near_duplicates, "unique_lines": lines.unique_lines, "personal_data": pii.personal_data, "repeats": substrings.repeats,
    "scores": lambda d: scoring.scores(d, 3), "shard": sharding.shard, "leaks": lambda d: decontamination.leaks(d, d.selectExpr("doc_id item_id", "text")),
    "media": lambda d: media.resolve(media.parts(d.selectExpr("doc_id page_id", "text html")), media.features(media.store(d.select(media.padded(F.col("text")).alias("payload"))))),
}
ROW_FOR_ROW = {"mix", "near_duplicates", "unique_lines", "personal_data", "repeats", "scores", "shard", "leaks"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)


def same(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name in ROW_FOR_ROW:
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_clashing_columns_of_leaks_and_scores(spark, docs):
    """Columns that stand in the way of the operators' own come along; those named like a result are replaced, whatever their case."""
    names = ("_of1", "_OF2", "_hits", "_h1", "_h2", "hits", "item_id")
    bench = docs.selectExpr("doc_id item_id", "text")
    odd = docs.withColumns({c: F.lit("z") for c in (*names, "LEAKS")})
    got = decontamination.leaks(odd, bench)
    assert got.columns == [c for c in odd.columns if c != "LEAKS"] + ["leaks"] and all(r[c] == "z" for r in got.collect() for c in names)
    assert same(got.select("doc_id", "leaks")) == same(decontamination.leaks(docs, bench).select("doc_id", "leaks"))
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (2, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    scored = toxicity.score(docs.withColumns({"P_toxic": F.lit("z"), "words": F.lit("z")}), chain)
    assert scored.columns == ["doc_id", "text", "source", "words", "p_low_quality", "p_toxic"]
    assert same(scored.drop("words")) == same(toxicity.score(docs, chain)) and toxicity.score(docs.limit(0), chain).count() == 0


def test_stages_know_rows_by_more_than_their_id(spark):
    """Missing and repeated ids, unlike texts under one id, a map column."""
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(8, 20)))
    rows = [(None if i % 2 else i % 50, text(), f"s{i % 2}", {"k": str(i)}) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, meta map<string,string>").repartition(4)
    want = {r.source: r.words for r in mixing._mix(df.drop("meta"), block=16).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    got = Counter()
    for r in mixing.mixed(df, block=16).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - want[s]) <= 40 for s in want)
    one = jaccard.one_of_each(df.union(df.where("doc_id < 9")))  # 9 and fewer come twice
    assert one.columns == df.columns and Counter((r.doc_id, r.text) for r in one.collect()) == Counter(r[:2] for r in rows)


@pytest.mark.parametrize("name", sorted(ROW_FOR_ROW - {"shard", "leaks"}))
def test_other_columns_do_not_matter(docs, name):
    odd = docs.withColumns({c: F.lit("z") for c in ("size", "node", "key", "n", "row", "f", "block", "id", "component", "label", "words", "kept", "_n")})
    assert same(OPERATORS[name](odd)) == same(OPERATORS[name](docs))


CLASH = ("_leaks", "p_toxic", "_slot", "_shard", "_place", "_key", "_words", "_times", "taken", "shard", "leaks")


def test_stages_keep_columns(spark, docs, tmp_path):
    odd = docs.withColumns({c: F.lit("z") for c in CLASH})
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None), (3, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, str(tmp_path))
        want = odd.columns if k < 4 else [c for c in odd.columns if c != "shard"] + ["shard"]
        assert out.columns == want, name
        rows = out.collect()
        assert rows and all(r[c] == "z" for r in rows for c in CLASH if c != "shard" or k < 4), name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    ids = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    assert ids == {r[0] for r in ROWS} - {9, 10}


def test_no_labels_of_both_kinds(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.acceptable(docs, labels).count() == len(ROWS)


def test_near_duplicate_links(spark, docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got[1, 3] == got[2, 3] == got[8, 3] == 1 and got[3, 0] == 3 and got[4, 0] == 4 and got[None, 3] is None
    assert got[7, 2] == 6  # the rows of id 7 are one document
    kept = jaccard.one_of_each(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, 4, 5, 6, 7, 9, 11, None, None])  # 9 and 10 share 36 of 40 shingles; 7 has a text of its own besides


def random_sets(seed, n, groups):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.integers(8, 60))]
        for _ in range(n // groups):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = f"x{rng.integers(1000)}"
            out.append(" ".join(words))
    return out


def brute_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_large_groups_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = random_sets(1, 160, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "3" if chunk == 5 else before)  # groups go over batch edges
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    finally:
        spark.conf.set(batch, before)
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


@pytest.mark.parametrize("chunk", [4096, 1])
def test_link_that_no_star_finds(spark, monkeypatch, chunk):
    """Two texts link; in every group that they share, the least node is a one-shingle text, which links to neither."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    for salt in range(2000):
        words = [f"s{salt}w{i}" for i in range(14)]
        texts = [" ".join(words[i : i + 5]) for i in range(9)] + [" ".join(words), " ".join([*words[:13], "other"])]
        nodes = tk.signed(np.array([jaccard.digest(s, 1) for s in jaccard.shingle_sets(pa.array(texts), 5)], np.uint64)).to_pylist()
        if max(nodes[:9]) < min(nodes[9:]):
            break
    else:
        raise AssertionError("no salt")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert brute_components(texts) == [*range(10), 9]
    assert [got[i] for i in range(11)] == [*range(10), 9]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_every_link_is_given_out(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = random_sets(2, 48, 2)
    texts += [" ".join([*(f"v{i}" for i in range(30)), f"end{j}"]) for j in range(20)] + texts[:2]  # all link to each other; copies
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    near = {(a, b) for a, b in combinations(sorted(first.values()), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    count = Counter(x for p in near for x in p)
    assert len(near) > 2 * len(first)  # far from a forest
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (99, "")], "doc_id long, text string").repartition(3)
    got = [tuple(sorted((r.doc_a, r.doc_b))) for r in jaccard.link_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == near
    rows = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    assert [rows[i].n_links for i in range(len(texts))] == [count[first[s]] for s in sets] and rows[None].n_links == rows[99].n_links == 0
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(texts)
    kept = {r.doc_id for r in jaccard.one_of_each(df.where("doc_id < 99")).collect()}
    assert kept == set(brute_components(texts))


@pytest.mark.parametrize("chunk", [4096, 7])
def test_trees_through_spark(spark, monkeypatch, chunk):
    """One tree of texts that partly link, over Spark: survivors lose no link, links join all components, counts are whole."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = list(dict.fromkeys(random_sets(7, 160, 4)))
    sets = jaccard.shingle_sets(pa.array(texts), 5)
    near = {(i, j) for i, j in combinations(range(len(sets)), 2) if jaccard.linked(sets[i], sets[j], 80)}
    rows = [(0, i, len(s), jaccard.bitmap(s), s.tobytes(), [0, 9]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "tree long, node long, n int, bits binary, items binary, trees array<long>").repartition(3)
    kept = {r.node for r in jaccard.tree_survivors(jaccard.work_items(df), 80).collect()}
    assert kept >= {x for p in near for x in p}
    for whole, every in ((True, True), (True, False), (False, False)):
        out = jaccard.tree_links(jaccard.work_items(df.where(F.col("node").isin(kept))), 80, whole, every).collect()
        links = [(r.a, r.b) for r in out if r.a is not None]
        assert set(links) <= near and len(links) == len(set(links)) and (not every or set(links) == near)
        parent = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert [parent.get(i, i) for i in range(len(texts))] == brute_components(texts)
        count = Counter()
        for r in out:
            count.update({r.node: r.found or 0})
        assert not whole or all(count[i] == sum(i in p for p in near) for i in range(len(texts)))
    other = df.withColumn("tree", F.lit(9)).where(F.col("node").isin(kept))  # pairs of trees 0 and 9 are judged in tree 0
    assert jaccard.tree_links(jaccard.work_items(other), 80, True).count() == 0


def test_groups_keep_all_pairs_that_sizes_allow(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(12)), i, int(n), int(n * rng.uniform(0.7, 1.25))) for i, n in enumerate(rng.integers(5, 60, 300))]
    rows += [(99, 7, 10, 12), (99, 7, 10, 12), (98, 1001, 10, 12), (98, 1002, 13, 16), (97, 1003, 10, 12), (97, 1004, 12, 9)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, i, j) for k, i, n, most in rows for q, j, m, far in rows if k == q and i != j and m <= most and n <= far}
    for size in ("10000", "3", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = jaccard.groups(spark.createDataFrame(rows, "key long, node long, n int, most int")).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        trees = {}
        for r in got:
            trees.setdefault(r.node, set()).add(r.tree)
        assert all(trees[i] & trees[j] for _, i, j in want)
        assert all(i < 1000 for i in trees)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_table():
    owner = sharding.lookup_table([f"s{i}" for i in range(7)], 101)
    counts = Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(owner) == set(range(7))
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 101)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a < 6) < 40
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(["a"], 100)


def test_schedule_is_exact_and_even(spark):
    n = {0: 500, 1: 3, 2: 0, 3: 250}
    rows = mixing.schedule(spark.createDataFrame(list(n.items()), "sid int, n long")).collect()
    by = {s: sorted(r.slot for r in rows if r.sid == s) for s in n}
    assert {s: len(x) for s, x in by.items()} == n and len({r.slot for r in rows}) == len(rows)
    assert all([r.block for r in sorted(rows, key=lambda r: r.slot) if r.sid == s] == list(range(n[s])) for s in n)
    half = sum(x < 512 for x in by[0])
    assert abs(half - 250) <= 5


def test_mix_reaches_targets(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i % 17)), f"s{i % 5 if i % 7 else 9}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(df, block=16).collect()
    per = {}
    for r in rows:
        per.setdefault((r.source_size, r.target), []).append(r.taken)
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(sum(t) - target) <= 0.5 + 1e-6 for (_, target), t in per.items())
    assert same(mixing.mix(df.repartition(7), block=16)) == same(mixing.mix(df, block=16))


def test_mixed_keeps_texts_without_words(spark):
    """Source a (weight 5) is taken whole, b (2) is cut, c has no words at all."""
    rows = [(1, "w " * 10, "a"), (2, "", "a"), (3, None, "a"), (None, " ", "a"), (4, "w " * 100, "b"), (5, "", "b"), (None, "", "b"), (6, "\n", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.doc_id: (r.target, r.source_size) for r in mixing.mix(df).collect() if r.doc_id}
    assert target[2][0] >= target[2][1] and target[5][0] < target[5][1] and target[6] == (0, 0)
    got = Counter((r.doc_id, r.source) for r in mixing.mixed(df).collect() if not (r.text or "").strip())
    assert got == Counter([(2, "a"), (3, "a"), (None, "a"), (6, "c")])


def test_lines_of_rows_without_id(spark):
    one, two = "the common line that also stands in a row with no id at all", "a line that only rows with no id have, and one that is like it"
    rows = [(None, one + "\n" + two), (None, "another row"), (1, one), (2, one + "s"), (3, two + "s"), (4, "none of these")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.kept): (r.n_lines, r.n_removed) for r in lines.unique_lines(df).collect()}
    assert got == {(None, rows[0][1]): (2, 0), (None, "another row"): (1, 0), (1, ""): (1, 1), (2, ""): (1, 1), (3, ""): (1, 1), (4, "none of these"): (1, 0)}


def near_lines(rng, n):
    """n pairs of lines whose 5-character shingles are 0.8 to 0.9 alike, and as many lines without a partner."""
    pairs = []
    while len(pairs) < n:
        a = "".join(rng.choice(list("abcdefghij klmno"), rng.integers(60, 300)))
        b = list(a)
        for _ in range(rng.integers(1, 8)):
            b[rng.integers(len(b))] = str(rng.integers(10))
        b = "".join(b)
        x, y = lines.shingles(a.strip()), lines.shingles(b.strip())
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            pairs.append((a.strip(), b.strip()))
    return pairs


def test_line_recall(spark):
    """At least 0.9 of the pairs at 0.8 to 0.9 are found; nothing else goes."""
    pairs = near_lines(np.random.default_rng(5), 400)
    rows = [(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, "own " + b) for i, (_, b) in enumerate(pairs)] + [(2000 + i, b) for i, (_, b) in enumerate(pairs)]
    got = {r.doc_id: r.n_removed for r in lines.unique_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[2000 + i] for i in range(400)) >= 0.95 * 400 and not any(got[i] for i in range(400))


@pytest.mark.parametrize("chunk", [4096, 5])
def test_crowded_lines_by_brute_force(spark, monkeypatch, chunk):
    """Large groups of near lines with a hub that is like few of them: all components are found."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefghijklmnop "), 90)).strip() for _ in range(3)]
    texts = []
    for i in range(150):
        x = list(base[i % 3])
        for _ in range(rng.integers(0, 4)):
            x[rng.integers(len(x))] = "XYZ"[rng.integers(3)].lower()
        texts.append("".join(x).strip())
    sets = [lines.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = {r.doc_id: r.n_removed for r in lines.unique_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == [int(find(i) != i) for i in range(len(texts))]


def test_masks_cover_two_substitutions():
    width = max(m[-1] for m in decontamination.MASKS) + 1
    for bad in combinations(range(decontamination.WINDOW), 2):
        assert any(not set(bad) & {o + p for p in m} for m in decontamination.MASKS for o in range(decontamination.WINDOW - width + 1)), bad


def test_substituted_leaks(spark):
    item = [f"item{i}" for i in range(20)]
    def swap(*at):
        return " ".join("zzz" if i in at else w for i, w in enumerate(item))
    rows = [(0, f"x {swap()} y"), (1, f"x y {swap(3, 9, 15)}"), (2, swap(0, 3, 6, 9, 12, 15, 18)), (3, " ".join(item[:12])), (4, " ".join(item[3:17]).upper()), (5, "one two three four five six"), (6, "one two three four five sux")]
    rows += [(7, "Yes\tNO"), (8, "yes no maybe"), (9, "x a1 a2 a3 zzz a5 a6 a7 y"), (10, "a1 a2 zzz a4 zzz a6 a7"), (11, " ".join(["ha"] * 400)), (12, None), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five six"), (3, "yes no"), (4, " ".join(item)), (5, "a1 a2 a3 a4 a5 a6 a7"), (6, " ".join(["ha"] * 30)), (7, None), (8, " "), (None, "x")], "item_id long, text string")
    found = {r.doc_id: r.leaks for r in decontamination.leaks(docs, bench).collect()}
    assert {k: sorted(x.item_id for x in v) for k, v in found.items()} == {0: [1, 4], 1: [1, 4], 2: [], 3: [], 4: [1, 4], 5: [2], 6: [], 7: [3], 8: [], 9: [5], 10: [], 11: [6], 12: [], 13: []}  # the item without id is no whole text here
    assert [(x.word, x.item_word, x.matched, x.compared) for x in found[0]] == [(1, 0, 13, 13)] * 2 and [(x.word, x.item_word, x.matched, x.compared) for x in found[9]] == [(1, 0, 6, 7)]
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {2, 3, 6, 8, 10, 12, 13}


@pytest.mark.parametrize("least", [1, 5])
def test_short_items_and_items_without_id(spark, least):
    """least = 1 finds an item of two words anywhere; a null item_id counts like any other."""
    docs = spark.createDataFrame([(1, "well yes no maybe"), (2, "YES no"), (3, "no yes"), (4, "x a b c d e f y"), (5, "a b c d f e")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "yes no"), (7, "a b c d e f")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.leaks(docs, bench, least=least).collect()}
    assert got == {1: [None] if least == 1 else [], 2: [None], 3: [], 4: [7], 5: []}


def test_leaks_by_brute_force(spark):
    """Both sides: every text that holds an item is found, with each item, and no other."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(60)}"
    items = [[word() for _ in range(n)] for n in (*range(1, 30), 13, 13, 14, 40)]
    texts = []
    for k in range(300):
        x = list(items[k % len(items)])
        x = x[rng.integers(0, max(1, len(x) - 12)) :] if rng.random() < 0.3 else x
        for _ in range(rng.integers(0, 5)):
            x[rng.integers(len(x))] = word()
        texts.append(" ".join([word() for _ in range(rng.integers(0, 12) if rng.random() < 0.8 else 0)] + x + [word() for _ in range(rng.integers(0, 12) if rng.random() < 0.8 else 0)]))

    def holds(text, item):
        x, n = text.split(), len(item)
        if n < 5:
            return x == item
        size = min(n, 13)
        need = 11 if size == 13 else size - (size >= 7)
        return any(sum(map(str.__eq__, x[i : i + size], item[j : j + size])) >= need for i in range(len(x) - size + 1) for j in range(n - size + 1))

    want = {k: [i for i, item in enumerate(items) if holds(t, item)] for k, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontamination.leaks(docs, bench).collect()} == want
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {k for k, v in want.items() if not v}
    assert 50 < sum(map(bool, want.values())) < 290


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 300_000, "1." * 500_000, "+1" * 300_000, "+" + "(" * 1_000_000, "0" * 500_000 + ".1.1.1", "4 " * 500_000, "AB12" * 250_000])
def test_pii_takes_linear_time(text):
    start = time.time()
    pii.find(text)
    assert time.time() - start < 8


def test_emails_like_the_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(4)
    for _ in range(20_000):
        t = "".join(rng.choice(list("ab1.@_- é"), rng.integers(0, 24)))
        assert list(pii.emails(t)) == [m.span() for m in plain.finditer(t)], t


def test_incremental_index(spark):
    """A kept index: a later batch is judged against what came before, run by run, also after compaction."""
    docs = spark.createDataFrame([(1, PASSAGE), (2, "q " + PASSAGE), (3, " ".join(f"own{i}" for i in range(50))), (4, "x " + " ".join(f"own{i}" for i in range(40)) + " y"), (5, "nothing of the kind"), (6, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    index = substrings.FingerprintIndex(spark, 3)
    got = {}
    for batch in ([1, 3], [2], [4, 5], [6]):
        history = docs.where(F.col("doc_id") < min(batch)).where(F.col("doc_id").isin(*got)) if got else None
        for r in substrings.repeats(docs.where(F.col("doc_id").isin(*batch)), batches=1, index=index, history=history).collect():
            got[r.doc_id] = r.n_removed
        if 2 in got and len(index.runs) > 1:
            index.compact()
            assert len(index.runs) == 1
    assert got == {1: 0, 3: 0, 2: 40, 4: 40, 5: 0, 6: 0}
    again = substrings.repeats(docs.where("doc_id = 4"), batches=1, index=index, history=docs.where("doc_id in (1, 2, 3, 5, 6)")).first()
    assert again.n_removed == 40
    index.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_prefixes_of_the_mix_keep_the_weights(spark):
    """Of any number of first slots, each source has its share to within a few."""
    n = {0: 500, 1: 200, 2: 100, 3: 224}
    rows = sorted((r.slot, r.sid) for r in mixing.schedule(spark.createDataFrame(list(n.items()), "sid int, n long")).collect())
    total, seen = sum(n.values()), Counter()
    for k, (_, sid) in enumerate(rows, 1):
        seen[sid] += 1
        assert all(abs(seen[s] - k * n[s] / total) <= 6 for s in n)


def test_repeats_within_one_document(spark):
    words = [f"w{i}" for i in range(36)]
    df = spark.createDataFrame([(1, " ".join(words * 2 + ["end"])), (2, "end " + " ".join(words[:34])), (3, " ".join(["same"] * 40))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.repeats(df).collect()}
    assert got == {1: (73, 72, "end"), 2: (35, 0, None), 3: (40, 40, "")}


def test_html_sequences(spark):
    html = "<p>Hi &amp; bye</p><figure><img src='sha256:ab' alt='alt'><figcaption>The <b>cap</b></figcaption></figure><script>x</script>after<img src='http://h/i.png' alt='i'><p>end"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    rows = {r.page_id: r.parts for r in media.sequences(media.parts(df)).collect()}
    assert [(p.position, p.kind, p.text, p.digest, p.url, p.caption) for p in rows[1]] == [
        (0, "text", "Hi & bye", None, None, None), (1, "media", None, "ab", None, "The cap"), (2, "text", "after", None, None, None), (3, "media", None, None, "http://h/i.png", "i"), (4, "text", "end", None, None, None),
    ]
    assert set(rows) == {1}


def test_media_query_on_odd_rows(spark, docs, tmp_path):
    """Repeated and missing ids, null texts, copies in several tasks: a row a row, equal texts with equal values."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op4_media(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == Counter((r[0], len((r[1] or "").encode())) for r in ROWS)
    assert len({r[1:] for r in rows}) == len({r[1] or "" for r in ROWS}) and all(r.media_sha256 for r in rows)


def test_words_and_hashes():
    texts = ["Ab  c\td", None, "", "é x", "  zz", "ab c d", "x" * 3_000_000 + " y"]
    w = tk.split_words(pa.array(texts), lower=True)
    got = [bytes(w.data[s:e]) for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in (t or "").encode().lower().split()] and w.first.tolist() == [0, 3, 3, 3, 5, 6, 9, 11]
    h = tk.word_hashes(w)
    assert h[0] == h[6] and len(set(h.tolist())) == len(set(got))
