"""SimHash fingerprints and links against plain loops; every way to part the bits and every choice of thresholds."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries, simhash
from millrace.llm.common import components

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The least index that links of at most two bits lead to."""
    fps = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2).tolist():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = np.random.default_rng(1)
    texts = [None, "", " \n", "one", "One\ttwo", "one two three", "é É ß x", "a b a b a b a b", "x " * 200_000] + [" ".join(rng.choice(["Ab", "c", "dé", "E-f"], rng.integers(1, 90))) for _ in range(60)]
    assert simhash.simhash(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
    assert len(simhash.simhash(pa.array([], pa.string()))) == 0


def test_spark_hashes_alike(spark):
    """Spark's xxhash64 is XXH64 with seed 42, which the contract names."""
    row = spark.sql("SELECT xxhash64('ab é c') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64("ab é c".encode(), seed=42).intdigest()


def clustered(rng, n, groups):
    """Fingerprints around few centres, some alike, some a few bits apart, and random ones."""
    centres = rng.integers(0, 2**64, groups, np.uint64)
    out = []
    for _ in range(n):
        x = int(centres[rng.integers(groups)]) if rng.random() < 0.8 else int(rng.integers(0, 2**64, dtype=np.uint64))
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize(("parts", "crowded"), [(2, 40), (2, 10**9), (3, 256), (3, 10**9), (4, 0), (4, 40), (4, 10**9)])
def test_links_by_brute_force(spark, monkeypatch, parts, crowded):
    monkeypatch.setattr(simhash, "part_widths", lambda n: {2: [32, 32], 3: [22, 21, 21], 4: [16] * 4}[parts])
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    fps = list(dict.fromkeys(clustered(np.random.default_rng(parts + crowded % 97), 500, 12) + [0, 1, 3, 7, 2**63, 2**64 - 1, 2**64 - 2]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    turned, pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3))
    name = {r.t: r.fp for r in turned.collect()}
    place = {x: i for i, x in enumerate(signed)}
    got = [(place[name[r.a]], place[name[r.b]]) for r in pairs.collect()]
    near = {(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in got} <= near and (crowded < 10**9 or {tuple(sorted(p)) for p in got} == near)
    parent = {r.node: r.component for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
    assert [parent.get(i, i) for i in range(len(fps))] == plain_components(fps)


def test_choices_hold_the_pigeonhole(monkeypatch):
    """Any link is within the threshold of some part, whatever the choice; crowded parts are left out."""
    rng = np.random.default_rng(5)
    layout = simhash.Layout([list(range(i, 64, 4)) for i in range(4)])
    t = rng.integers(0, 2**64, 3000, np.uint64)
    t[:1500] = t[:1500] >> np.uint64(16) | np.uint64(0xABCD << 48)  # half share the first part
    counts = []
    for (cell,) in layout.cells:
        v = ((t >> np.uint64(cell[0])) & np.uint64(65535)).astype(int)
        every = np.arange(65536)
        here = np.bincount(v, minlength=65536).astype(float)
        one = sum(here[every ^ (1 << b)] for b in range(16))
        counts.append(np.stack([here, one, (sum(one[every ^ (1 << b)] for b in range(16)) - 16 * here) / 2]))
    choice = simhash.chosen(t, layout, counts, len(t))
    digits = choice[:, None] // 4 ** np.arange(4) % 4
    assert (digits.sum(axis=1) == 3).all() and (digits[:1500, 0] == 0).all()
    for i in rng.integers(0, 3000, 200):
        x = t[i] ^ np.uint64((1 << int(rng.integers(64))) | (1 << int(rng.integers(64))))
        bits = [int(((int(t[i]) ^ int(x)) >> s & 0xFFFF).bit_count()) for s in layout.shifts]
        assert any(b < d for b, d in zip(bits, digits[i], strict=True))
    assert sorted(simhash.part_widths(10)) == [16] * 4 and simhash.part_widths(2**20) == [22, 21, 21] and simhash.part_widths(2**40) == [32, 32]


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text.upper()), (None, text), (None, "nothing else has this"), (9, None), (7, ""), (8, " \t"), (2, "short"), (2, "other words of the same id"), (2, "short"), (11, "x y " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("fp", "t", "least", "component", "choice", "part", "value", "of")})
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_copies(df.repartition(3)).collect()), key=str)
    fp = plain_fingerprint
    want = [(5, fp(text), 3), (3, fp(text), 3), (None, fp(text), 3), (None, fp("nothing else has this"), None), (9, 0, 7), (7, 0, 7), (8, 0, 7), (2, fp("short"), 2), (2, fp("other words of the same id"), 2), (2, fp("short"), 2), (11, fp("x y " * 300), 11)]
    assert [x for x in got if x[0] != 11] == sorted((x for x in want if x[0] != 11), key=str) and len(got) == len(want)
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_query_by_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {i: (f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, plain_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op13_simhash"](spark, DATA).collect()} == want
    assert len({c for _, c in want.values()}) < len(want)
