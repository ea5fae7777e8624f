"""The queries against their SQL, or against a brute-force version, over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from millrace.llm import lines, media, pii, queries, scoring, toxicity

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations", "embeddings")


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_lines_by_brute_force(spark):
    docs = sorted(documents(spark).items())
    got = {r.doc_id: r for r in queries.QUERIES["op3_lines"](spark, DATA).collect()}
    norm = lambda x: lower(x).strip(" \t\n\r\x0b\x0c")
    places: dict[str, list] = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if norm(x):
                places.setdefault(norm(x), []).append((i, k))
    bodies = list(places)
    sets, parent = [lines.shingles(x) for x in bodies], list(range(len(bodies)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 80 * len(a) <= 100 * len(b) and 80 * len(b) <= 100 * len(a):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    first: dict[int, tuple] = {}
    for k, x in enumerate(bodies):
        first[find(k)] = min([*places[x], *([first[find(k)]] if find(k) in first else [])])
    number = {x: k for k, x in enumerate(bodies)}
    for i, t in docs:
        kept = [x for k, x in enumerate(t.split("\n")) if not norm(x) or first[find(number[norm(x)])] == (i, k)]
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert (got[i].n_lines, got[i].n_removed) == (len(t.split("\n")), len(t.split("\n")) - len(kept))


def test_media_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op4_media"](spark, DATA).collect()}
    docs = documents(spark)
    assert set(got) == set(docs)
    for i, t in docs.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r, stored = got[i], media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-16:]), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert media.decode(stored).tobytes() == payload


def test_toxicity_on_labels(spark):
    data = "/root/testdata/sf0.01"
    got = {r.doc_id: r.toxic for r in queries.QUERIES["op5_toxicity"](spark, data).collect()}
    labels = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    assert sum(p and y for p, y in labels) >= 0.9 * sum(y for _, y in labels)
    assert sum(p and not y for p, y in labels) <= 0.01 * len(labels)


def test_toxicity_on_held_out_labels(spark):
    """Fitted on two thirds of the labels, judged on the rest."""
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    assert [name for name, _ in chain] == list(toxicity.CHAIN)
    held = toxicity.score(docs.where("doc_id % 3 = 0"), chain).join(labels, "doc_id").select("p_toxic", "toxic").where("toxic is not null").collect()
    bad = [r.p_toxic >= toxicity.threshold(chain) for r in held if r.toxic]
    good = [r.p_toxic >= toxicity.threshold(chain) for r in held if not r.toxic]
    assert len(bad) > 20 and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.01 * len(good)


def test_pii_by_brute_force(spark):
    """The base kinds by their plain patterns over whole texts."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    docs = documents(spark) | {-1: "a@b.c x1.2.3.256 1.2.3.4.5 4111 1111 1111 1111 +1 (555) 123-4567 +12345 é@é.com a..b@c.d"}
    found = 0
    for i, t in docs.items():
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if good(k, m[0])]
        found += len(spans)
        assert [x[:3] for x in pii.find(t) if x[0] in kinds] == spans, i
    assert found > 20
    got = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, DATA).collect()}
    for i, t in documents(spark).items():
        of = [f"{k}:{s}:{e}" for k, s, e, _ in pii.find(t)]
        assert got[i].spans == ",".join(of) and got[i].base_sha256 == hashlib.sha256(",".join(x for x in of if x.split(":")[0] in kinds).encode()).hexdigest()


def test_pii_checks_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [x[0] for x in pii.find("my iban is GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert [x[0] for x in pii.find("social security 123-45-6789")] == ["ssn"] and not pii.find("part 123-45-6789") and not pii.find(None)


def test_decontamination_against_verbatim_copies(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_decontamination"](spark, DATA).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    for i, t in documents(spark).items():
        held = {k for k, x in items.items() if x in t}
        assert held <= set(got[i].item_ids or [])
    assert 0 < sum(r.contaminated for r in got.values()) < 0.2 * len(got)


def naive_ctw(train: list[bytes], test: bytes, depth: int) -> float:
    """The log10 probability of a text's bytes and end, by the definition: counts in dictionaries, recursion over contexts."""
    counts: Counter = Counter()

    def steps(text):
        padded = bytes(depth) + text + b"\0"
        for p in range(depth, len(padded)):
            for bit in range(8):
                byte = padded[p]
                yield padded[p - depth : p], bin(256 | byte)[3 : 3 + bit], byte >> 7 - bit & 1

    for text in train:
        for context, before, bit in steps(text):
            for d in range(depth + 1):
                counts[context[depth - d :], before, bit] += 1
    contexts: dict = {}
    for context, before, _ in counts:
        if len(context):
            contexts.setdefault((context[1:], before), set()).add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    cache: dict = {}

    def weighted(context, before):
        if (context, before) not in cache:
            own = kt(counts[context, before, 0], counts[context, before, 1])
            if len(context) < depth:
                below = sum(weighted(c, before)[0] for c in contexts.get((context, before), ()))
                high = max(own, below)
                total = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
                cache[context, before] = total, math.exp(own - math.log(2) - total)
            else:
                cache[context, before] = own, 1.0
        return cache[context, before]

    out = 0.0
    for context, before, bit in steps(test):
        p, left = 0.0, 1.0
        for d in range(depth + 1):
            c = context[depth - d :]
            w = weighted(c, before)[1]
            p += left * w * (counts[c, before, bit] + 0.5) / (counts[c, before, 0] + counts[c, before, 1] + 1)
            left *= 1 - w
        out += math.log10(p)
    return out


def test_scoring_by_brute_force(spark):
    texts = {i: t for i, t in enumerate(["the cat sat", "The cat sat on the mat", "", None, "a cat, é mat", "zzz", "sat the cat", "on on on on the the", "mat\n\tcat " * 20, "x", "cats"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in scoring.scores(df, depth=3).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    assert any(held.values())
    tokens = {i: [*lower(t or "").encode().split(), None] for i, t in texts.items()}
    c = Counter(x for i in texts if not held[i] for x in tokens[i])
    n, v = sum(c.values()), len(c)
    train = [lower(t or "").encode() for i, t in texts.items() if not held[i]]
    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[x] > 0 for x in tokens[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[i]), rel_tol=1e-9)
        assert math.isclose(r.score, naive_ctw(train, lower(t or "").encode(), 3), rel_tol=1e-9)


def test_scores_beat_unigrams(spark):
    rows = queries.QUERIES["op9_scoring"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)
    assert all(0 < r.bits_per_byte < 16 for r in rows)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r.doc_id for r in queries.QUERIES["op5_toxicity"](spark, DATA).where("toxic").collect()}
    kept = corpus_pipeline.toxicity_stage(spark, docs, DATA)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(documents(spark)) - toxic
    out = corpus_pipeline.run(spark, DATA).collect()
    leaks = {r.doc_id for r in queries.QUERIES["op8_decontamination"](spark, DATA).where("contaminated").collect()}
    ids = {r.doc_id for r in out}
    assert ids and not ids & (toxic | leaks) and all(0 <= r.shard < 16 for r in out)
    parts = {r.doc_id: r.component_id for r in queries.QUERIES["op2_jaccard"](spark, DATA).collect()}
    texts = Counter(parts[i] for i in ids)
    assert max(Counter(r.doc_id for r in out).values()) <= 3 and sum(n > 1 for n in texts.values()) <= 1
