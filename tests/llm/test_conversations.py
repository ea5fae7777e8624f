"""Conversation repair against a search through all edit strings, and on odd rows."""

import hashlib
import random
from collections import Counter
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversations as c

TYPES = "conv_id long, turn long, role string, text string"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def faults(rows):
    """The first fault of each row of one conversation, in order."""
    out = []
    for k, (_, role, text) in enumerate(rows):
        solid = text.strip(c.BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in [r[1:] for r in rows[:k]] else "truncated" if solid[-1] not in ".!?" else None)
    return out


def replay(rows, wrong, audit):
    """(cost, lines) of an edit string, None if it isn't one for rows or gives what the grammar forbids."""
    at, cost, said, lines = 0, 0, "", []
    for edit in audit:
        wanted = "a" if said.endswith("u") else "u"
        name = {"a": "assistant", "u": "user"}[wanted]
        if edit == "I":
            cost, said, lines = cost + 3, said + wanted, [*lines, name + ":"]
            continue
        (_, role, text), fault, at = rows[at], wrong[at], at + 1
        if edit == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 3 * (fault == "truncated")
        if edit == "K":
            first = role[:1]
            if first != wanted and not (first == "s" and not said):
                return None
            said, lines = said + first, [*lines, f"{role}:{text}"]
        else:
            cost, said, lines = cost + 3, said + wanted, [*lines, f"{name}:{text}"]
    return (cost, lines) if said != "s" and said[-1:] in ("", "a") else None


def brute(rows):
    wrong, best = faults(rows), None
    for edits in product("KRD", repeat=len(rows)):
        for inserts in product(("", "I", "II"), repeat=len(rows) + 1):
            audit = inserts[0] + "".join(e + i for e, i in zip(edits, inserts[1:], strict=True))
            if (got := replay(rows, wrong, audit)) and (best is None or (got[0], audit) < best[:2]):
                best = (got[0], audit, got[1])
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    count = Counter(wrong)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), *best[:2], "\n".join(best[2]),
    )


def results(df):
    found = c.audits(df)
    said = {}
    for m in sorted(c.messages(df, found).collect(), key=lambda m: m.place):
        said.setdefault(m.conv_id, []).append(f"{m.role}:{m.text}")
    hashes = {r.conv_id: r.sha256 for r in c.digests(c.messages(df, found)).collect()}
    assert hashes == {k: hashlib.sha256("\n".join(x).encode()).hexdigest() for k, x in said.items()}
    return {r.conv_id: (*(r[x] for x in REPORT), "\n".join(said.get(r.conv_id, []))) for r in found.collect()}


def test_by_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(120):
        own = []
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""])
            own.append((rng.choice([turn, turn, turn + 2]) if rng.random() < 0.9 else None, role, rng.choice(["Yes.", "Yes.", "no", " \n", "é!", f"Text {rng.randint(0, 9)}? \t"])))
        own = list({x[0]: x for x in own}.values())  # one row a turn, whose order is plain
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        want[conv] = brute(own)
        rows += [(conv, *r) for r in own]
    rng.shuffle(rows)
    assert results(spark.createDataFrame(rows, TYPES).repartition(3)) == want
    assert len({w[6] for w in want.values()}) > 30


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (None, 3, "user", "Q?"), (None, 3, "assistant", "A."), (None, 9, "user", "Q?"), (2, 5, "system", "S."),
        (3, 1, "assistant", "x" * 2_000_000 + "."), (3, 0, "user", "."), (4, 0, "user", ""), (4, 1, "user", ""),
    ]
    df = spark.createDataFrame(rows, TYPES).withColumns({x: F.lit("z") for x in ("h1", "h2", "edits", "place", "audit", "seen", "cut", "first", "of")})
    got = results(df.repartition(3))
    assert got[1] == (0, 1, 1, 0, 2, 11, "KDDI", "user:Hi.\nassistant:")
    assert got[None] == (5, 0, 1, 0, 1, 10, "IKKDI", "user:\nassistant:A.\nuser:Q?\nassistant:")  # the assistant's row of turn 3 stands first
    assert got[2] == (0, 0, 0, 0, 0, 4, "D", "") and got[4] == (0, 2, 0, 0, 1, 8, "DD", "")
    assert got[3][:7] == (0, 0, 0, 0, 0, 0, "KK") and len(got[3][7]) == 2_000_018
    assert results(df.limit(0)) == {}


@pytest.mark.parametrize("n", [3000])
def test_long_conversation_like_its_blocks(spark, n):
    """Thousands of turns stay exact: a plain search without pruning or shared beginnings gives the same."""
    rng = random.Random(n)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "", "again."])) for k in range(n)]
    wrong = faults([r[1:] for r in rows])
    layer = c.closed([(0, ""), None, None, None])
    for (_, _, role, _), fault in zip(rows, wrong, strict=True):
        layer = c.advanced(layer, role[0], fault in ("blank", "duplicate"), fault == "truncated")
    want = min(x for x in (layer[0], layer[3]) if x)
    got = results(spark.createDataFrame(rows, TYPES).repartition(3))[1]
    assert got[5:7] == want and replay([r[1:] for r in rows], wrong, got[6]) == (got[5], got[7].split("\n"))


def test_query_on_damage_against_sql(spark, tmp_path):
    """Null ids and turns, conversations that lose all their rows, repeated texts."""
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(200)]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "", "One. Two!", "cut", "Same?"])) for _ in range(700)]
    rows = list({r[:2]: r for r in rows}.values())
    spark.createDataFrame(rows, TYPES).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = c.op12_conversations(spark, str(tmp_path))
    want = con.sql(c.ORACLE)
    assert want.columns == df.columns
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(want.fetchall(), key=str)
    assert got == want and len(got) == len({r[0] for r in rows}) and any(r[-2] == "" for r in got)
