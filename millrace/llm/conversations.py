"""Repair of damaged conversations by a forward Viterbi search over the grammar (s?(ua)+)? of role initials.

A row may be kept (K, cost 0), given the role that the grammar wants (R, 3) or deleted (D, 4; blank and duplicate rows must be), and an empty user or
assistant row may be inserted anywhere (I, 3); a truncated row that stays costs 3 more. After each row the search holds, for each of four states (nothing
yet, after system, after user, after assistant), the least (cost, audit string). Each layer is closed by inserts; two in a row reach all they can.

Edits and states follow from an audit string, so that of two strings of one layer, state and cost neither starts with the other, and what
is least stays least. The search moves no texts: only initials, faults and hashes. A second pass applies the audits to the texts. Rows of a conversation stream through a
task in Spark's (external) sort order; what a task holds is a batch of rows and the audit string, which is a value of the result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The white space that makes no text.
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
MESSAGES = "conv_id long, place long, edit string, role string, text string"
#: Bytes of text after which messages are handed on.
FLUSH = 4 << 20

Layer = list[tuple[int, str] | None]


def following(state: int) -> tuple[int, str]:
    """The state and role that the grammar wants next, system aside."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a row, None if the grammar forbids it."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    after, role = following(state)
    return after if initial == role[0] else None


def closed(layer: Layer) -> Layer:
    """layer with up to two inserts behind each state."""
    for _ in range(2):
        for state in range(4):
            if layer[state]:
                cost, audit = layer[state]
                after, best = following(state)[0], (cost + INSERT, audit + "I")
                if layer[after] is None or best < layer[after]:
                    layer[after] = best
    return layer


def advanced(layer: Layer, initial: str, must_go: bool, cut: bool) -> Layer:
    """The closed layer after one more row."""
    new: Layer = [None] * 4

    def offer(state: int | None, cost: int, audit: str) -> None:
        if state is not None and (new[state] is None or (cost, audit) < new[state]):
            new[state] = (cost, audit)

    for state, best in enumerate(layer):
        if best:
            cost, audit = best
            offer(state, cost + DELETE, audit + "D")
            if not must_go:
                offer(kept_state(state, initial), cost + KEEP + CUT * cut, audit + "K")
                offer(following(state)[0], cost + REROLE + CUT * cut, audit + "R")
    return closed(new)


def pruned(layer: Layer) -> Layer:
    """layer without states that can't win any more, so that the audits come to share a beginning.

    From `assistant`, what may follow another state costs at most 4 more (a system row that can't stay), from `user` one insert more.
    """
    near = min(cost + more for state, more in ((ASSISTANT, 0), (USER, INSERT)) if layer[state] for cost in [layer[state][0]])
    for state, slack in ((NOTHING, DELETE), (SYSTEM, 0)):
        if layer[state] and layer[state][0] > near + slack:
            layer[state] = None
    return layer


class Search:
    """The search over one conversation's rows, in order, and the counts of its faults."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.done, self.layer = conv, [], closed([(0, ""), None, None, None])
        self.count = dict.fromkeys(FAULTS, 0)
        self.illegal, self.last, self.initial = 0, None, None
        self.first = self.turn = None
        self.turns = 0

    def take(self, turn: int | None, initial: str, blank: bool, seen: bool, cut: bool, key: tuple) -> None:
        seen = seen or key == self.last
        fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
        if fault:
            self.count[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.last, self.initial = key, initial
        self.layer = pruned(advanced(self.layer, initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if max(len(x[1]) for x in self.layer if x) > 512:
            shared = len(os.path.commonprefix([x[1] for x in self.layer if x]))
            self.done.append(next(x[1][:shared] for x in self.layer if x))
            self.layer = [x and (x[0], x[1][shared:]) for x in self.layer]

    def row(self) -> tuple:
        cost, audit = min(x for x in (self.layer[NOTHING], self.layer[ASSISTANT]) if x)
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *(self.count[f] for f in FAULTS), self.illegal, cost, "".join([*self.done, audit])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")), ("audit", pa.string())])
    at, rows = None, []

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "seen", "cut", "h1", "h2")]
        for conv, turn, initial, blank, seen, cut, h1, h2 in zip(*columns, strict=True):
            if at is None or conv != at.conv:
                if at is not None:
                    rows.append(at.row())
                at = Search(conv)
            at.take(turn, initial, blank, seen, cut, (turn, h1, h2))
        if rows:
            yield given()
    if at is not None:
        rows.append(at.row())
        yield given()


def _clean(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2), nulls as one space; h1 and h2 are 128 bits of hash of role and text."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Each conversation in one partition, by turn (nulls first), then by role and hash."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "h1", "h2")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows(conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit.

    A null role or text is one space; rows without conv_id are one conversation; null turns come first; rows of one turn stand by role, then by a hash of
    role and text, rows alike in both next to each other (all but the first are duplicates). Texts of any length count whole, and aren't moved.
    """
    rows = _clean(rows)
    solid = F.rtrim("text", F.lit(BLANKS))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    light = rows.select("conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), "h1", "h2", (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))
    again = light.groupBy("conv_id", "h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("end")).where("first < end")
    again = again.select(F.col("conv_id").alias("of"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    # What stands in several turns: usually so little that Spark broadcasts it, by its measured size.
    light = light.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    light = light.withColumn("seen", F.coalesce(F.col("first") < order, F.lit(False))).drop("of", "k1", "k2", "first")
    return _in_order(light).mapInArrow(_search, REPORT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages that audits (rows with edits) make of the rows behind them."""
    conv, audit, at, state, place, held, out = None, "", 0, NOTHING, 0, 0, []

    def say(edit: str, role: str, text: str) -> None:
        nonlocal place, held
        out.append((conv, place, edit, role, text))
        place, held = place + 1, held + len(text) + 50

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, role = following(state)
            say("I", role, "")
            at += 1

    def given() -> pa.RecordBatch:
        nonlocal held
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in MESSAGES.split(", ")])
        out.clear()
        held = 0
        return made

    for b in batches:
        columns = [b.column(c) for c in ("conv_id", "edits", "role", "text")]
        for i in range(len(b)):
            of, edits, role, text = (c[i].as_py() for c in columns)
            if edits is not None:
                inserts()  # those at the end of the conversation before
                conv, audit, at, state, place = of, edits, 0, NOTHING, 0
            else:
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = kept_state(state, role[:1])
                    say(edit, role, text)
                elif edit == "R":
                    state, wanted = following(state)
                    say(edit, wanted, text)
            if held > FLUSH:
                yield given()
    inserts()
    if out:
        yield given()


def messages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations of rows, found being audits(rows).

    Each conversation's messages lie in one partition, in order. Conversations of which nothing is left have none.
    """
    light = found.select("conv_id", F.col("audit").alias("edits"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("h1", "long"), ("h2", "long"))))
    both = _clean(rows).withColumn("edits", F.lit(None).cast("string")).unionByName(light).withColumn("isrow", F.col("edits").isNull())
    return _in_order(both, "isrow").select("conv_id", "edits", "role", "text").mapInArrow(_apply, MESSAGES)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, total, out = None, None, []
    for b in batches:
        for of, place, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if total:
                    out.append((conv, total.hexdigest()))
                conv, total = of, hashlib.sha256()
            total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([x[0] for x in out], pa.int64()), "sha256": [x[1] for x in out]})
            out = []
    if total:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "sha256": [total.hexdigest()]})


def digests(said: DataFrame) -> DataFrame:
    """(conv_id, sha256) of messages(): SHA-256 of each conversation's `role:text` lines, joined by newlines, taken as they stream by."""
    return said.mapInArrow(_hash, "conv_id long, sha256 string")


def crc_key() -> Column:
    return F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults by crc32 of `conv_id:turn` modulo 20: 0 dropped, 1 without text, 2 without [.!?], 3 twice, 4 as the user's."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = rows.select("conv_id", "turn", *(v.alias(c) for c, v in filled.items()), crc_key().alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per original conv_id: its faults after damage, the cheapest repair and the hash of what that gives."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    bad = damaged(rows)
    found = stored(audits(bad), "conversation-audits")
    hashes = digests(messages(bad, found)).withColumnRenamed("conv_id", "said")
    every = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(hashes, F.col("id").eqNullSafe(F.col("said")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _oracle() -> str:
    """A state is `cost (8 digits) audit NUL repaired`, so that the least string is the best; null is unreachable."""
    old = "e s u a".split()

    def more(state: str, cost: str, edit: str, line: str | None) -> str:
        said = f"split_part({state}, chr(0), 2)"
        tail = said if line is None else f"{said} || CASE WHEN {said} = '' THEN '' ELSE chr(10) END || {line}"
        return f"(lpad(CAST(CAST(left({state}, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr(split_part({state}, chr(0), 1), 9) || '{edit}' || chr(0) || {tail})"

    drop = {x: more(f"p.{x}", str(DELETE), "D", None) for x in old}
    stay = lambda x, role, initial: [
        f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {more(f'p.{x}', f'{CUT} * cut', 'K', 'role || chr(58) || text')} END",
        *([f"CASE WHEN NOT gone THEN {more(f'p.{x}', f'{REROLE} + {CUT} * cut', 'R', f"'{role}:' || text")} END"] if role else []),
    ]
    step = {
        "e": drop["e"], "s": _least(drop["s"], *stay("e", None, "s")), "u": _least(drop["u"], *(y for x in "esa" for y in stay(x, "user", "u"))),
        "a": _least(drop["a"], *stay("u", "assistant", "a")),
    }
    close = f"""SELECT conv_id, pos, e, s, u2 AS u, {_least('a1', more('u2', str(INSERT), 'I', "'assistant:'"))} AS a FROM (
      SELECT *, {_least('u1', more('e', str(INSERT), 'I', "'user:'"), more('s', str(INSERT), 'I', "'user:'"), more('a1', str(INSERT), 'I', "'user:'"))} AS u2 FROM (
        SELECT p.conv_id, p.pos + 1 AS pos, {step['e']} AS e, {step['s']} AS s, {step['u']} AS u1, {step['a']} AS a1
        FROM path p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1) one) two"""
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) g(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS k FROM conversations, crc),
bad AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS solid FROM bad),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM placed),
faulty AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT regexp_matches(right(solid, 1), '[.!?]') THEN 'truncated' END AS fault FROM again),
judged AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CAST(coalesce(fault = 'truncated', false) AS INT) AS cut,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM faulty),
path(conv_id, pos, e, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '00000000' || chr(0), CAST(NULL AS VARCHAR), '00000003I' || chr(0) || 'user:', '00000006II' || chr(0) || 'user:' || chr(10) || 'assistant:' FROM judged
  UNION ALL {close}),
ends AS (SELECT conv_id, {_least('arg_max(e, pos)', 'arg_max(a, pos)')} AS best FROM path GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(best, 8), '0') AS BIGINT) AS cost,
  coalesce(substr(split_part(best, chr(0), 1), 9), '') AS audit, sha256(coalesce(split_part(best, chr(0), 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE = _oracle()
