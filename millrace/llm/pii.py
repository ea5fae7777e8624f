"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Kinds and their patterns are those of KINDS; card numbers must pass Luhn, bank accounts mod 97.
Every confirmed span starts at its kind's prior; a context word within WINDOW characters before it adds, a
discouraging one takes away. Base kinds (email, ip, card, phone) stay whatever their score; the kinds
added by the method (iban, ssn) are kept from THRESHOLD on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Of an email address [A-Za-z0-9._%+-]+@DOMAIN.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Within a run of digits all starts match alike, so only its first is tried: long runs take linear time.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: What an address is made of; no match crosses the edge of such a run.
ADDRESS_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
DIGITS_TO_13 = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
#: Context words, lower case: what makes a kind likelier.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "contact"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
}
AGAINST = ("example", "version", "isbn", "order", "invoice", "sample")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BASE_KINDS = ("email", "ip", "card", "phone")
WINDOW, BOOST, PENALTY, THRESHOLD = 40, 0.3, 0.2, 0.5

SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int,score:double>>"
)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    account = account.replace(" ", "")
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses. Every character of a run between two @ can stand before the second, so each @ is looked at once."""
    at = text.find("@")
    while at >= 0:  # only the run of address characters around an @ can hold a match
        low = at
        while low and ADDRESS_RUN.match(text[low - 1]):
            low -= 1
        high = ADDRESS_RUN.match(text, at).end()
        while 0 <= at < high:
            domain = DOMAIN.match(text, at + 1, high) if at > low else None
            if domain:
                yield low, domain.end()
            low = domain.end() if domain else at + 1
            at = text.find("@", low, high)
        at = text.find("@", high)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind as listed, then start."""
    yield from (("email", i, j) for i, j in emails(text))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            yield "ip", m.start(), m.end()
    if DIGITS_TO_13.search(text):
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int) -> float:
    near = re.findall("[a-z]+", text[max(0, start - WINDOW) : start].lower())
    s = PRIOR[kind] + BOOST * any(w.startswith(CONTEXT[kind]) for w in near) - PENALTY * any(w in AGAINST for w in near)
    return round(min(1.0, max(0.0, s)), 6)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of each kept span; code points, end exclusive."""
    text = text or ""
    scored = ((k, s, e, score(text, k, s)) for k, s, e in proposals(text))
    return [x for x in scored if x[0] in BASE_KINDS or x[3] >= THRESHOLD]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            found = find(text.as_py())
            of = [f"{k}:{s}:{e}" for k, s, e, _ in found]
            base = ",".join(x for x, f in zip(of, found, strict=True) if f[0] in BASE_KINDS)
            n = [sum(f[0] == k for f in found) for k in BASE_KINDS]
            rows.append((doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(of), [dict(zip(("kind", "start", "end", "score"), f, strict=True)) for f in found]))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(span)]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text), in one pass without a shuffle: counts, spans, and found (with scores).

    A null text is empty; a null doc_id stays null. Repeated rows give repeated results. A text of any length takes time in proportion to it.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_batches, SCHEMA)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans, with each span's score in the spans' order."""
    found = personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("scores", F.expr("array_join(transform(found, x -> cast(x.score as string)), ',')")).drop("found")
