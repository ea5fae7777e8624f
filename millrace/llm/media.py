"""Media columns: interleaved documents as ordered structs of text and media references.

parts() parses HTML into one row per part, in reading order; a media part names its payload by digest and
carries its caption. A store keeps payloads under their SHA-256, each once a writing task, as lossless 8-bit greyscale PNGs of
192 samples a row. features() reads the stored bytes back, one row a digest; resolve() joins parts and features by digest, and
sequences() puts a page's parts back in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table

ROW = 192
PNG = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
SILENT = {"script", "style", "template", "noscript", "head"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "figure", "nav", "blockquote"}


class _Parts(HTMLParser):
    """Collects [kind, text, reference, caption] in reading order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.silent, self.caption, self.figures = 0, None, []

    def flush(self) -> None:
        if joined := " ".join("".join(self.text).split()):
            self.parts.append(["text", joined, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.parts))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS and not self.silent:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.parts.append(["media", None, a["src"], a.get("alt") or None])

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for part in self.parts[self.figures[-1] if self.figures else 0 :]:
                if part[0] == "media" and said:
                    part[3] = said
            self.caption = None
        elif tag in BREAKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[list]:
    p = _Parts()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.parts


def parts(pages: DataFrame) -> DataFrame:
    """One row per part of pages(page_id, html): page_id, position, kind, text, digest, url, caption.

    digest is set where the source is sha256:<hex>, url elsewhere. Null and empty pages have no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "url", "caption"))])
        for b in batches:
            rows = []
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html"), strict=True):
                for k, (kind, text, ref, caption) in enumerate(parse(html.as_py())):
                    own = ref is not None and ref.startswith("sha256:")
                    rows.append((page, k, kind, text, ref[7:] if own else None, None if own else ref, caption))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, position int, kind string, text string, digest string, url string, caption string")


def encode(payload: bytes) -> bytes:
    """payload (a positive multiple of ROW bytes) as a PNG, each byte one sample."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = samples
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without filters, one line a row; checks every chunk's CRC."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", data[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(data)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def padded(text: Column) -> Column:
    """The text's UTF-8 bytes with blanks up to a positive multiple of ROW; null is empty."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    full = F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW)
    return F.concat(raw, F.repeat(F.lit(" "), (full - size).cast("int")).cast("binary"))


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media): the payloads of payloads(payload), encoded straight into the shared folder, without a shuffle.

    A task writes a digest once (copies that lie further apart than 100,000 payloads again); tasks that meet the same payload
    each write it, with the same bytes. features() keeps one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, media = [], []
            for x in b.column("payload"):
                payload = x.as_py()
                d = hashlib.sha256(payload)
                if d.digest() not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(d.digest())
                    digests.append(d.hexdigest()), media.append(encode(payload))
                if sum(map(len, media)) > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], ["digest", "media"])
                    digests, media = [], []
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return stored(payloads.select("payload").mapInArrow(run, "digest string, media binary"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """One row per row of media(digest, media), made from the stored bytes alone.

    feature: height x width, mean and deviation of the samples, and their mean change along lines and down columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in batches:
            rows = []
            for digest, m in zip(b.column("digest").to_pylist(), b.column("media"), strict=True):
                raw = m.as_py()
                samples = decode(raw)
                payload = samples.tobytes()
                x = samples.astype(np.int64)
                across, down = np.abs(np.diff(x, axis=1)).sum(), np.abs(np.diff(x, axis=0)).sum()
                n = x.size
                mean = int(x.sum()) / n
                spread = max(0.0, int((x * x).sum()) / n - mean * mean) ** 0.5
                feature = f"{len(x)}x{x.shape[1]};mean={mean:.4f};std={spread:.4f};dx={across / n:.4f};dy={down / n:.4f}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def features(media: DataFrame) -> DataFrame:
    """read_back() of media(digest, media), one row a digest: copies of a payload have the same stored bytes, so any of their rows will do."""
    return read_back(media).dropDuplicates(["digest"])


def resolve(found: DataFrame, media: DataFrame) -> DataFrame:
    """parts with the columns of media (one row a digest) beside them; parts without a payload keep nulls.

    Only references and what media holds meet in the join. A digest that many pages use makes a large partition of
    small rows, which adaptive execution splits.
    """
    return found.join(media, "digest", "left")


def sequences(resolved: DataFrame) -> DataFrame:
    """(page_id, parts): a page's parts as an array of structs in reading order, with captions in place."""
    rest = [c for c in resolved.columns if c not in ("page_id", "position")]
    return resolved.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("parts"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page with one figure, whose payload is its text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    payload = padded(F.col("text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    html = F.concat(F.lit('<article><figure><img alt="text" src="sha256:'), F.sha2(payload, 256), F.lit('"><figcaption>'), size.cast("string"), F.lit("</figcaption></figure></article>"))
    found = parts(docs.select(F.col("doc_id").alias("page_id"), html.alias("html")))
    done = resolve(found.where("kind = 'media'"), features(store(docs.select(payload.alias("payload")))))
    return done.select(
        F.col("page_id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256",
        "tail_crc32", "media_bytes", "media_sha256", "feature",
    )
