"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs, text or media reference, each with its position; a reference has the
digest of its payload, its caption (of its figure, else its alternative text) and its stated size. Payloads are kept apart,
in a store keyed by the SHA-256 of their stored form; references are joined to it by digest and keep position and caption.

`op5_media` makes a page for each document whose only figure is the document's text, as bytes in the samples of an 8-bit
greyscale PNG of 64 columns, writes pages and store, parses the pages, reads the payloads back from the store, and joins
them to the references. What is read from a payload (its digest, checksum, features) is computed where the store is
scanned, once for each digest, so no payload is shuffled; the join carries only those columns.

Defined cases: a null text is empty and has a payload of 64 zero bytes; equal texts share a payload and all values;
a reference without a payload in the store keeps its row, with nulls; a null page has no items; repeated rows each give rows;
an empty table gives no rows; extra columns may have any name, as they travel in structs; a text is held whole by its task with
three copies of its bytes at most. A head that is not closed ends at the first element that can't stand in it; a caption before its media counts for them.
"""

from __future__ import annotations

import hashlib
import html as markup
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import shared
from tributary.llm.textcore import as_bytes

WIDTH = 64
LEVEL = 1
SCHEME = "sha256:"


def png(samples: bytes) -> bytes:
    """8-bit greyscale samples, WIDTH to a row, as a PNG."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    held = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row has a filter byte, 0
    held[:, 1:] = rows
    out = [b"\x89PNG\r\n\x1a\n"]
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(held.tobytes(), LEVEL)), (b"IEND", b"")):
        out.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return b"".join(out)


def samples(stored: bytes) -> np.ndarray:
    """The rows of samples of a PNG that `png` made; checks it."""
    if stored[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of a PNG is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a PNG with row filters")
    return rows[:, 1:]


def payload(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def feature(rows: np.ndarray) -> str:
    """Size, mean and deviation of the samples, and a hash of which of 8 x 8 blocks are above the mean."""
    bands = np.minimum(np.arange(8) * len(rows) // 8, len(rows) - 1)
    sums = np.add.reduceat(np.add.reduceat(rows, np.arange(0, WIDTH, 8), axis=1, dtype=np.int64), bands, axis=0)
    high = np.maximum(np.diff(np.append(bands, len(rows))), 1)[:, None] * 8
    mean = float(rows.mean(dtype=np.float64))
    bits = np.packbits((sums / high > mean).ravel()).tobytes().hex()
    return f"{WIDTH}x{len(rows)};mean={mean:.4f};std={float(rows.std(dtype=np.float64)):.4f};blocks={bits}"


ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("src", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("n_bytes", T.LongType())])
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())])
# Elements whose content is no text, elements that end a run of text, and elements that refer to media.
_SILENT = {"script", "style", "template", "noscript", "head"}
_BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
_BODY = _BLOCK | {"body", "a", "b", "em", "i", "span", "strong", "img", "video", "audio", "embed"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.head = False
        self.figure: list[int] = []  # the media of the figure that is open
        self.named: str | None = None  # and its caption, once read
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.run).split()):
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "src": None, "digest": None, "caption": None, "n_bytes": None})
        self.run = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.head and tag in _BODY:
            self.head = False
            self.silent = 0
        if tag == "head":
            self.head = True
        elif tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.figure, self.named = [], None
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and not self.silent and not self.head and (src := (held := dict(attrs)).get("src")):
            self.flush()
            n = held.get("data-bytes") or ""
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "src": src, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest(), "caption": held.get("alt") if self.named is None else self.named, "n_bytes": int(n) if n.isascii() and n.isdigit() else None})
            self.figure.append(len(self.items) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        elif tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            self.named = " ".join("".join(self.caption).split())
            for k in self.figure:
                self.items[k]["caption"] = self.named
            self.caption = None
        elif tag == "figure":
            self.figure, self.named = [], None
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.silent or self.head:
            return
        (self.run if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The ordered items of a page."""
    reader = _Sequence()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.items


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, items): the input's row as a struct, and its ordered text and media references."""
    shared.tune(pages.sparkSession)
    frame = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            found = [parse(x) for x in row.field(row.type.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.list_(_ITEM))], names=["row", "items"])

    return frame.mapInArrow(run, T.StructType([frame.schema["row"], T.StructField("items", T.ArrayType(ITEM))]))


def resolve(found: DataFrame, store: DataFrame) -> DataFrame:
    """(row, position, caption, n_bytes, ref_digest, stored): one row for each media reference; stored has the store's columns.

    store has one row for each digest. A hot digest is one that many references share: the join is an ordinary
    shuffled one, which adaptive execution splits by references.
    """
    refs = found.select("row", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    refs = refs.select("row", "item.position", "item.caption", "item.n_bytes", F.col("item.digest").alias("ref_digest"))
    held = store.select(F.col("digest").alias("_of"), F.struct(*[F.col(f"`{c}`") for c in store.columns]).alias("stored"))
    return refs.join(held, F.col("ref_digest") == F.col("_of"), "left").drop("_of")


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, html, digest, media): a page for each document and the payload it refers to; a payload that the same task
    has just written for an equal text is null."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            names, out, seen = batch.column(0).to_pylist(), [], set()
            for name, low, high in zip(names, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media = png(payload(data[low:high].tobytes()))
                digest = hashlib.sha256(media).hexdigest()
                page = f'<!DOCTYPE html><html><body><article><p>Document {markup.escape(str(name))}</p><figure><img src="{SCHEME}{digest}" data-bytes="{high - low}" alt=""><figcaption>{high - low} bytes, {digest[:12]}</figcaption></figure><p>End</p></article></body></html>'
                out.append((page, digest, None if digest in seen else media))
                seen.add(digest)
            pages, digests, stored = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(stored, pa.binary())], names=["doc_id", "html", "digest", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, html string, digest string, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): one row for each digest,
    all of it from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                rows = samples(media)
                held = rows.tobytes()
                out.append((digest, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(rows)))
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = stored.select("digest", "media").where("media IS NOT NULL").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("digest").agg(*[F.max(x).alias(x) for x in names])


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "media")
    figures(shared.table(spark, sf_dir, "documents")).write.parquet(folder)
    files = spark.read.parquet(folder)
    store = shared.cut(read_back(files))
    pages = sequences(files.select("doc_id", "html")).select(F.struct("row.doc_id").alias("row"), "items")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return resolve(pages, store).select("row.doc_id", "n_bytes", *[f"stored.{x}" for x in names], "position", "caption")
