"""Media columns: interleaved document sequences.

HTML becomes an ordered sequence of structs: texts, and references to media by
digest with their captions. Media are stored once under the digest of their
stored form (8-bit greyscale PNG, 192 samples a row) and are resolved by a join
on the digest, so that positions and captions stay with their references.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, sliced, table

ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_ITEMS = "array<struct<position:int,kind:string,text:string,digest:string>>"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """The data and spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def to_png(payload: bytes) -> bytes:
    """A greyscale PNG with one 8-bit sample for each byte, 192 in a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # each row after its filter type, 0
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of a PNG that ``to_png`` made, by rows."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, data, width, height = len(_SIGNATURE), [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only plain 8-bit greyscale is read")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return raw[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Rows, mean and deviation in thousandths, and a 16-bin histogram in per mille."""
    flat, n = samples.ravel(), samples.size
    total, square = int(flat.sum(dtype=np.int64)), int((flat.astype(np.int64) ** 2).sum())
    bins = np.bincount(flat >> 4, minlength=16) * 1000 // n
    return f"rows={len(samples)} mean={total * 1000 // n} var={(square * n - total * total) * 1000 // (n * n)} hist={','.join(map(str, bins.tolist()))}"


class _Sequence(HTMLParser):
    """Collects texts and media references in document order."""

    skipped, block = {"script", "style"}, {"p", "div", "article", "section", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "nav", "header", "footer", "body", "html", "blockquote", "pre", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.depth_skipped = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.depth_skipped += 1
        if tag in self.block or tag in ("img", "video", "audio"):
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio"):
            a = dict(attrs)
            self.items.append({"kind": tag, "text": a.get("alt"), "digest": a.get("src")})

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self.depth_skipped = max(0, self.depth_skipped - 1)
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :] if self.figure is not None else []:
                if item["kind"] != "text":
                    item["text"] = caption
        elif tag == "figure":
            self.figure = None
        if tag in self.block:
            self.flush()

    def handle_data(self, data):
        if self.depth_skipped:
            return
        (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The page's items in order: position, kind (text, img, video, audio), text (or caption), digest (or src)."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def _slices(batch, column: int, size: int):
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for a, b in sliced([range(n or 0) for n in lengths], size):
        yield batch.slice(a, b - a)


def parse_interleaved(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keys`` and ``items``: each page's ordered texts and media references.

    Null or empty HTML gives an empty sequence, broken HTML what the parser makes of
    it. Every row stands alone; other columns are passed over.
    """
    own = pages.select(F.col(html).cast("string").alias("__html"), *keys)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 0, 8 << 20):
                items = [sequence_of(h) for h in part.column(0).to_pylist()]
                kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, part.num_columns)), pa.array(items, kind)], names=[*part.schema.names[1:], "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return in_arrow(own, run, f"{fields}, items {_ITEMS}")


def _store(batches):
    for batch in batches:
        for part in _slices(batch, 0, 4 << 20):
            html, digests, media = [], [], []
            for text in part.column(0).to_pylist():
                data = (text or "").encode("utf-8", "replace")
                png = to_png(pad(data))
                digests.append(hashlib.sha256(png).hexdigest())
                media.append(png)
                html.append(f'<article><figure><img src="{digests[-1]}"><figcaption>{len(data)}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, part.num_columns)), pa.array(html), pa.array(digests), pa.array(media, pa.binary())], names=[*part.schema.names[1:], "html", "digest", "media"])


def store_texts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write every whole text (null: empty) as a PNG: ``keys``, an interleaved page (``html``)
    that refers to it with its length as caption, and the store's ``digest`` and ``media``.

    The table lies in the shared folder; equal texts have equal media and digests.
    """
    own = docs.select(F.col(text).cast("string").alias("__text"), *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return materialize(in_arrow(own, _store, f"{fields}, html string, digest string, media binary"), "media")


def _read(batches):
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    for batch in batches:
        for part in _slices(batch, 1, 4 << 20):
            rows = []
            for digest, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)


def media_features(media: DataFrame) -> DataFrame:
    """One row per digest: what reading the stored bytes back gives. Copies of a medium are read where they lie, only their results meet."""
    read = in_arrow(media.select("digest", "media").filter("media is not null"), _read, _FEATURES)
    names = [f.split()[0] for f in _FEATURES.split(", ")][1:]
    return read.groupBy("digest").agg(F.first(F.struct(*names)).alias("f")).select("digest", "f.*")


def resolve(sequences: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Join each sequence's items with ``resolved`` (one row per digest) on the digest:
    ``keys``, position, kind, text, digest and the resolved columns, null for texts and unknown digests."""
    items = sequences.select(*keys, F.inline("items"))
    return items.join(resolved, "digest", "left")


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Store every document's text as a medium, resolve it by digest, read it back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = store_texts(docs)
    pages = parse_interleaved(store, keys=("doc_id",))
    full = resolve(pages, media_features(store))
    return full.select("doc_id", F.col("text").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
