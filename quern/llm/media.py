"""Media columns: interleaved document sequences whose media live in a table by digest.

HTML is parsed into an ordered list of text and media-reference structs; references are resolved by a join on the digest
of the stored bytes, and position and caption stay with each reference. Media are stored as binary greymaps (Netpbm P5, one
8-bit sample a byte, 24 samples a row), which keep the bytes as they are.

A digest that very many documents share is one row of the joined side: what is read from a stored item is reduced to a
few short columns before the join, so copies move no payload.

Defined cases: null html gives an empty sequence; a reference without stored media keeps its position with null
columns; a reference outside a figure has its alt text for a caption; a very long text is one item; equal media are one item; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

SIDE = 24
FRAME = SIDE * SIDE
ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


class _Interleaved(HTMLParser):
    """Blocks of text and media references in page order; a figure's caption goes to the references within it, wherever it stands."""

    BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "blockquote", "pre", "figure", "body", "html"}
    SILENT = {"script", "style", "head", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # figures: of each open figure, its media items and its caption.
        self.items, self.text, self.silent, self.caption, self.figures = [], [], 0, None, []

    def _flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def _end_caption(self):
        if self.caption is not None:
            self.figures[-1][1] = " ".join("".join(self.caption).split())
            self.caption = None

    def _end_figure(self):
        self._end_caption()
        media, caption = self.figures.pop()
        for item in media:
            item["caption"] = caption or item["caption"]

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in ("img", "video", "audio"):
            self._flush()
            got = dict(attrs)
            item = {"pos": len(self.items), "kind": "media", "text": None, "ref": got.get("src"), "caption": got.get("alt")}
            self.items.append(item)
            if self.figures:
                self.figures[-1][0].append(item)
        elif tag == "figcaption" and self.figures:
            self._flush()
            self.caption = []
        elif tag in self.BLOCKS:
            self._flush()
            if tag == "figure":
                self.figures.append([[], None])

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.figures:
            self._end_caption()
        elif tag in self.BLOCKS:
            self._flush()
            if tag == "figure" and self.figures:
                self._end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self):
        """What a cut-off page leaves open ends with it."""
        self._flush()
        while self.figures:
            self._end_figure()


def interleaved(html: str | None) -> list[dict]:
    p = _Interleaved()
    p.feed(html or "")
    p.close()
    p.finish()
    return p.items


def parse(pages: DataFrame) -> DataFrame:
    """pages(doc_id, html) with items: the ordered sequence of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([interleaved(h) for h in b.column(1).to_pylist()], kind)], names=["doc_id", "items"])

    return pages.select("doc_id", "html").mapInArrow(common.tidied(run), f"doc_id long, items {ITEMS}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each item of sequences(doc_id, items), with the columns of media(digest, ...) where it is a stored reference."""
    items = sequences.select("doc_id", F.posexplode_outer("items").alias("at", "item"))
    items = items.select("doc_id", "at", "item.kind", "item.text", F.regexp_extract(F.col("item.ref"), "^media:([0-9a-f]{64})$", 1).alias("ref"), "item.caption")
    return items.join(media, items["ref"] == media["digest"], "left")


def greymap(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def samples(stored: bytes) -> np.ndarray:
    """The 8-bit samples of a greymap, a view of its bytes."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored)
    return np.frombuffer(stored, np.uint8, int(head[1]) * int(head[2]), head.end())


def feature(x: np.ndarray) -> str:
    """An average hash of the mean frame, 8 by 8 cells, with mean and deviation of the samples."""
    mean = x.reshape(-1, SIDE, SIDE).mean(axis=0, dtype=np.float64)
    cells = mean.reshape(8, SIDE // 8, 8, SIDE // 8).mean(axis=(1, 3))
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{bits}-{mean.mean():.3f}-{mean.std():.3f}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, html, digest, media: each text's bytes as a stored greymap, and a page that shows it with a caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                s, pages, digests, stored = b.slice(i, 512), [], [], []
                for text in s.column(1).to_pylist():
                    raw = (text or "").encode()
                    whole = max(FRAME, -(-len(raw) // FRAME) * FRAME)
                    stored.append(greymap(raw + b"\xff" * (whole - len(raw))))
                    digests.append(hashlib.sha256(stored[-1]).hexdigest())
                    caption = escape(f"{len(raw)} bytes")
                    pages.append(f'<article><figure><img src="media:{digests[-1]}" width="{SIDE}" height="{whole // SIDE}"><figcaption>{caption}</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(pages), pa.array(digests), pa.array(stored, pa.binary())], names=["doc_id", "html", "digest", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidied(run), "doc_id long, html string, digest string, media binary")


def describe(media: DataFrame) -> DataFrame:
    """What the stored bytes of media(media) hold, one row a digest; the digest is computed anew from the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
        for b in batches:
            rows = []
            for x in b.column(0):
                raw = x.as_buffer()
                got = samples(raw)
                rows.append((hashlib.sha256(raw).hexdigest(), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(raw), feature(got)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.select("media").mapInArrow(common.tidied(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string").dropDuplicates(["digest"])


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.settle(store_texts(common.documents(spark, sf_dir).select("doc_id", "text")), "op7-media")
    got = resolve(parse(stored.select("doc_id", "html")), describe(stored))
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return got.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature")
