"""Interleaved document sequences: ordered text and media references, resolved by digest.

* parse_html: a page becomes an array of structs in reading order, text segments and media references; a
  figure's caption (or an image's alt text) stays with its reference, positions count from 0 without gaps.
* store_media: payloads become binary greyscale rasters (PGM, one byte a sample, 64 samples a row) in a
  Parquet table in the shared folder, keyed by the payload's SHA-256.
* read_media: opens each stored raster, checks its header and computes features from the bytes that were read.
* resolve: joins references to stored media by digest; a reference without a payload keeps null media columns.

Defined cases: a null page or text counts as empty; an empty payload is one row of zeros; equal payloads share
one entry; references to nothing stay; broken markup is read as far as it goes; other columns are untouched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut, written

WIDTH = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_BLOCKS = frozenset("address article aside blockquote body br caption center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
_HIDDEN = frozenset(("script", "style", "template", "noscript", "head"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            given = dict(attrs)
            if source := given.get("src"):
                self.flush()
                found = re.fullmatch(r"sha256:([0-9a-f]{64})", source.strip().lower())
                self.items.append({"kind": "media", "text": source, "digest": found and found[1], "caption": given.get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.hidden:
            return
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            begun = self.figures[-1] if self.figures else 0
            own = [x for x in self.items[begun:] if x["kind"] == "media"]
            if own and text:
                for x in own:
                    x["caption"] = text
            elif text:
                self.words.append(text)
                self.flush()
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def read_page(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption is not None:
        reader.handle_endtag("figcaption")
    reader.flush()
    return [{"position": i} | x for i, x in enumerate(reader.items)]


def parse_html(html: Column) -> Column:
    """The page's sequence, an array of (position, kind, text, digest, caption)."""

    @F.pandas_udf(SEQUENCE)
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(read_page, na_action=None)

    return parse(html)


def references(docs: DataFrame, sequence: str, keep: list[str]) -> DataFrame:
    """One row for each media reference: the columns of keep, position, digest, caption."""
    media = F.filter(sequence, lambda x: x["kind"] == "media")
    return docs.select(*keep, F.explode(media).alias("_ref")).select(*keep, F.col("_ref.position").alias("position"), F.col("_ref.digest").alias("digest"), F.col("_ref.caption").alias("caption"))


def payload_of(text: Column) -> Column:
    """The text's UTF-8 bytes and zeros up to a positive multiple of the raster's width."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.substring(F.lit(bytes(WIDTH)), F.lit(1), pad.cast("int")))


def store_media(payloads: DataFrame, payload: str = "payload", digest: str = "digest") -> DataFrame:
    """(digest, media): each payload, a multiple of WIDTH bytes, as a stored raster."""
    rows = (F.octet_length(payload) / WIDTH).cast("long").cast("string")
    header = F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")).cast("binary")
    return written(payloads.select(F.col(digest).alias("digest"), F.concat(header, F.col(payload)).alias("media")), "media")


def samples_of(media: bytes) -> np.ndarray:
    """The raster's samples, rows by columns; an error if the bytes are no such raster."""
    found = re.match(rb"P5\n(\d+) (\d+)\n255\n", media)
    if not found or len(media) - found.end() != int(found[1]) * int(found[2]):
        raise ValueError("not a stored raster")
    return np.frombuffer(media, dtype=np.uint8, offset=found.end()).reshape(int(found[2]), int(found[1]))


def features_of(media: bytes) -> tuple:
    samples = samples_of(media)
    payload = samples.tobytes()
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    mean = float((counts * np.arange(256)).sum() / samples.size)
    variance = float((counts * (np.arange(256) - mean) ** 2).sum() / samples.size)
    bands = ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    feature = f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.6f};var={variance:.6f};entropy={-(share * np.log2(share)).sum():.6f};bands={bands}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def read_media(store: DataFrame) -> DataFrame:
    """One row for each distinct digest with what its stored bytes say."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features_of(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*made)) if made else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in _FEATURES.split(", ")])

    return store.select("digest", "media").mapInArrow(run, _FEATURES).distinct()


def resolve(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The references with their media columns. Both sides are plain tables when they meet, so a digest that
    holds a third of all references is split by the adaptive skew join."""
    return refs.join(cut(catalog), "digest", "left")


def sequences(docs: DataFrame, html_col: str, keys: list[str], catalog: DataFrame) -> DataFrame:
    """One row for each page: keys and its whole sequence with payload_bytes and feature beside each reference."""
    parts = docs.select(*keys, F.explode_outer(parse_html(F.col(html_col))).alias("_x")).select(*keys, "_x.*")
    joined = resolve(parts, catalog.select("digest", "payload_bytes", "feature"))
    item = F.struct("position", "kind", "text", "digest", "caption", "payload_bytes", "feature")
    return joined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), item))).alias("sequence"))
