"""Interleaved document sequences: ordered text and media references whose payloads are joined by digest.

HTML is parsed into an array of (position, kind, text, digest, caption) in page order. Media are stored once per digest and partition as
8-bit greyscale PNG, losslessly; what a reader needs of them is computed from the stored bytes and joined to the
references by digest, so payloads themselves do not move.

Defined results: a null text or page is empty; a reference whose digest is not stored keeps its position and caption
with null payload columns; equal payloads share one digest and so all values; an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored
from .markup import INLINE, attributes, tokens

WIDTH = 64
LEVEL = 6
SCHEME = "urn:sha256:"
MEDIA = frozenset("img video audio source".split())
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """``payload`` (a positive multiple of ``width``) as 8-bit greyscale samples."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(stored_bytes: bytes) -> bytes:
    """The samples of a picture written by ``write_png``; other kinds and damaged chunks are errors."""
    if stored_bytes[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, width, data = 8, 0, []
    while at < len(stored_bytes):
        size = int.from_bytes(stored_bytes[at : at + 4], "big")
        kind, body = stored_bytes[at + 4 : at + 8], stored_bytes[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(stored_bytes[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, _, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not plain 8-bit greyscale")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Smallest, largest and summed sample, and counts of samples in 16 equal ranges."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    ranges = np.bincount(samples >> 4, minlength=16)
    return f"{samples.min()}:{samples.max()}:{int(samples.sum(dtype=np.int64))}:" + "-".join(map(str, ranges.tolist()))


def padded(text: F.Column) -> F.Column:
    """UTF-8 bytes of ``text`` with bytes 0 up to a positive multiple of WIDTH."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    fill = F.greatest(F.ceil(size / WIDTH), F.lit(1)) * WIDTH - size
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill.cast("int"))))


def store_media(payloads: DataFrame) -> DataFrame:
    """(digest, media) of ``payloads`` (digest, payload), stored; a partition holds a digest once."""

    def run(batches):
        seen = set()
        for batch in batches:
            digests, media = [], []
            for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    media.append(write_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return stored(payloads.mapInArrow(run, "digest string, media binary"), "media")


def describe_media(media: DataFrame) -> DataFrame:
    """One row per digest with what the stored bytes give back."""

    def run(batch: pa.RecordBatch):
        rows = []
        for digest, kept in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
            payload = read_png(kept)
            rows.append(
                (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(kept), hashlib.sha256(kept).hexdigest(), feature(payload))
            )
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    each = media.mapInArrow(per_batch(run), schema)
    return each.groupBy("digest").agg(*[F.min(c).alias(c) for c in each.columns[1:]])


def parse_sequence(page: str | None) -> list[dict]:
    """Text blocks and media references in page order; a figcaption, wherever it stands, belongs to all media of its figure."""
    items: list[dict] = []
    held: list[str] = []
    figures: list[dict] = []  # open ones: numbers of their media, places and texts of their captions
    caption: list[str] | None = None
    lone: list[tuple[int, dict]] = []  # captions without media, by the item they stand before

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption():
        nonlocal caption
        text = " ".join("".join(caption).split())
        caption = None
        if text:
            figures[-1]["captions"].append((len(items), text))

    def end_figure():
        if caption is not None:
            end_caption()
        figure = figures.pop()
        if not figure["captions"]:
            for outer in figures[-1:]:
                outer["media"] += figure["media"]
        elif figure["media"]:
            for i in figure["media"]:
                items[i]["caption"] = " ".join(t for _, t in figure["captions"])
        else:
            lone.extend((at, {"kind": "text", "text": t, "digest": None, "caption": None}) for at, t in figure["captions"])

    for kind, name, rest in tokens(page or ""):
        if kind == "text":
            (held if caption is None else caption).append(rest)
        elif name in MEDIA and kind == "start":
            found = attributes(rest)
            if name != "img" and "src" not in found:  # its sources name it
                if caption is None:
                    flush()
                continue
            flush()
            source = found.get("src", "")
            digest = source.removeprefix(SCHEME).lower() if source.startswith(SCHEME) else None
            items.append({"kind": "media", "text": None, "digest": digest, "caption": found.get("alt")})
            for figure in figures[-1:]:
                figure["media"].append(len(items) - 1)
        elif name == "figure":
            flush()
            if kind == "start":
                if caption is not None:
                    end_caption()
                figures.append({"media": [], "captions": []})
            elif figures:
                end_figure()
        elif name == "figcaption" and figures:
            if caption is not None:
                end_caption()
            if kind == "start":
                flush()
                caption = []
        elif kind != "raw" and name not in INLINE:
            if caption is None:
                flush()
    while figures:
        end_figure()
    flush()
    for at, item in reversed(sorted(lone, key=lambda x: x[0])):
        items.insert(at, item)
    return [{"position": i, **item} for i, item in enumerate(items)]


SEQUENCE = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, sequence) of every page."""
    item = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "digest", "caption")]]))

    def run(batch: pa.RecordBatch):
        parsed = [parse_sequence(p) for p in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(parsed, item)], ["id", "sequence"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(per_batch(run), f"id {kind}, sequence {SEQUENCE}")


def resolve(sequence_rows: DataFrame, described: DataFrame) -> DataFrame:
    """One row per media reference: id, position, caption and the columns of ``described``, null where nothing is stored."""
    refs = sequence_rows.select("*", F.explode("sequence").alias("item")).drop("sequence").filter("item.kind = 'media'")
    refs = refs.select(*[c for c in refs.columns if c != "item"], "item.position", "item.caption", "item.digest")
    return refs.join(described, "digest", "left")
