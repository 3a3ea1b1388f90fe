"""Secret scans over nested encodings.

A worklist starts with the text itself. Every layer is scanned, then unwrapped: percent escapes, Unicode escapes (``\\uXXXX``,
``\\xXX``, ``&#N;``), base64 runs and compressed bytes inside those give new layers until none is new. A layer keeps, for
each of its characters, the span of the text it came from, so a find in any depth is a span of the text. A layer seen
before at the same place is not taken again, so the work ends. Percent and character escapes are undone level by level for STEPS
levels, each a layer; what is escaped deeper is undone to its fixpoint in one sweep, from left to right with a stack, so a text of n
nested levels costs n and not n * n.

Defined results: a null or empty text has no finds. Repeated rows give repeated rows. Extra columns are not read
(``redact`` keeps them). A base64 run, also one wrapped in lines, is decoded at each of its first four characters; it is a layer if
its bytes have a stretch of readable text as long as the shortest secret, or a gzip or zlib header. Compressed streams start
anywhere in the bytes of an encoding and may follow one another; a cut one gives what comes before the cut. A body beyond
MAX_UNPACKED bytes is taken in pieces of that size that overlap by OVERLAP, so that compression bombs do not fill the memory.
"""

from __future__ import annotations

import binascii
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch

KINDS = ("assign", "access", "hex")
MAX_UNPACKED, OVERLAP = 64 << 20, 1 << 20  # of a piece of an unpacked body
STEPS = 3  # levels of percent and character escapes that are layers of their own
FEED, PIECE = 512, 1 << 20  # bytes given to and taken from a decompressor at once
PLACEHOLDER = "[secret]"

# The patterns of the three kinds and the least lengths of their matches.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ASSIGN_LEAST, _ACCESS_LEAST, _HEX_LEAST = 8, 16, 32
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));", re.I)
_BASE64_LEAST = 19  # of the shortest secret, 14 bytes
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % _BASE64_LEAST)
_WRAP = re.compile(r"(?<=[A-Za-z0-9+/_-])[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")  # as the shortest secret, and all that encodes one, has
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68](?=.)", re.S)  # gzip and zlib headers
_PERCENT_PACKED = re.compile(r"%1f%8b|(?:%78|x)%(?:01|5e|9c|da)|(?:%78|x)\^", re.I)
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})")
_BYTE_ESCAPE = re.compile(_ESCAPE.pattern + r"|(?-i:\\[abfnrtv0'\"\\/]|&(?:amp|lt|gt|quot);)", re.I)
_SIMPLE = {"\\a": "\a", "\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\v", "\\0": "\0", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % _HEX_LEAST)


def _marks(chars: str) -> bytes:
    return bytes(1 if chr(b) in chars else 0 for b in range(256))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_IS_BASE64, _IS_HEX = _marks(_LETTERS), _marks("0123456789abcdef")
_RUN64, _RUNHEX = b"\x01" * _BASE64_LEAST, b"\x01" * _HEX_LEAST


def base_finds(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind number) of the plain patterns; each test before a pattern is implied by a match of it."""
    if (":" in text or "=" in text) and any(name in low for low in (text.lower(),) for name in _NAMES):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= _ASSIGN_LEAST:
                yield m.start(), m.end(), 0
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= _ACCESS_LEAST:
                yield m.start(), m.end(), 1
    if _RUNHEX in text.encode("utf-8", "surrogatepass").translate(_IS_HEX):
        for m in _LONG_HEX.finditer(text):
            yield m.start(), m.end(), 2


class _Layer:
    """A text whose character i comes from ``spans`` of the original; pieces are (first character, start, width).

    ``width`` 1 means that characters of the piece follow the original one by one, otherwise all of them stand for the whole
    span [start, start + width). The characters of a ``raw`` layer are bytes.
    """

    __slots__ = ("at", "pieces", "raw", "steps", "text")

    def __init__(self, text: str, pieces: list[tuple[int, int, int]], raw: bool = False, steps: int = 0):
        self.text, self.pieces, self.raw, self.steps = text, pieces, raw, steps
        self.at = [p[0] for p in pieces]

    def origin(self, i: int) -> tuple[int, int]:
        first, start, width = self.pieces[bisect_right(self.at, i) - 1]
        return (start + i - first, start + i - first + 1) if width == 1 else (start, start + width)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.origin(start)[0], self.origin(end - 1)[1]

    def replaced(self, parts: list[tuple[int, int, str]]) -> _Layer:
        """The layer with [start, end) replaced by decoded text, in order."""
        out, pieces, length, done = [], [], 0, 0
        for start, end, decoded in [*parts, (len(self.text), len(self.text), "")]:
            if start > done:
                lo = bisect_right(self.at, done) - 1
                for k in range(lo, len(self.pieces)):
                    first, origin, width = self.pieces[k]
                    if first >= start:
                        break
                    begin = max(first, done)
                    pieces.append((length + begin - done, origin + begin - first if width == 1 else origin, width))
                out.append(self.text[done:start])
                length += start - done
            if decoded:
                a, b = self.span(start, end)
                pieces.append((length, a, max(2, b - a)) if b - a > 1 else (length, a, 1))
                out.append(decoded)
                length += len(decoded)
            done = end
        return _Layer("".join(out), pieces, steps=self.steps + 1)


def _percent_layer(layer: _Layer) -> _Layer | None:
    if "%" not in layer.text:
        return None
    parts = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m.group().replace("%", ""))
        try:
            decoded = raw.decode()
        except UnicodeDecodeError:
            decoded = raw.decode("latin-1")
        at = m.start()
        for c in decoded:
            width = 3 * (len(c.encode()) if len(decoded) != len(raw) else 1)
            parts.append((at, at + width, c))
            at += width
    return layer.replaced(parts) if parts else None


def _escape_layer(layer: _Layer) -> _Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    parts = []
    for m in _ESCAPE.finditer(layer.text):
        code = int(m[5]) if m[5] else int(next(g for g in m.groups()[:4] if g), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code)))
    return layer.replaced(parts) if parts else None


_LONGEST_ESCAPE = 11  # &#x10FFFF; and \\u{10FFFF}
_ESCAPE_END = re.compile(_ESCAPE.pattern + r"|%([0-9A-Fa-f]{2})", re.I)


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def _last_escape(held: list[str]) -> tuple[int, str] | None:
    """(length, character) of an escape that ends at the last of the held characters."""
    last, n = held[-1], len(held)
    if last in _HEX_DIGITS:
        if n > 2 and held[-3] == "%" and held[-2] in _HEX_DIGITS:
            return 3, chr(int(held[-2] + last, 16))
        if n > 3 and held[-4] == "\\" and held[-3] in "xX" and held[-2] in _HEX_DIGITS:
            return 4, chr(int(held[-2] + last, 16))
        if n < 6 or held[-6] != "\\" or held[-5] not in "uU":
            return None
    elif last not in ";}":
        return None
    tail = "".join(held[-_LONGEST_ESCAPE:])
    at = max(tail.rfind("\\"), tail.rfind("&"))
    m = _ESCAPE.fullmatch(tail, at) if at >= 0 else None
    if m:
        code = int(m[5]) if m[5] else int(next(g for g in m.groups()[:4] if g), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            return len(tail) - at, chr(code)
    return None


def _reduced_layer(layer: _Layer) -> _Layer | None:
    """All percent and character escapes undone to the fixpoint: a decoded character may end or begin another escape."""
    text, parts, done = layer.text, [], 0
    while m := _ESCAPE_END.search(text, done):
        first = max(done, m.start() - _LONGEST_ESCAPE + 1)
        held, starts, ends, i, opened = [], [], [], first, 0
        while i < len(text):
            held.append(text[i])
            starts.append(i)
            i += 1
            ends.append(i)
            while (found := _last_escape(held)) is not None:
                n, decoded = found
                start = starts[-n]
                del held[-n:], starts[-n:], ends[-n:]
                held.append(decoded)
                starts.append(start)
                ends.append(i)
            if held[-1] in "%\\&":
                opened = len(held)
            elif i >= m.end() and len(held) - opened >= _LONGEST_ESCAPE:
                break
        parts += [(a, b, c) for c, a, b in zip(held, starts, ends) if b - a > 1]
        done = i
    return layer.replaced(parts) if parts else None


def _inflated(raw: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """(output, bytes read) of the compressed stream at ``at`` and those that follow it at once; (b"", end) after each whole one.
    A cut or damaged stream gives what comes before the damage."""
    view = memoryview(raw)
    while _PACKED.match(raw, at):
        unpack, read = zlib.decompressobj(47), at
        try:
            while not unpack.eof:
                data = unpack.unconsumed_tail
                if not data:
                    data = view[read : read + FEED]
                    read += len(data)
                out = unpack.decompress(data, PIECE)
                if out:
                    yield out, read
                elif not data:
                    return
        except zlib.error:  # also of what only looks like a header
            return
        at = read - len(unpack.unused_data)
        yield b"", at


def _packed_layers(layer: _Layer) -> Iterator[_Layer]:
    """What gzip and zlib streams in a layer of bytes hold, at most about MAX_UNPACKED bytes at a time with an overlap."""
    raw, done = layer.text.encode("latin-1", "replace"), 0
    for m in _PACKED.finditer(raw):
        if m.start() < done:
            continue
        end = m.start()
        for out, end in _inflated(raw, m.start()):
            done = done if out else end
        if end == m.start():
            continue
        a, b = layer.span(m.start(), end)
        held, fresh = bytearray(), 0
        for out, read in chain(_inflated(raw, m.start()), [(b"", -1)]):
            held += out
            fresh += len(out)
            if fresh and (len(held) >= MAX_UNPACKED or read < 0):
                if _STRETCH.search(held) or _PACKED.search(held):
                    yield _Layer(held.decode("latin-1"), [(0, a, max(2, b - a))], True)
                del held[: max(0, len(held) - OVERLAP)]
                fresh = 0


def _percent_packed(layer: _Layer) -> Iterator[_Layer]:
    """What compressed streams hold whose bytes are percent escapes and plain characters (``+`` as itself and as a space)."""
    if "%" not in layer.text or not _PERCENT_PACKED.search(layer.text):
        return
    new = layer.replaced([(m.start(), m.end(), chr(int(m[1], 16))) for m in _BYTE.finditer(layer.text)])
    yield from _packed_layers(new)
    if "+" in layer.text:
        spaced = _Layer(layer.text.replace("+", " "), layer.pieces)
        yield from _packed_layers(spaced.replaced([(m.start(), m.end(), chr(int(m[1], 16))) for m in _BYTE.finditer(spaced.text)]))


def _escape_packed(layer: _Layer) -> Iterator[_Layer]:
    """What compressed streams hold whose bytes are Unicode or byte escapes, one-letter escapes and plain characters."""
    if ("\\" not in layer.text and "&#" not in layer.text) or not _ESCAPE.search(layer.text):
        return
    parts = []
    for m in _BYTE_ESCAPE.finditer(layer.text):
        digits = next((g for g in (m[1], m[2], m[3], m[4]) if g), None)
        if m[5] or digits:
            code = int(m[5]) if m[5] else int(digits, 16)
            parts.append((m.start(), m.end(), chr(code) if code < 256 else "?"))
        else:
            parts.append((m.start(), m.end(), _SIMPLE.get(m[0], m[0][-1])))
    yield from _packed_layers(layer.replaced(parts))


def _joined(layer: _Layer) -> _Layer:
    """The layer without the line ends (and indents) inside wrapped base64."""
    if "\n" not in layer.text and "\r" not in layer.text and "\\" not in layer.text:
        return layer
    parts = [(m.start(), m.end(), "") for m in _WRAP.finditer(layer.text)]
    return layer.replaced(parts) if parts else layer


def _base64_layers(layer: _Layer) -> Iterator[_Layer]:
    """Runs of base64 letters at all four places where a group of four may start: separators such as ``/`` and ``_`` are letters too.
    Bytes are characters of the new layer, so bytes that are no text only end a stretch of it."""
    layer = _joined(layer)
    if _RUN64 not in layer.text.encode("utf-8", "surrogatepass").translate(_IS_BASE64):
        return
    for m in _BASE64.finditer(layer.text):
        run = m.group().rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4):
            body = run[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < _BASE64_LEAST:
                break
            raw = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            if _STRETCH.search(raw) or _PACKED.search(raw):
                pieces = []
                for i in range(0, len(raw), 3):  # three bytes for four characters
                    at = m.start() + skip + i // 3 * 4
                    a, b = layer.span(at, min(at + 4, m.start() + skip + len(body)))
                    pieces.append((i, a, max(2, b - a)))
                yield _Layer(raw.decode("latin-1"), pieces, True)


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    """The layers one step below, each made when it is asked for."""
    for made in (_percent_layer, _escape_layer) if layer.steps < STEPS else (_reduced_layer,) if layer.steps == STEPS else ():
        new = made(layer)
        if new is not None and new.text:
            yield new
    yield from _base64_layers(layer)
    yield from _percent_packed(layer)
    yield from _escape_packed(layer)
    if layer.raw:
        yield from _packed_layers(layer)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base finds, all finds) of (start, end, kind number), each sorted by start and kind."""
    text = text or ""
    base = sorted(base_finds(text), key=lambda f: (f[0], f[2], f[1]))
    found = set(base)
    work, seen = [_unwrapped(_Layer(text, [(0, 0, 1)]))], set()
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        mark = (xxhash.xxh3_128_digest(new.text.encode("utf-8", "surrogatepass")), *new.span(0, len(new.text)))
        if mark in seen:
            continue
        seen.add(mark)
        work.append(_unwrapped(new))
        for start, end, kind in base_finds(new.text):
            found.add((*new.span(start, end), kind))
    return base, sorted(found, key=lambda f: (f[0], f[2], f[1]))


def redacted(text: str | None) -> str | None:
    """``text`` with every found span, overlapping ones as one, replaced by a placeholder."""
    if not text:
        return text
    out, done = [], 0
    merged: list[list[int]] = []
    for start, end, _ in scan(text)[1]:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[done:start], PLACEHOLDER]
        done = end
    return "".join(out) + text[done:] if out else text


FIND = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, finds): all finds of each text by start and kind, each with whether it is a plain (base) one."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batch: pa.RecordBatch):
        rows = []
        for text in batch.column("text").to_pylist():
            base, every = scan(text)
            plain = set(base)
            rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, b, k) in plain} for a, b, k in every])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "finds"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(per_batch(run), f"doc_id long, finds {FIND}")


def span_text(finds: Column) -> Column:
    """kind:start:end of each find, comma-joined."""
    one = F.transform(finds, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.array_join(one, ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced, n_chars following where there is one."""

    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    out = docs.withColumn("text", F.pandas_udf(clean, "string")(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
