"""A small HTML token stream: tags, text and raw elements, tolerant of unclosed and cut markup.

In a tag a quote opens a value only behind ``=``; an unquoted value ends at white space or ``>``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|title)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attributes>(?:[^<>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|(?=<)|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# What a start tag closes when it is still open.
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``start`` with attribute text, ``end``, ``raw`` for elements without markup inside, ``text`` decoded."""
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            text = m["text"]
            yield "text", "", entities.unescape(text) if "&" in text else text
        elif m["name"]:
            yield ("end" if m["end"] else "start"), m["name"].lower(), m["attributes"] or ""
        elif m["raw"]:
            yield "raw", m["raw"].lower(), ""
