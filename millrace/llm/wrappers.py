"""Main text of pages by wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over block elements. Every page's token stream becomes a tree of
blocks; aligning it with the wrapper so far resolves each mismatch: text that differs becomes a text slot, an element that one
side lacks becomes optional, neighbours of one kind or a repeated run of kinds become a repeated group. Merging wrappers of
wrappers works the same way, so partitions infer their own and these meet per host in two steps. All pages take part.

The wrapper's expression then says which paths hold the article: inside ``article`` or ``main`` for a page with text there, else
(a host may have several templates) all paths outside these but those whose text is mostly links or never varies between pages
that differ elsewhere; copies of a page, also with other menus or adverts, count as one. Text inside an article that is the
same on DISTINCT different pages of the host is a notice and no article, headings apart.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are told by element, role and class names. Names are a
hint: a class counts only if all its words are of that kind or say nothing (``site-footer``, not ``content-with-sidebar``), and neither
names nor elements count against ``html``, ``body``, the article, or what holds it: an element with an article or main with text, or,
comments and menus apart, most of the host's text that is no link. Each page's blocks on those paths are its text.

Elements nested deeper than DEPTH have no path of their own: their text belongs to the element that holds them there.

Defined results: null and empty pages have an empty text; a null url is a host of its own; repeated rows give repeated rows; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored
from .markup import IMPLIED_END, INLINE, VOID, attributes, tokens

GROUP_KINDS = 4  # kinds of elements in a repeated group, at most
DEPTH = 200
DISTINCT = 5
ALIGN_CELLS = 250_000  # of the table of a longest common subsequence; longer lists are aligned by kinds that occur once
MERGE_FANOUT = 32
_ASIDE_TAGS = frozenset("nav header footer aside form button select dialog menu head input fieldset datalist audio video canvas".split())
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disqus discussion footer header login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pagination pager popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription tags toolbar widget widgets".split()
)
# Words that say nothing about what a class holds.
_NEUTRAL_NAMES = frozenset(
    "site page top bottom left right main box container wrapper wrap inner outer block area section bar list item items form unit slot "
    "global primary secondary links posts articles stories body head row col column text bg fixed sticky mobile desktop".split()
)
# What stays aside even where it holds most of the text.
_NEVER_MAIN = frozenset("comment comments commentlist disqus discussion replies reply respond footer menu nav navbar navigation related head select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPLIT = re.compile(r"[^a-z]+")
_KEYED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden)\b", re.I)


def _key(name: str, rest: str) -> str:
    """Element name with its class and id names and its role (numbers left out)."""
    if not rest or not _KEYED.search(rest):
        return name
    held = attributes(rest)
    names = (w for a in ("class", "id") for w in held.get(a, "").lower().split())
    words = sorted({w for w in ("-".join(x for x in _SPLIT.split(name) if x) for name in names) if w})
    role = held.get("role", "").lower()
    hidden = "!" if "hidden" in held or held.get("aria-hidden") == "true" else ""
    return name + "".join(f".{w}" for w in words) + (f"@{role}" if role else "") + hidden


def _walk(page: str):
    """("open", key), ("close",), ("text", text, in a link): blocks only; inline elements leave no trace."""
    stack: list[str] = []
    held: Counter[str] = Counter()
    links = 0

    def pop() -> str:
        last = stack.pop()
        held[last] -= 1
        return last

    for kind, name, rest in tokens(page):
        if kind == "text":
            yield "text", rest, links > 0
        elif kind == "raw":
            continue
        elif name == "br":
            yield "text", " ", links > 0
        elif name in INLINE:
            if name == "a":
                links = max(0, links + (1 if kind == "start" else -1))
        elif kind == "start":
            links = 0
            closes = IMPLIED_END.get(name, ())
            while stack and (stack[-1] == "p" or stack[-1] in closes):
                pop()
                yield "close", "", False
            yield "open", _key(name, rest), False
            if name in VOID or rest.endswith("/"):
                yield "close", "", False
            else:
                stack.append(name)
                held[name] += 1
        elif held[name]:
            links = 0
            while stack:
                last = pop()
                yield "close", "", False
                if last == name:
                    break


class _Node:
    """An element of the expression: key, optional?, repeated?, children, and its text: number of pages, constant or slot,
    characters in all and in links, and the DISTINCT smallest content hashes of its pages (one hash where all are copies of one
    page). Groups have a key in parentheses and no text."""

    __slots__ = ("chars", "children", "constant", "hashes", "key", "link_chars", "many", "optional", "pages")

    def __init__(self, key, optional=False, many=False, children=(), pages=0, constant=None, chars=0, link_chars=0, hashes=()):
        self.key, self.optional, self.many, self.children = key, optional, many, list(children)
        self.pages, self.constant, self.chars, self.link_chars = pages, constant, chars, link_chars
        self.hashes = list(hashes)

    def plain(self):
        text = [self.pages, self.constant, self.chars, self.link_chars, self.hashes]
        return [self.key, self.optional, self.many, [c.plain() for c in self.children], *text]

    def of_page(self, content: str) -> None:
        if self.pages:
            self.hashes = [content]
        for c in self.children:
            c.of_page(content)

    @classmethod
    def of(cls, data):
        key, optional, many, children, *text = data
        return cls(key, optional, many, [cls.of(c) for c in children], *text)

    def __str__(self):
        inner = ([] if not self.pages else ["#" if self.constant is None else "=" ]) + [str(c) for c in self.children]
        body = f"({' '.join(inner)})" if self.key.startswith("(") else f"<{self.key}>{' '.join(inner)}</>"
        return body + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[self.optional, self.many]


def _merge(a: _Node, b: _Node) -> _Node:
    same = a.constant if not b.pages else b.constant if not a.pages else a.constant if a.constant == b.constant else None
    hashes = a.hashes if a.hashes == b.hashes else sorted({*a.hashes, *b.hashes})[:DISTINCT]
    return _Node(
        a.key, a.optional or b.optional, a.many or b.many, _align(a.children, b.children),
        a.pages + b.pages, same, a.chars + b.chars, a.link_chars + b.link_chars, hashes,
    )


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two long lists: the longest increasing one of the kinds that occur once in each."""
    once_a, once_b = ({k for k, n in Counter(x).items() if n == 1} for x in (a, b))
    at = {k: j for j, k in enumerate(b) if k in once_b}
    pairs = [(i, at[k]) for i, k in enumerate(a) if k in once_a and k in at]
    ends: list[int] = []  # least last place in b of a run of each length
    tails, before = [], []
    for n, (_, j) in enumerate(pairs):
        size = bisect_left(ends, j)
        ends[size : size + 1] = [j]
        tails[size : size + 1] = [n]
        before.append(tails[size - 1] if size else -1)
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of a good one where the lists are long."""
    if len(a) * len(b) > ALIGN_CELLS:
        return _anchors(a, b)
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _align(a: list[_Node], b: list[_Node]) -> list[_Node]:
    """Common subsequence of keys; what only one side has is optional."""
    if [x.key for x in a] == [y.key for y in b]:
        return [_merge(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for s, e in [*_common([x.key for x in a], [y.key for y in b]), (len(a), len(b))]:
        for one in (*a[i:s], *b[j:e]):
            one.optional = True
            out.append(one)
        if s < len(a):
            out.append(_merge(a[s], b[e]))
        i, j = s + 1, e + 1
    return _fold(out)


def _fold(children: list[_Node]) -> list[_Node]:
    """Neighbours of one kind become a repeated element, repeated runs of kinds a repeated group."""
    out: list[_Node] = []
    for c in children:
        if out and out[-1].key == c.key:
            out[-1] = _merge(out[-1], c)
            out[-1].many = True
        else:
            out.append(c)
    for width in range(2, GROUP_KINDS + 1):
        i = 0
        while i + 2 * width <= len(out):
            keys = [c.key for c in out[i : i + width]]
            end = i + width
            while [c.key for c in out[end : end + width]] == keys:
                end += width
            if end > i + width:
                body = out[i : i + width]
                for at in range(i + width, end, width):
                    body = [_merge(x, y) for x, y in zip(body, out[at : at + width])]
                out[i:end] = [_Node(f"({' '.join(keys)})", False, True, body)]
            i += 1
    return out


def page_tree(page: str) -> _Node:
    root = _Node("")
    stack, texts = [root], [[]]
    places, content = [(False, False)], []  # (in an article, aside) of the open elements; what tells a page from its copies
    deeper = 0  # open elements below DEPTH

    def close():
        _, off = places.pop()
        node, parts = stack.pop(), texts.pop()
        whole = " ".join(" ".join(t for t, _ in parts).split())
        if whole:
            node.pages, node.constant, node.chars = 1, hash_text(whole), len(whole)
            node.link_chars = sum(len(t.strip()) for t, link in parts if link)
            if not off and node.link_chars * 2 <= node.chars:
                content.append(f"{node.key}\t{node.constant}")
        node.children = _fold(node.children)
        if stack:
            stack[-1].children.append(node)

    for kind, value, link in _walk(page):
        if kind == "text":
            texts[-1].append((value, link))
        elif kind == "open" and len(stack) > DEPTH:
            deeper += 1
            texts[-1].append((" ", link))
        elif kind == "close" and deeper:
            deeper -= 1
            texts[-1].append((" ", link))
        elif kind == "open":
            stack.append(_Node(value))
            texts.append([])
            inside = places[-1][0] or _is_main(value)
            places.append((inside, places[-1][1] or _is_aside(value, inside)))
        else:
            close()
    while stack:
        close()
    root.of_page(hash_text("\n".join(content)))
    return root


def hash_text(text: str) -> str:
    import xxhash

    return xxhash.xxh3_64_hexdigest(text)


@lru_cache(1 << 14)
def _aside_names(key: str, in_article: bool) -> frozenset[str]:
    """What in a key says that it is no article: element, role and class names, "!" for hidden ones."""
    body, _, role = key.rstrip("!").partition("@")
    name, *classes = body.split(".")
    found = {"!"} if key.endswith("!") else set()
    if name in ("html", "body", "article", "main") or role in ("main", "article"):
        return frozenset(found)
    if role in _ASIDE_ROLES:
        found.add(role)
    if name in _ASIDE_TAGS and not (name == "header" and in_article):
        found.add(name)
    for words in (c.split("-") for c in classes):
        if all(w in _ASIDE_NAMES or w in _NEUTRAL_NAMES for w in words):
            found.update(w for w in words if w in _ASIDE_NAMES)
    return frozenset(found)


def _is_aside(key: str, in_article: bool) -> bool:
    return bool(_aside_names(key, in_article))


@lru_cache(1 << 14)
def _is_main(key: str) -> bool:
    body, _, role = key.partition("@")
    return body.split(".")[0] in ("article", "main") or role in ("main", "article")


def _weigh(node: _Node, held: dict[int, tuple[int, bool]]) -> tuple[int, bool]:
    """Characters outside links in a subtree, and whether an article or main with text is in it; kept by node."""
    size, main = max(0, node.chars - node.link_chars), False
    for c in node.children:
        below, inside = _weigh(c, held)
        size += below
        main = main or inside or (_is_main(c.key) and below > 0)
    held[id(node)] = size, main
    return size, main


def main_paths(root: _Node) -> tuple[list[str], list[str]]:
    """Paths (keys joined by tabs) of the wrapper whose text is the article: those inside ``article`` or ``main``, and those of
    pages that have no text there."""
    weights: dict[int, tuple[int, bool]] = {}
    whole, _ = _weigh(root, weights)
    found = []

    def visit(node: _Node, path: str, main: bool, aside: bool) -> None:
        for c in node.children:
            if c.key.startswith("("):
                visit(c, path, main, aside)
                continue
            inside = main or _is_main(c.key)
            names, (size, holds) = _aside_names(c.key, inside), weights[id(c)]
            holds = holds or (2 * size > whole and not names & _NEVER_MAIN and "!" not in names)
            off = aside or (bool(names) and not holds)
            here = f"{path}\t{c.key}"
            found.append((here, c, inside, off))
            visit(c, here, inside, off)

    visit(root, "", False, False)
    article, slots = set(), {""} if root.pages else set()
    for path, node, inside, off in found:
        heading = node.key.split(".")[0] in _HEADINGS
        fixed = node.constant is not None and len(node.hashes) >= (DISTINCT if inside else 2) and not (inside and heading)
        if off or fixed:
            continue
        if inside:
            article.add(path)
        elif node.link_chars * 2 <= node.chars:
            slots.add(path)
    return sorted(article), sorted(slots)


def article_text(page: str | None, paths: frozenset[str]) -> str:
    """Blocks of ``page`` on ``paths``, white space inside a block made one space, joined by two line ends."""
    blocks: list[str] = []
    path, held, deeper = [""], [], 0

    def flush():
        if held:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held.clear()

    for kind, value, _ in _walk(page or ""):
        if kind == "text":
            if path[-1] in paths:
                held.append(value)
        else:
            flush()
            if kind == "open" and len(path) > DEPTH:
                deeper += 1
            elif kind == "open":
                path.append(f"{path[-1]}\t{value}")
            elif deeper:
                deeper -= 1
            elif len(path) > 1:
                path.pop()
    flush()
    return "\n\n".join(blocks)


def host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, expression, paths, slots) of every host in ``pages`` (url, html), stored."""

    def partial(batches):
        held: dict[str, _Node] = {}
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                tree = page_tree(page or "")
                held[name] = _merge(held[name], tree) if name in held else tree
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array([json.dumps(n.plain()) for n in held.values()], pa.string())], ["host", "wrapper"]
        )

    def merged(pdf: pd.DataFrame) -> _Node:
        root = None
        for data in sorted(pdf["wrapper"]):
            node = _Node.of(json.loads(data))
            root = node if root is None else _merge(root, node)
        return root

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(merged(pdf).plain())]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        root = merged(pdf)
        article, slots = main_paths(root)
        return pd.DataFrame(
            {"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(root.plain())], "expression": [str(root)], "paths": [article], "slots": [slots]}
        )

    parts = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(partial, "host string, wrapper string")
    spread = parts.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_FANOUT)))
    some_of = spread.groupBy("host", "share").applyInPandas(some, "host string, wrapper string")
    return stored(some_of.groupBy("host").applyInPandas(final, "host string, wrapper string, expression string, paths array<string>, slots array<string>"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page by its host's wrapper. Spark broadcasts the wrappers only while their files are small."""

    def run(batch: pa.RecordBatch):
        known: dict[tuple, frozenset] = {}
        texts = []
        for page, *both in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "slots"))):
            keys = [tuple(paths or ()) for paths in both]
            article, slots = (known.setdefault(key, frozenset(key)) for key in keys)
            texts.append(article_text(page, article) or article_text(page, slots))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    named = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    met = named.join(wrappers.select("host", "paths", "slots"), "host", "left").select("page_id", "url", "html", "paths", "slots")
    kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(per_batch(run), f"page_id {kind}, url string, text string")
