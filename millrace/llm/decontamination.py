"""Benchmark decontamination by one Aho-Corasick automaton over normalised test questions and answers.

Words are runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII. A window is ``window`` consecutive words of
an item; an item of fewer words, but not none, is one window. Every window, its words joined by spaces and with a space at either
end, is a pattern of the automaton. A text is brought to the same form byte by byte and scanned once; the words under an occurrence
are hit, and runs of hit words are mapped back to code points of the text as it was.

The automaton of a pass holds at most about PASS_BYTES of patterns, which is all that is broadcast. A benchmark with more
is dealt over several passes by window hash; rows of the passes are put together by row number, so the result is the same.

Defined results: null and empty texts, and texts without words, have no words and no hits; null and empty items have no windows;
an item whose id is null hits words and is not listed; rows of one item_id are one item; repeated documents are documents
of their own, also with a null doc_id; empty tables give no rows, or rows without hits. Extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored, worker_cache

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
PASS_BYTES = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORM = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def windows_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, n, items): every distinct window, the number of its words and the ids of its items as sorted strings."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = items.select(
        "item",
        F.least(F.size("words"), F.lit(window)).alias("n"),
        F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(window)), " "))).alias("win"),
    )
    return each.distinct().groupBy("win", "n").agg(F.sort_array(F.collect_list("item")).alias("items"))


def _automaton(key: object, rows: list[tuple[str, int, list[str]]]):
    """The worker's automaton of one pass; that of another pass is given up."""
    import ahocorasick

    cache = worker_cache("decontamination")
    if cache.get("key") != key:
        cache.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS) if rows else None
        for i, (win, _, _) in enumerate(rows):
            made.add_word(f" {win} ".encode().decode("latin-1"), i)
        if made is not None:
            made.make_automaton()
        cache.update(key=key, made=made)
    return cache["made"]


def _occurrences(automaton, rows: list, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text, (first, behind last) word of every run of hit words, and the windows that occur."""
    words = text.translate(_FORM).split()
    if automaton is None or not words:
        return len(words), [], set()
    form = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(form.decode("latin-1")))
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(form, dtype=np.uint8) == 32)
    ends, which = np.array(found, dtype=np.int64).T
    behind = np.searchsorted(spaces, ends)
    distinct, inverse = np.unique(which, return_inverse=True)
    sizes = np.array([rows[i][1] for i in distinct.tolist()])
    return len(words), _runs(behind - sizes[inverse], behind), set(distinct.tolist())


def _runs(first: np.ndarray, behind: np.ndarray) -> list[tuple[int, int]]:
    """Unions of the overlapping or touching ranges."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(behind[order])
    opens = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return list(zip(first[opens].tolist(), reach[np.append(opens[1:], len(first)) - 1].tolist()))


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point ranges of the text under runs of words."""
    word = np.frombuffer(b" " + text.translate(_FORM) + b" ", dtype=np.uint8) != 32
    edges = np.flatnonzero(word[1:] != word[:-1])
    before = np.append(0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))
    return [{"start": int(before[edges[2 * a]]), "end": int(before[edges[2 * b - 1]])} for a, b in runs]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RUNS = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def scan(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every row of ``docs``.

    ``spans`` are ranges of code points under runs of hit words, ``items`` the sorted ids of items with a window in the text.
    """
    spark = docs.sparkSession
    windows = stored(windows, "windows")
    weight = F.octet_length("win") + F.lit(2) + F.lit(16) * F.size("items")
    total = windows.agg(F.sum(weight)).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))

    name = uuid.uuid4().hex

    def patterns(i: int):
        part = windows.filter(F.pmod(F.xxhash64("win"), F.lit(passes)) == i).select("win", "n", "items")
        rows = [(r["win"], r["n"], r["items"]) for r in part.collect()]  # about pass_bytes
        return spark.sparkContext.broadcast((f"{name}-{i}", rows))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    if passes == 1:
        shared = patterns(0)

        def run(batch: pa.RecordBatch):
            key, rows = shared.value
            automaton = _automaton(key, rows)
            n_words, n_hit, spans, items = [], [], [], []
            for text in _texts(batch.column("text")):
                n, runs, hit = _occurrences(automaton, rows, text)
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in runs))
                spans.append(_spans(text, runs))
                items.append(sorted({x for i in hit for x in rows[i][2]}))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "spans", "items"],
            )

        return texts.mapInArrow(
            per_batch(run), f"doc_id {kind}, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"
        )

    numbered = stored(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")

    def one_pass(shared):
        def run(batch: pa.RecordBatch):
            key, rows = shared.value
            automaton = _automaton(key, rows)
            out = [(row, *_occurrences(automaton, rows, text)) for row, text in zip(batch.column("row").to_pylist(), _texts(batch.column("text")))]
            out = [x for x in out if x[2]]
            runs = [[{"first": a, "behind": b} for a, b in x[2]] for x in out]
            items = [sorted({y for i in x[3] for y in rows[i][2]}) for x in out]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array(runs, RUNS), pa.array(items, pa.list_(pa.string()))], ["row", "runs", "items"]
            )

        found = numbered.select("row", "text").mapInArrow(
            per_batch(run), "row long, runs array<struct<first: long, behind: long>>, items array<string>"
        )
        return stored(found, "pass")

    found = None
    for i in range(passes):
        shared = patterns(i)
        part = one_pass(shared)
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # at most one row a pass for each document
    merged = found.groupBy("row").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def finish(batch: pa.RecordBatch):
        n_words, n_hit, spans = [], [], []
        for text, runs in zip(_texts(batch.column("text")), batch.column("runs").to_pylist()):
            if runs:
                runs = _runs(np.array([r["first"] for r in runs]), np.array([r["behind"] for r in runs]))
            n_words.append(len(text.translate(_FORM).split()))
            n_hit.append(sum(b - a for a, b in runs or []))
            spans.append(_spans(text, runs or []))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, SPANS), batch.column("items")],
            ["doc_id", "n_words", "n_hit", "spans", "items"],
        )

    whole = numbered.join(merged, "row", "left").select(
        "doc_id", "text", "runs", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    return whole.mapInArrow(
        per_batch(finish), f"doc_id {kind}, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``scan`` of documents (doc_id, text) for windows of a benchmark (item_id, text)."""
    return scan(docs, windows_of(benchmark, window=window), pass_bytes=pass_bytes)
