"""Pretraining examples made from one row each: sentence windows, masks, pairs, spans.

A row is one document or sample, so Spark spreads the work; the random choices of a row come from a
generator seeded by the row id and do not depend on the partition it is in.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnOrName, col

# Fixed value: a document with a sentence longer than this gives no samples.
LONG_SENTENCE = 512

_WINDOW = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "target")])
)
_INTS = T.ArrayType(T.IntegerType())


def _generator(seed: int, ident) -> random.Random:
    return random.Random(f"{seed}|{ident}")


def sentence_windows(
    sizes: ColumnOrName,
    ident: ColumnOrName,
    target: int,
    min_sentences: int = 2,
    short_ratio: float = 0.0,
    reserve: ColumnOrName | None = None,
    min_left: int = 2,
    seed: int = 1234,
) -> Column:
    """Array of (start, end, target) sentence windows of a document.

    A window closes at the target length once it has ``min_sentences`` and ``min_left`` remain after
    it, or at the end of the document. ``reserve`` tokens (a title) are taken off the target;
    ``short_ratio`` of the windows aim at a random shorter target.
    """

    @F.pandas_udf(_WINDOW)
    def windows(all_sizes: pd.Series, idents: pd.Series, reserved: pd.Series) -> pd.Series:
        def aim(rng, goal):
            if short_ratio > 0 and rng.random() < short_ratio:
                return rng.randint(2, max(2, goal))
            return goal

        def of(values, name, taken):
            if values is None or len(values) < min_sentences or len(values) == 0:
                return []
            if (len(values) > 1 or min_sentences == 1) and max(values) > LONG_SENTENCE:
                return []
            rng = _generator(seed, name)
            limit = target - int(taken)
            out, start, length, goal = [], 0, 0, aim(rng, limit)
            for i, size in enumerate(values):
                length += size
                left = len(values) - i - 1
                full = length >= goal and left >= min_left and i + 1 - start >= min_sentences
                if full or left == 0:
                    out.append({"start": start, "end": i + 1, "target": goal})
                    start, length, goal = i + 1, 0, aim(rng, limit)
            return out

        return pd.Series([of(*row) for row in zip(all_sizes, idents, reserved)])

    return windows(col(sizes), col(ident), F.lit(0) if reserve is None else col(reserve))


def block_windows(sizes: ColumnOrName, ident: ColumnOrName, title_size: ColumnOrName, target: int, one_sentence: bool = False) -> Column:
    """Windows of a titled document: the title's tokens come off the target."""
    least = 1 if one_sentence else 2
    return sentence_windows(sizes, ident, target, least, reserve=title_size, min_left=least)


_MASKED = T.StructType([T.StructField(n, _INTS) for n in ("tokens", "positions", "labels")])


def masked_example(
    tokens: ColumnOrName,
    word_starts: ColumnOrName,
    ident: ColumnOrName,
    mask_token: int,
    vocabulary: int,
    share: float = 0.15,
    max_ngram: int = 3,
    seed: int = 1234,
) -> Column:
    """Struct (tokens, positions, labels): whole words, in n-grams, hidden up to a share of the tokens.

    A hidden token becomes the mask token (80%), stays (10%) or turns into a random one (10%).
    """

    @F.pandas_udf(_MASKED)
    def masked(rows: pd.Series, starts: pd.Series, idents: pd.Series) -> pd.DataFrame:
        def of(values, begins, name):
            values = [int(v) for v in values]
            rng = _generator(seed, name)
            words: list[list[int]] = []
            for place, begin in enumerate(begins):
                if begin or not words:
                    words.append([])
                words[-1].append(place)
            budget = max(1, round(len(values) * share)) if values else 0
            hidden: set[int] = set()
            order = list(range(len(words)))
            rng.shuffle(order)
            for first in order:
                if len(hidden) >= budget:
                    break
                # Longer n-grams are rarer: weight 1/n.
                sizes = list(range(1, max_ngram + 1))
                n = rng.choices(sizes, [1 / s for s in sizes])[0]
                while n:
                    span = [p for w in words[first : first + n] for p in w]
                    if len(hidden) + len(span) <= budget and hidden.isdisjoint(span):
                        hidden.update(span)
                        break
                    n -= 1
            positions = sorted(hidden)
            out = list(values)
            for p in positions:
                draw = rng.random()
                out[p] = mask_token if draw < 0.8 else values[p] if draw < 0.9 else rng.randrange(vocabulary)
            return out, positions, [values[p] for p in positions]

        return pd.DataFrame([of(*r) for r in zip(rows, starts, idents)], columns=["tokens", "positions", "labels"])

    return masked(col(tokens), col(word_starts), col(ident))


_PAIR = T.StructType(
    [T.StructField("tokens", _INTS), T.StructField("segments", _INTS), T.StructField("swapped", T.BooleanType())]
)


def sentence_pair(
    sentence_tokens: ColumnOrName, ident: ColumnOrName, length: int, first: int, separator: int, seed: int = 1234
) -> Column:
    """Two runs of sentences around a random pivot, swapped half of the time, trimmed to the length.

    Tokens come off the longer run, from a random end; three places are kept for the special tokens.
    """

    @F.pandas_udf(_PAIR)
    def pair(rows: pd.Series, idents: pd.Series) -> pd.DataFrame:
        def of(sentences, name):
            rng = _generator(seed, name)
            sentences = [list(map(int, s)) for s in sentences]
            pivot = rng.randint(1, len(sentences) - 1) if len(sentences) > 1 else 1
            a = [t for s in sentences[:pivot] for t in s]
            b = [t for s in sentences[pivot:] for t in s]
            swapped = rng.random() < 0.5
            if swapped:
                a, b = b, a
            cut = {"a": [0, len(a)], "b": [0, len(b)]}
            excess = len(a) + len(b) - (length - 3)
            for _ in range(max(0, excess)):
                sides = {k: v[1] - v[0] for k, v in cut.items()}
                longer = cut["a"] if sides["a"] > sides["b"] else cut["b"]
                if rng.random() < 0.5:
                    longer[0] += 1
                else:
                    longer[1] -= 1
            a, b = a[slice(*cut["a"])], b[slice(*cut["b"])]
            tokens = [first, *a, separator, *b, separator]
            return tokens, [0] * (len(a) + 2) + [1] * (len(b) + 1), swapped

        return pd.DataFrame([of(*r) for r in zip(rows, idents)], columns=["tokens", "segments", "swapped"])

    return pair(col(sentence_tokens), col(ident))


_CORRUPTED = T.StructType([T.StructField(n, _INTS) for n in ("encoder", "decoder_input", "decoder_output")])


def span_corruption(
    tokens: ColumnOrName,
    ident: ColumnOrName,
    sentinels: list[int],
    begin: int,
    end: int,
    share: float = 0.15,
    mean_span: int = 3,
    seed: int = 1234,
) -> Column:
    """Encoder text with spans replaced by sentinels, and decoder text that spells the spans out."""

    @F.pandas_udf(_CORRUPTED)
    def corrupt(rows: pd.Series, idents: pd.Series) -> pd.DataFrame:
        def of(values, name):
            values = [int(v) for v in values]
            rng = _generator(seed, name)
            budget = max(1, round(len(values) * share)) if values else 0
            free = set(range(len(values)))
            spans: list[tuple[int, int]] = []
            starts = list(range(len(values)))
            rng.shuffle(starts)
            for at in starts:
                if budget <= 0:
                    break
                if len(spans) == len(sentinels):
                    raise ValueError(f"a row of {len(values)} tokens needs more than {len(sentinels)} sentinels")
                n = min(budget, max(1, min(2 * mean_span - 1, rng.randint(1, 2 * mean_span - 1))))
                # Spans keep a token between them, so each has a sentinel of its own.
                around = set(range(max(0, at - 1), min(len(values), at + n + 1)))
                if at + n <= len(values) and around <= free:
                    spans.append((at, n))
                    free -= set(range(at, at + n))
                    budget -= n
            encoder, decoder, last = [], [], 0
            for sentinel, (at, n) in zip(sentinels, sorted(spans)):
                encoder += values[last:at] + [sentinel]
                decoder += [sentinel] + values[at : at + n]
                last = at + n
            encoder += values[last:]
            return encoder, [begin, *decoder], [*decoder, end]

        return pd.DataFrame([of(*r) for r in zip(rows, idents)], columns=["encoder", "decoder_input", "decoder_output"])

    return corrupt(col(tokens), col(ident))


def query_context(sentences: ColumnOrName, ident: ColumnOrName, keep_share: float = 0.1, seed: int = 1234) -> Column:
    """Struct (query, context): a random sentence, and the others; the sentence stays in sometimes."""
    from ..functions.seeded import seeded_long, seeded_unit

    items = col(sentences)
    place = F.pmod(seeded_long(seed, "sentence", ident), F.size(items).cast("bigint")).cast("int")
    kept = seeded_unit(seed, "keep", ident) < keep_share
    numbered = F.transform(items, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    at = F.when(F.size(items) > 0, place)
    from ..functions.columns import let

    def build(b):
        rest = F.filter(b["numbered"], lambda n: b["kept"] | (n["i"] != b["at"]))
        return F.struct(
            F.get(b["numbered"], b["at"])["s"].alias("query"), F.transform(rest, lambda n: n["s"]).alias("context")
        )

    return let(F.struct(numbered.alias("numbered"), at.alias("at"), kept.alias("kept")), build)
