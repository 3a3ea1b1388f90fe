"""Token corpora: tokenise, split, index, cut into samples, chunk, truncate and pad."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col, let
from ..functions.seeded import seeded_hash, seeded_long
from ..functions.text import words
from .ordering import row_total, running_totals, with_position, with_shuffled_position

Tokenizer = Callable[[Column], Column]

# Fixed value: a sentence end, for the rule-based splitter.
SENTENCE_END = r"(?<=[.!?])\s+"


def word_ids(c: Column) -> Column:
    """White-space tokens as non-negative 31-bit ids."""
    return F.transform(words(c), lambda w: F.crc32(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def byte_ids(c: Column) -> Column:
    """UTF-8 bytes as ids 0..255."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def sentences(c: ColumnOrName) -> Column:
    return F.filter(F.split(col(c), SENTENCE_END), lambda s: F.trim(s) != "")


def tokenize(
    df: DataFrame,
    doc: str,
    keys: Sequence[str],
    tokenizer: Tokenizer = word_ids,
    split_sentences: bool = False,
    end_token: int | None = None,
) -> DataFrame:
    """(doc, key, seq_id, tokens, n_tokens): one row per document, or per sentence.

    Sentences without tokens are left out; the end token closes the last sentence and counts in it.
    """
    texts = df.select(doc, F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k) for k in keys]))).alias("key", "text"))
    pieces = sentences("text") if split_sentences else F.array("text")
    lists = F.filter(F.transform(pieces, tokenizer), lambda t: F.size(t) > 0)
    if end_token is not None:
        end = F.array(F.lit(end_token))
        lists = let(lists, lambda ls: F.transform(ls, lambda t, i: F.when(i == F.size(ls) - 1, F.concat(t, end)).otherwise(t)))
    rows = texts.select(doc, "key", F.posexplode(lists).alias("seq_id", "tokens"))
    return rows.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def parallel_tokens(df: DataFrame, doc: str, text: str, tokenizer: Tokenizer = word_ids) -> DataFrame:
    """One sentence per row; an empty sentence is an error."""
    tokens = tokenizer(F.col(text))
    checked = F.when(F.size(tokens) > 0, tokens).otherwise(F.raise_error(F.lit("empty sentence")).cast("array<int>"))
    return df.select(doc, checked.alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("bigint"))


def partition_blocks(df: DataFrame, key: str, n: int, keep_order: bool = False) -> DataFrame:
    """Column ``part``: round robin over n parts, or n blocks of adjacent rows."""
    placed = with_position(df, key, "__pos")
    if keep_order:
        part = F.floor(F.col("__pos") / F.ceil(row_total(df) / n))
    else:
        part = F.pmod(F.col("__pos"), F.lit(n))
    return placed.withColumn("part", part.cast("bigint")).drop("__pos")


def corpus_index(tokens: DataFrame, seq: str, doc: str, item_bytes: int = 4) -> DataFrame:
    """Per sequence: its byte pointer, length and whether it opens a document. ``seq`` is unique."""
    sized = tokens.withColumn("__bytes", F.col("n_tokens") * item_bytes)
    placed = with_position(sized, seq, "seq_pos", sums=["__bytes"])
    first = placed.groupBy(doc).agg(F.min("seq_pos").alias("__first"))
    return placed.join(first, doc).select(
        doc,
        seq,
        "seq_pos",
        "n_tokens",
        F.col("__bytes_before").alias("pointer"),
        (F.col("seq_pos") == F.col("__first")).alias("opens_document"),
    )


def merge_corpora(parts: dict[str, DataFrame], doc: str) -> DataFrame:
    """Corpora joined in name order; document ids follow on from one corpus to the next."""
    out, offset = None, F.lit(0).cast("bigint")
    for name in sorted(parts):
        placed = with_position(parts[name], doc, "merged_doc").withColumn("merged_doc", F.col("merged_doc") + offset)
        offset = offset + row_total(parts[name])
        out = placed if out is None else out.unionByName(placed)
    return out


def parse_split(split: str) -> list[float]:
    """Shares of train, valid and test that sum to 1."""
    weights = [float(p) for p in split.split(",")]
    weights = (weights + [0.0, 0.0, 0.0])[:3]
    total = sum(weights)
    if total <= 0 or min(weights) < 0:
        raise ValueError(f"bad split {split!r}")
    return [w / total for w in weights]


def split_bounds(shares: Sequence[float], overlap: Sequence[float] | None = None) -> list[tuple[float, float] | None]:
    """Book-ends of each split; with a second vector, their overlap (None when empty)."""

    def bounds(weights):
        edges = [0.0]
        for w in weights:
            edges.append(edges[-1] + w)
        return [(a, b) if b > a else None for a, b in zip(edges, edges[1:])]

    mine = bounds(shares)
    if overlap is None:
        return mine
    both = []
    for a, b in zip(mine, bounds(overlap)):
        if a is None or b is None:
            both.append(None)
        else:
            low, high = max(a[0], b[0]), min(a[1], b[1])
            both.append((low, high) if high > low else None)
    return both


def ratio_split(df: DataFrame, key: str, split: str = "99,1,0", overlap: str | None = None) -> DataFrame:
    """Column ``split`` over document order; rows in no split are dropped. Bounds round half to even."""
    bounds = split_bounds(parse_split(split), None if overlap is None else parse_split(overlap))
    total = row_total(df)
    name = F.lit(None).cast("string")
    for label, bound in zip(("train", "valid", "test"), bounds):
        if bound is not None:
            low, high = (F.bround(F.lit(b) * total).cast("bigint") for b in bound)
            name = F.coalesce(name, F.when((F.col("pos") >= low) & (F.col("pos") < high), label))
    placed = with_position(df, key)
    return placed.withColumn("split", name).filter("split is not null")


def document_index(df: DataFrame, doc: str, epochs: int, seed: int = 1234, separate_last: bool = False, sums: Sequence[str] = ()) -> DataFrame:
    """Documents of all epochs in shuffled order, with position and running sums.

    All epochs shuffle together; with ``separate_last`` the last epoch is shuffled by itself, at the end.
    """
    spread = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    last = (F.col("epoch") == epochs - 1) if separate_last and epochs > 1 else F.lit(False)
    hashed = spread.withColumns(
        {"__range": last.cast("int"), "__hash": seeded_hash(seed, "documents", "epoch", doc)}
    ).withColumn("__hi", F.substring("__hash", 1, 4))
    return running_totals(hashed, ["__range", "__hi"], ["__hash", "epoch", doc], sums).drop("__range", "__hash", "__hi")


def needs_separate_last_epoch(n_samples: int, tokens_per_epoch: int, length: int, epochs: int, overlap: int = 1) -> bool:
    """True when the last epoch supplies under 80% of its samples."""
    if epochs == 1:
        return False
    before = ((epochs - 1) * tokens_per_epoch - overlap) // length
    per_epoch = (tokens_per_epoch - overlap) // length
    return n_samples - before < int(0.80 * per_epoch)


def epochs_needed(n_samples: int, tokens_per_epoch: int, length: int, overlap: int = 1) -> int:
    """Smallest number of epochs whose tokens give the samples."""
    return max(1, -(-(n_samples * length + overlap) // tokens_per_epoch))


def token_totals(df: DataFrame, split: str, length: int, n_samples: int, overlap: int = 1) -> DataFrame:
    """Tokens per epoch of each split, and the epochs that ``n_samples`` samples need."""
    return df.groupBy(split).agg(F.sum("n_tokens").alias("tokens_per_epoch")).withColumn(
        "epochs", F.ceil((F.lit(n_samples * length + overlap)) / F.col("tokens_per_epoch"))
    )


def sample_index(
    docs: DataFrame, length: int, overlap: int = 1, keep_partial: bool = False, total: Column | None = None
) -> DataFrame:
    """Spans of the concatenated token stream that make up each sample.

    ``docs`` has (pos, n_tokens, n_tokens_before). Sample j covers stream tokens [jL, jL + L + overlap).
    One row per (sample, document): (sample_id, pos, doc_offset, span). No range join: each document
    names the samples its token range meets.
    """
    total = docs.agg(F.sum("n_tokens")).scalar() if total is None else total
    whole = total - overlap
    n_samples = F.ceil(whole / length) if keep_partial else F.floor(whole / length)
    start, end = F.col("n_tokens_before"), F.col("n_tokens_before") + F.col("n_tokens")
    first = F.greatest(F.floor((start - overlap) / length), F.lit(0))
    last = F.least(F.floor((end - 1) / length), n_samples - 1)
    rows = docs.filter("n_tokens > 0").withColumn("sample_id", F.when(first <= last, F.sequence(first, last)))
    rows = rows.withColumn("sample_id", F.explode("sample_id"))
    low = F.greatest(start, F.col("sample_id") * length)
    high = F.least(end, F.col("sample_id") * length + length + overlap)
    return rows.withColumn("doc_offset", low - start).withColumn("span", high - low).filter("span > 0")


def gather_samples(spans: DataFrame, tokens: DataFrame, doc: str, length: int, pad: int | None = None) -> DataFrame:
    """(sample_id, tokens): the spans of each sample put together in stream order, padded if asked."""
    pieces = spans.join(tokens.select(doc, "tokens"), doc).select(
        "sample_id",
        F.struct(
            "pos",
            F.slice("tokens", (F.col("doc_offset") + 1).cast("int"), F.col("span").cast("int")).alias("t"),
        ).alias("piece"),
    )
    rows = pieces.groupBy("sample_id").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    joined = rows.select("sample_id", F.flatten(F.transform("p", lambda p: p["t"])).alias("tokens"))
    if pad is None:
        return joined
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size("tokens"), F.lit(0)))
    return joined.withColumn("tokens", F.concat("tokens", fill))


def shuffle_index(samples: DataFrame, n_first: Column | int, seed: int = 1234) -> DataFrame:
    """New position of each sample: samples below ``n_first`` shuffle first, the rest after them."""
    first = n_first if isinstance(n_first, Column) else F.lit(n_first)
    hashed = samples.withColumns(
        {"__range": (F.col("sample_id") >= first).cast("int"), "__hash": seeded_hash(seed, "samples", "sample_id")}
    ).withColumn("__hi", F.substring("__hash", 1, 4))
    placed = running_totals(hashed, ["__range", "__hi"], ["__hash", "sample_id"], position="new_pos")
    return placed.drop("__range", "__hash", "__hi")


def loss_positions(
    tokens: ColumnOrName, end_token: int, reset: bool = True, mask_end: bool = True
) -> Column:
    """Array of (segment, position, mask): positions restart after an end token, whose loss is masked."""
    # Place of the last end token before each token, as a running maximum over marked places.
    marks = F.transform(col(tokens), lambda t, i: F.when(t == end_token, i + 1).otherwise(0))

    def build(ends):
        return F.transform(
            col(tokens),
            lambda t, i: F.struct(
                F.get(ends, i)["segment"].alias("segment"),
                (i - F.get(ends, i)["start"] if reset else i).alias("position"),
                F.when((t == end_token) & F.lit(mask_end), 0).otherwise(1).alias("mask"),
            ),
        )

    return let(_runs(marks), build)


def _runs(marks: Column) -> Column:
    """For each place: the end-token count before it and the place after the last one."""
    places = F.filter(marks, lambda m: m > 0)
    bounds = F.concat(F.array(F.lit(0)), places, F.array(F.size(marks)))
    pieces = let(
        bounds,
        lambda b: F.transform(
            F.sequence(F.lit(0), F.size(b) - 2),
            lambda k: F.array_repeat(
                F.struct(k.alias("segment"), F.get(b, k).alias("start")), F.get(b, k + 1) - F.get(b, k)
            ),
        ),
    )
    return F.flatten(pieces)


def chunk_documents(tokens: DataFrame, doc: str, length: int, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, chunk, token_start, token_end): fixed-length pieces of every document, in order."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(length).cast("bigint"))
    rows = tokens.filter("n_tokens > 0").select(doc, *keep, "n_tokens", F.posexplode(starts).alias("chunk", "token_start"))
    return rows.withColumn("token_end", F.least(F.col("token_start") + length, F.col("n_tokens"))).drop("n_tokens")


def chunk_partitions(chunks: DataFrame, doc: str, dataset: str, n_train: Column, ratio: Column, seed: int = 1234) -> DataFrame:
    """Chunks marked train or valid by document position, and a seeded share of train as ``sampled``."""
    train = F.col("doc_pos") < n_train
    unit = seeded_long(seed, "chunks", dataset, doc, "chunk").cast("double") / F.lit(float(2**48))
    return chunks.withColumn("part", F.when(train, "train").otherwise("valid")).withColumn(
        "sampled", train & (unit < ratio)
    )


def limit_length(df: DataFrame, tokens: str, length: int, policy: str) -> DataFrame:
    """Over-long rows: keep the ``left`` or ``right`` end, raise an ``error``, or ``split`` into pieces."""
    t = F.col(tokens)
    if policy == "left":
        return df.withColumn(tokens, F.slice(t, 1, length))
    if policy == "right":
        start = F.greatest(F.size(t) - length, F.lit(0)) + 1
        return df.withColumn(tokens, F.slice(t, start, F.lit(length)))
    if policy == "error":
        failed = F.raise_error(F.concat(F.lit("row is longer than "), F.lit(str(length))))
        return df.withColumn(tokens, F.when(F.size(t) <= length, t).otherwise(failed.cast(df.schema[tokens].dataType)))
    if policy == "split":
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(length))
        return df.withColumn("piece", F.explode(starts)).withColumn(
            tokens, F.slice(t, F.col("piece") + 1, F.lit(length))
        ).withColumn("piece", (F.col("piece") / length).cast("int"))
    raise ValueError(f"unknown policy {policy!r}")


def fixed_length_row(tokens: ColumnOrName, targets: ColumnOrName, length: int, end_token: int, pad: int, ignore: int = -100) -> Column:
    """Struct (input, label, mask) of ``length``: cut, closed by the end token, padded, labels shifted by one."""
    t = F.slice(col(tokens), 1, length)
    y = F.slice(col(targets), 1, length)
    end = F.array(F.lit(end_token))

    def padded(a, filler):
        return F.concat(a, F.array_repeat(F.lit(filler), F.greatest(F.lit(length + 1) - F.size(a), F.lit(0))))

    whole = F.struct(padded(F.concat(t, end), pad).alias("t"), padded(F.concat(y, end), ignore).alias("y"))

    def rows(b):
        label = F.slice(b["y"], 2, length)
        return F.struct(
            F.slice(b["t"], 1, length).alias("input"),
            label.alias("label"),
            F.transform(label, lambda v: (v != ignore).cast("int")).alias("mask"),
        )

    return let(whole, rows)


def rank_shards(df: DataFrame, world: int, micro_batch: int = 1, drop_last: bool = True, consumed: int = 0) -> DataFrame:
    """(rank, batch) by position for data-parallel readers; resume skips consumed rows."""
    per = world * micro_batch
    rows = df.filter(F.col("pos") >= consumed)
    at = F.col("pos") - consumed
    out = rows.withColumns(
        {
            "batch": F.floor(at / per).cast("bigint"),
            "rank": F.floor(F.pmod(at, F.lit(per)) / micro_batch).cast("bigint"),
        }
    )
    if drop_last:
        full = F.floor((row_total(df) - consumed) / per)
        out = out.filter(F.col("batch") < full)
    return out


def stride_shards(df: DataFrame, world: int) -> DataFrame:
    return df.withColumn("rank", F.pmod(F.col("pos"), F.lit(world))).withColumn("at", F.floor(F.col("pos") / world))


def char_count_rows(ids: DataFrame, key: str, low: int, high: int, seed: int = 42) -> DataFrame:
    """Counting exercises, one per id: a word of single letters, the worked answer and the gold count."""

    def draw(salt, n, *more):
        return F.pmod(seeded_long(seed, salt, key, *more), n if isinstance(n, Column) else F.lit(n)).cast("int")

    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), "")
    sized = ids.select(key, (draw("length", high - low + 1) + low).alias("n"), draw("target", 26).alias("target"))
    sized = sized.withColumn("hits", draw("hits", F.col("n")) + 1)
    # A miss is one of the 25 other letters; the seeded key of each place shuffles the word.
    places = F.transform(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: F.struct(
            seeded_hash(seed, "place", key, i).alias("k"),
            F.when(i <= F.col("hits"), F.col("target"))
            .otherwise(F.pmod(F.col("target") + 1 + F.pmod(seeded_long(seed, "miss", key, i), F.lit(25)), F.lit(26)).cast("int"))
            .alias("c"),
        ),
    )
    chars = let(letters, lambda a: F.transform(F.sort_array(places), lambda p: F.get(a, p["c"])))
    words_ = sized.select(key, "hits", F.get(letters, F.col("target")).alias("letter"), chars.alias("chars"))
    word = F.array_join("chars", "-")
    lines = F.transform(
        "chars", lambda c: F.concat(c, F.when(c == F.col("letter"), " = ").otherwise(" != "), F.col("letter"), F.lit("."))
    )
    conclusion = F.concat(F.lit("\\boxed{"), F.col("hits").cast("string"), F.lit("} "), F.col("letter"), F.lit(" in "), word, F.lit("."))
    return words_.select(
        key,
        F.concat(F.lit("How many "), "letter", F.lit(" are there in word "), word, F.lit("?")).alias("prompt"),
        F.concat_ws("\n", F.array_join(lines, "\n"), conclusion).alias("response"),
        F.col("hits").alias("gold"),
    )

