"""Quotation linking: conversations in reply order, without quotes.

Messages are cut into their own text and quoted passages with nesting levels. Own passages (the whole text, its paragraphs
and its lines) and quoted ones are normalised and hashed; a quoted hash is joined to the first message that wrote it,
in the same conversation if there is an earlier one, else in any other one. Short lines that are neither a paragraph nor a whole
text are joined inside their conversation only. The reply's parent is the original of its outermost quote with
the most matched characters; without a linked quote it is the turn before. Reply order puts messages behind the message of
their conversation that they answer (``reply_order``).

Originals are one row per (conversation, hash), or per hash with the first ones of two conversations, before the join, so a passage that many messages share meets its
quotes once. Positions count turns in buckets of TURNS, so a conversation of any length is many small windows.

Defined results: a null text is empty; null conversation ids are one conversation; rows that share a conversation and a turn are
parts of one turn, ordered by role and text, with the same links; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import reply_order
from .common import per_batch, stored

TURNS = 1024
LINE_CHARS = 20  # shorter lines are too common to link different conversations
_QUOTE = re.compile(r"((?:[ \t]{0,3}>)+)[ \t]?(.*)", re.S)
_SAID = re.compile(r"\s*(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)\s*:\s*", re.I)


def _digest(text: str) -> str | None:
    plain = " ".join(text.lower().split())
    return xxhash.xxh3_128_hexdigest(plain) if plain else None


def passages(text: str) -> dict[str, tuple[int, bool]]:
    """Hash of a whole text, its paragraphs and its lines, with the length and whether it is only a short line."""
    lines = [line for line in text.split("\n") if line.strip()]
    parts = [(part, False) for part in (text, *re.split(r"\n[ \t]*\n", text))] + [(line, len(line.strip()) < LINE_CHARS) for line in lines]
    found = {}
    for part, short in parts:
        digest = _digest(part)
        if digest:
            found[digest] = (len(" ".join(part.split())), short and found.get(digest, (0, True))[1])
    return found


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, passage) of each run of lines at one quote level. A line that only announces a quote goes."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last = 0
    for line in re.split(r"\r\n|\r|\n", text or ""):
        m = _QUOTE.fullmatch(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last:
            quotes[-1][1].append(m[2])
        else:
            if not last and own and _SAID.fullmatch(own[-1]):
                own.pop()
            quotes.append((level, [m[2]]))
        last = level
    body = "\n".join(own)
    return (body.strip("\n") if quotes else text or ""), [(level, "\n".join(lines)) for level, lines in quotes]


PARSED = (
    "conv_id long, turn long, role string, text string, own array<struct<hash: string, short: boolean>>, n_quotes int, "
    "quoted array<struct<level: int, hash: string, chars: int, short: boolean>>"
)


def parse_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text without quotes, own, n_quotes, quoted) of every message."""
    passage = pa.list_(pa.struct([("hash", pa.string()), ("short", pa.bool_())]))
    quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("chars", pa.int32()), ("short", pa.bool_())]))

    def run(batch: pa.RecordBatch):
        texts, own, counts, quoted = [], [], [], []
        for text in batch.column("text").to_pylist():
            body, quotes = split_quotes(text)
            texts.append(body)
            own.append([{"hash": h, "short": short} for h, (_, short) in passages(body).items()])
            counts.append(len(quotes))
            quoted.append([{"level": lv, "hash": h, "chars": n, "short": short} for lv, q in quotes for h, (n, short) in passages(q).items()])
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(texts, pa.string()), pa.array(own, passage), pa.array(counts, pa.int32()), pa.array(quoted, quote)],
            ["conv_id", "turn", "role", "text", "own", "n_quotes", "quoted"],
        )

    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn")]
    columns += [F.col(c).cast("string").alias(c) for c in ("role", "text")]
    return messages.select(*columns).mapInArrow(per_batch(run), PARSED)


def _links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, parent_conv, parent_turn) of messages with a linked quote."""
    quotes = parsed.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.chars", "q.short").distinct()
    wanted = quotes.select("hash").distinct()
    own = parsed.select("conv_id", "turn", F.explode("own").alias("o")).select("conv_id", "turn", "o.hash", "o.short").join(wanted, "hash", "left_semi")
    long = F.when(~F.col("short"), F.struct("conv_id", "turn"))
    inside = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("in_turn"), F.min(long).alias("original"))
    # The first originals of two conversations: one of them is not the quoting conversation. Spark cuts to two before the shuffle.
    order = Window.partitionBy("hash").orderBy("original")
    firsts = inside.filter("original is not null").select("hash", "original", F.row_number().over(order).alias("nth")).filter("nth <= 2")
    anywhere = firsts.groupBy("hash").agg(F.min("original").alias("first"), F.max(F.when(F.col("nth") == 2, F.col("original"))).alias("second"))
    near = inside.select(F.col("conv_id").alias("i_conv"), F.col("hash").alias("i_hash"), "in_turn")
    met = quotes.join(near, (F.col("hash") == F.col("i_hash")) & F.col("conv_id").eqNullSafe(F.col("i_conv")), "left").join(anywhere, "hash", "left")
    earlier = F.col("in_turn") < F.col("turn")
    other = F.when(F.col("first").isNotNull() & F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    original = F.when(earlier, F.struct("conv_id", F.col("in_turn").alias("turn"))).when(~F.col("short"), other)
    found = met.withColumn("original", original).filter("original is not null")
    per_original = found.groupBy("conv_id", "turn", "original").agg(
        F.max("chars").alias("chars"), F.min("level").alias("level"), F.countDistinct("hash").alias("hashes")
    )
    better = F.struct(
        -F.col("level"), F.col("chars"), F.col("original.conv_id").eqNullSafe(F.col("conv_id")), F.col("original.turn"), F.col("original.conv_id")
    )
    return per_original.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).cast("int").alias("n_linked"), F.max_by("original", better).alias("parent")
    ).select("conv_id", "turn", "n_linked", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, position, reply_position, turn, role, text, n_quotes, n_linked, parent_conv, parent_turn) of every message.

    ``position`` counts from 0 in the order of turns, ``reply_position`` in reply order: a message, then all that answers it, answers by
    turn. A message whose original is in another conversation, or is not found, answers the turn before.
    """
    parsed = stored(parse_messages(messages), "parsed-messages")
    found = stored(_links(parsed), "reply-links")
    moved = reply_order.moves(parsed, found)
    links = found.select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), "n_linked", "parent_conv", "parent_turn")
    rows = parsed.select("conv_id", "turn", "role", "text", "n_quotes").withColumn("bucket", F.floor(F.col("turn") / TURNS))
    turns = rows.select("conv_id", "bucket", "turn").distinct()
    before_turn = Window.partitionBy("conv_id", "bucket").orderBy("turn")
    inside = turns.withColumn("own_before", F.lag("turn").over(before_turn))
    per_bucket = rows.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    order = Window.partitionBy("conv_id").orderBy("bucket")
    starts = per_bucket.select(
        F.col("conv_id").alias("s_conv"), F.col("bucket").alias("s_bucket"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.lag("last").over(order).alias("last_before"),
    )
    place = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", F.xxhash64("text"), "text")
    numbered = rows.withColumn("inside", F.row_number().over(place) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("s_conv")) & F.col("bucket").eqNullSafe(F.col("s_bucket"))
    placed = numbered.join(starts, same)
    turn_before = inside.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), "own_before")
    placed = placed.join(turn_before, F.col("conv_id").eqNullSafe(F.col("p_conv")) & F.col("turn").eqNullSafe(F.col("p_turn")))
    placed = placed.join(links, F.col("conv_id").eqNullSafe(F.col("l_conv")) & F.col("turn").eqNullSafe(F.col("l_turn")), "left")
    default = F.coalesce("own_before", "last_before")
    linked = F.col("n_linked").isNotNull()
    shift = F.lit(0)
    if moved is not None:
        moved = moved.select(F.col("conv_id").alias("m_conv"), F.col("turn").alias("m_turn"), "shift")
        same = F.col("conv_id").eqNullSafe(F.col("m_conv")) & F.col("turn").eqNullSafe(F.col("m_turn"))
        placed, shift = placed.join(moved, same, "left"), F.coalesce("shift", F.lit(0))
    return placed.select(
        "conv_id",
        (F.col("start") + F.col("inside")).cast("bigint").alias("position"),
        (F.col("start") + F.col("inside") + shift).cast("bigint").alias("reply_position"),
        "turn",
        "role",
        "text",
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.when(linked, F.col("parent_conv")).when(default.isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(linked, F.col("parent_turn")).otherwise(default).alias("parent_turn"),
    )
