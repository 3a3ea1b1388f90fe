"""Lookups and joins. Spark chooses broadcast or shuffle by size; skewed keys are split by adaptive joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.seeded import seeded_long
from .ordering import row_total, with_shuffled_position


def judge_predictions(predictions: DataFrame, golds: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """Predictions next to their gold answer, with ``correct``."""
    return predictions.join(golds, key).withColumn("correct", F.coalesce(F.col(prediction) == F.col(gold), F.lit(False)))


def session_traces(
    traces: DataFrame,
    bridge: DataFrame,
    sessions: Sequence[str] | DataFrame | None = None,
    since: float | None = None,
    types: Sequence[str] | None = None,
    namespaces: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct traces of the sessions, newest first. ``since`` prunes the bridge as well as the traces."""
    rows = traces
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if types:
        rows = rows.filter(F.col("context_type").isin(list(types)))
    if namespaces:
        rows = rows.filter(F.col("namespace").isin(list(namespaces)))
    if sessions is not None:
        links = bridge if since is None else bridge.filter(F.col("created_at") >= since)
        if isinstance(sessions, DataFrame):
            links = links.join(sessions.select("session_uid"), "session_uid", "left_semi")
        else:
            links = links.filter(F.col("session_uid").isin(list(sessions)))
        rows = rows.join(links.select(F.col("trace_id").alias("id")), "id", "left_semi")
    if limit is None:
        return rows
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def trace_sessions(bridge: DataFrame, trace_id) -> DataFrame:
    return bridge.filter(F.col("trace_id") == trace_id).select("session_uid").distinct()


def drop_tasks(rows: DataFrame, dropped: DataFrame, task: str) -> DataFrame:
    return rows.join(dropped.select(task), task, "left_anti")


def surviving_steps(steps: DataFrame, last_steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps before the last of trajectories whose last step is still there."""
    return steps.filter(~F.col("is_last")).join(last_steps.select(*keys), list(keys), "left_semi")


def with_continuations(neighbours: DataFrame, chunks: DataFrame, n_chunks: Column, length: int, unpack: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query, neighbours): each neighbour chunk followed by the next chunks of the database, wrapping at its end.

    ``neighbours`` has (query, rank, neighbour); ``chunks`` has (chunk_id, tokens). A query keeps its k
    saved neighbours, so its arrays are of bounded size. Tokens may be kept in a denser form than an array, like a text, of which
    ``unpack`` makes the array once they are with their query.
    """
    unpack = unpack or (lambda tokens: tokens)
    wanted = neighbours.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(
        "chunk_id", F.pmod(F.col("neighbour") + F.col("part"), n_chunks)
    )
    joined = wanted.join(chunks, "chunk_id")
    # Tokens are shuffled once more, to their query, with all its neighbours' pieces in one array.
    pieces = F.sort_array(F.collect_list(F.struct("rank", "neighbour", "part", "tokens")))

    def put_together(pieces):
        def one(head):
            own = F.filter(pieces, lambda p: p["rank"].eqNullSafe(head["rank"]) & p["neighbour"].eqNullSafe(head["neighbour"]))
            tokens = F.flatten(F.transform(own, lambda p: unpack(p["tokens"])))
            return F.struct(head["rank"].alias("rank"), head["neighbour"].alias("neighbour"), tokens.alias("tokens"))

        heads = F.array_distinct(F.transform(pieces, lambda p: F.struct(p["rank"].alias("rank"), p["neighbour"].alias("neighbour"))))
        return F.transform(heads, one)

    return joined.groupBy("query").agg(pieces.alias("__pieces")).select("query", let(F.col("__pieces"), put_together).alias("neighbours"))


def sample_negatives(df: DataFrame, key: str, positives: str, n: int, seed: int = 42) -> DataFrame:
    """(key, negatives): n responses of other rows that are none of the row's own.

    The pool holds each distinct response once, in seeded order. A row reads it from a seeded place on;
    reading n places more than it has own responses always yields n others when the pool has them.
    """
    pool = df.select(F.explode(positives).alias("response")).distinct()
    placed = with_shuffled_position(pool, seed, "pool", "response", position="__at")
    total = row_total(pool)
    own = F.coalesce(F.col(positives), F.array().cast(df.schema[positives].dataType)).alias(positives)
    df = df.select(key, own)
    need = F.least(F.lit(n).cast("bigint") + F.size(positives), total)
    reads = df.select(key, positives, F.pmod(seeded_long(seed, "negatives", key), total).alias("__start"), need.alias("__need"))
    reads = reads.filter("__need > 0").withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__need") - 1)))
    found = reads.withColumn("__at", F.pmod(F.col("__start") + F.col("__k"), total)).join(placed, "__at")
    others = found.filter(~F.array_contains(positives, F.col("response")))
    # At most n + own responses rows per key reach this window.
    kept = others.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__k"))).filter(F.col("__r") <= n)
    chosen = kept.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__r", "response"))), lambda p: p["response"]).alias("negatives")
    )
    # A row for which nothing is left keeps an empty array.
    return df.select(key).join(chosen, key, "left").withColumn(
        "negatives", F.coalesce("negatives", F.array().cast(chosen.schema["negatives"].dataType))
    )


def with_existing_media(df: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Rows whose media file is in the listing (a ``path`` column; file contents are not read)."""
    return df.join(listing.select(F.col("path").alias(path)), path, "left_semi")
