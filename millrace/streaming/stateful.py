"""Structured Streaming forms of the row streams: map, split, pack, queue, staleness, sessions, traces.

Rows of one micro-batch are taken in the order of their sequence column, whatever the number of frames a key comes in;
micro-batches are taken in the order they arrive.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.seeded import seeded_hash
from ..operators.filters import not_longer
from ..operators.packing import best_fit
from ..sources.traces import TraceStore

FRAME_ROWS = 10_000  # rows of a frame that a step sends on


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all input there is, into Parquet."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def map_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch column functions on a stream."""
    return stream.transform(transform)


def batch_writer(stream: DataFrame, path: str, stop_at: int | None = None):
    """Stream writer with a folder for each micro-batch, so a batch that runs again after a stop replaces its own rows.

    ``stop_at`` fails the run once that batch is written and before it counts as done, as a lost driver would.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number == stop_at:
            raise InterruptedError(f"stopped after batch {number}")

    return stream.writeStream.foreachBatch(each)


def _draw(n: int, *salt) -> int:
    """Seeded integer below ``n``: the first 48 bits of an md5, as in ``functions.seeded``."""
    return int(hashlib.md5("|".join(map(str, salt)).encode()).hexdigest()[:12], 16) % n


JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def shuffle_stream(stream: DataFrame, lane: str, order: str, buffer: int, seed: int = 42) -> DataFrame:
    """(lane, place, row): each lane's rows through a shuffle buffer that is carried over micro-batches.

    The buffer fills first; then every row takes the place of a drawn one, which goes on. So a row comes at most ``buffer`` places
    early, and the draws depend on a row's number in its lane only: a run that was stopped gives the order of one that was not.
    What is still held when the input has ended is read by ``open_buffers``. Rows of a lane are taken in ``order`` within a
    micro-batch. The state holds ``buffer`` rows a lane as JSON; deal a stream over more lanes to shuffle it on more tasks.
    """
    if buffer < 1:
        raise ValueError("a buffer holds at least one row")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(names, frames: Iterator[pd.DataFrame], state: GroupState):
        rows, n = state.get if state.exists else ([], 0)
        rows, name = list(rows), names[0]
        sent = []
        place = n - len(rows)
        for some in _texts_in_order(frames, "__order", "__row"):
            for text in some:
                if len(rows) < buffer:
                    rows.append(text)
                else:
                    at = _draw(buffer, seed, "buffer", name, n)
                    sent.append(rows[at])
                    rows[at] = text
                n += 1
            yield pd.DataFrame({lane: [name] * len(sent), "place": range(place, place + len(sent)), "__row": sent})
            place, sent = place + len(sent), []
        state.update((rows, n))

    texts = stream.select(lane, F.col(order).alias("__order"), F.to_json(F.struct(*stream.columns), JSON_TIMES).alias("__row"))
    moved = texts.groupBy(lane).applyInPandasWithState(
        step, f"`{lane}` {kinds[lane]}, place bigint, __row string", "rows array<string>, n bigint", "append", GroupStateTimeout.NoTimeout
    )
    return moved.select(lane, "place", F.from_json("__row", stream.schema, JSON_TIMES).alias("row"))


def open_buffers(spark: SparkSession, checkpoint: str, lane: str, schema: StructType, seed: int = 42) -> DataFrame:
    """(lane, place, row) of the rows still held when a ``shuffle_stream`` has read all its input, in drawn order."""
    held = _open_state(spark, checkpoint).select(F.col(f"key.{lane}").alias(lane), "state.n", F.posexplode("state.rows").alias("at", "__row"))
    drawn = Window.partitionBy(lane).orderBy(seeded_hash(seed, "rest", lane, "at"))
    size = F.count(F.lit(1)).over(Window.partitionBy(lane))
    place = F.col("n") - size + F.row_number().over(drawn) - 1
    return held.select(lane, place.alias("place"), F.from_json("__row", schema, JSON_TIMES).alias("row"))


def _idle_timeout(idle: str | None) -> tuple[int, str]:
    """(milliseconds, timeout kind) of a text like "10 minutes"; none means state waits for more rows.

    A query with a timeout wakes up for it for ever, so it is for running streams, not for
    ``availableNow`` runs.
    """
    if idle is None:
        return 0, GroupStateTimeout.NoTimeout
    number, unit = idle.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]
    return int(number) * seconds * 1000, GroupStateTimeout.ProcessingTimeTimeout


def _ordered(frames: Iterator[pd.DataFrame], order: str, *columns: str) -> pd.DataFrame:
    """Rows of one key in order, with no more than the columns asked for: the key's own name is one object a row."""
    names = list(dict.fromkeys([order, *columns]))
    return pd.concat([pdf[names] for pdf in frames], ignore_index=True).sort_values(order)


def _texts_in_order(frames: Iterator[pd.DataFrame], order: str, text: str) -> Iterator[list]:
    """Lists of at most FRAME_ROWS texts in order; those of the batch are held as one Arrow array, not as objects."""
    orders, texts = [], []
    for pdf in frames:
        orders.append(pdf[order])
        texts.append(pa.array(pdf[text], pa.large_string()))
    at = pd.concat(orders, ignore_index=True).sort_values().index.to_numpy()
    held = pa.concat_arrays(texts)
    del orders, texts
    for i in range(0, len(at), FRAME_ROWS):
        yield held.take(pa.array(at[i : i + FRAME_ROWS])).to_pylist()


def take_split(stream: DataFrame, key: str, order: str, take: int, val: int) -> DataFrame:
    """First ``take`` rows of each key: the first ``val`` as ``val``, the others as ``train``; the rest is dropped."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(name, frames: Iterator[pd.DataFrame], state: GroupState):
        seen = state.get[0] if state.exists else 0
        first: pd.DataFrame | None = None  # of the whole batch; a key's rows come in several frames
        for pdf in frames:
            if seen < take:
                first = pdf if first is None else pd.concat([first, pdf])
                first = first.sort_values(order).head(take - seen)
        if first is not None:
            places = range(seen, seen + len(first))
            seen += len(first)
            yield pd.DataFrame({key: first[key], order: first[order], "split": ["val" if p < val else "train" for p in places]})
        state.update((seen,))

    return stream.select(key, order).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, split string", "seen bigint", "append", GroupStateTimeout.NoTimeout
    )


def pack_stream(stream: DataFrame, lane: str, ident: str, length: str, capacity: int, interval: int = 128, idle: str | None = None):
    """(lane, pack, id, length): packs per lane, in rounds of ``interval`` rows; the last bin waits for more rows.

    A row longer than the capacity has a pack of its own; a null length counts as 0. With ``idle`` (like "10 minutes") a
    lane that stays quiet that long sends on its open bin; when a stream has ended, ``open_packs`` reads the open bins from its
    checkpoint. Deal a stream over more lanes to pack it on more tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    wait, timeout = _idle_timeout(idle)

    def emit(name, packed):
        return pd.DataFrame({lane: name, "pack": [p[0] for p in packed], ident: [p[1] for p in packed], length: [p[2] for p in packed]})

    def step(names, frames: Iterator[pd.DataFrame], state: GroupState):
        name = names[0]
        ids, lengths, number = state.get if state.exists else ([], [], 0)
        waiting = list(zip(ids, lengths))
        if state.hasTimedOut:
            if waiting:
                yield emit(name, [(number, *r) for r in waiting])
            state.remove()
            return
        fresh = _ordered(frames, ident, length)
        lengths = fresh[length].fillna(0)
        alone = lengths > capacity  # as in the batch form, a pack of its own
        packed = [(number + k, i, int(n)) for k, (i, n) in enumerate(zip(fresh[ident][alone], lengths[alone]))]
        number += len(packed)
        ids, lengths = fresh[ident][~alone], lengths[~alone].astype("int64")
        for at in range(0, len(ids), interval):
            some = slice(at, at + interval)
            pool = waiting + list(zip(ids.iloc[some].tolist(), lengths.iloc[some].tolist()))
            bins = best_fit([n for _, n in pool], capacity)
            last = max(bins)
            packed += [(number + b, *r) for r, b in zip(pool, bins) if b < last]
            waiting = [r for r, b in zip(pool, bins) if b == last]
            number += last
            if len(packed) >= FRAME_ROWS:  # many packs a frame
                yield emit(name, packed)
                packed = []
        if packed:
            yield emit(name, packed)
        state.update(([r[0] for r in waiting], [r[1] for r in waiting], number))
        if wait:
            state.setTimeoutDuration(wait)

    return stream.select(lane, ident, length).groupBy(lane).applyInPandasWithState(
        step,
        f"`{lane}` {kinds[lane]}, pack bigint, `{ident}` {kinds[ident]}, `{length}` bigint",
        f"ids array<{kinds[ident]}>, lengths array<bigint>, number bigint",
        "append",
        timeout,
    )


def _open_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, state) of a stateful stream that has ended, from its checkpoint."""
    kept = spark.read.format("statestore").load(checkpoint)
    return kept.select("key", F.col("value.groupState").alias("state")).filter("state is not null")


def open_packs(spark: SparkSession, checkpoint: str, lane: str, ident: str, length: str) -> DataFrame:
    """(lane, pack, id, length) of the bins still open when a ``pack_stream`` has read all its input."""
    pairs = _open_state(spark, checkpoint).select(
        F.col(f"key.{lane}").alias(lane), F.col("state.number").alias("pack"), F.explode(F.arrays_zip("state.ids", "state.lengths")).alias("p")
    )
    return pairs.select(lane, "pack", F.col("p.ids").alias(ident), F.col("p.lengths").alias(length))


def open_sessions(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, session, turns) of the sessions still open when a ``session_stream`` has read all its input."""
    kept = _open_state(spark, checkpoint).filter(F.size("state.turns") > 0)
    return kept.select(F.col(f"key.{key}").alias(key), F.col("state.number").alias("session"), F.col("state.turns").alias("turns"))


def bounded_queue(stream: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """(key, kept, produced, dropped) after each batch: a queue of the newest ``capacity`` items per key."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(names, frames: Iterator[pd.DataFrame], state: GroupState):
        items, produced, dropped = state.get if state.exists else ([], 0, 0)
        newest: list = []  # of the whole batch; a key's rows come in several frames
        for pdf in frames:
            produced += len(pdf)
            newest = heapq.nlargest(capacity, newest + list(pdf[order]))
        items = (list(items) + newest[::-1])[-capacity:]
        dropped = produced - len(items)
        state.update((items, produced, dropped))
        yield pd.DataFrame({key: [names[0]], "kept": [items], "produced": [produced], "dropped": [dropped]})

    return stream.select(key, order).groupBy(key).applyInPandasWithState(
        step,
        f"`{key}` {kinds[key]}, kept array<{kinds[order]}>, produced bigint, dropped bigint",
        f"items array<{kinds[order]}>, produced bigint, dropped bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def fresh_enough(current_version: Column, produced_version: Column, limit: int) -> Column:
    return current_version - produced_version <= limit


def staleness(stream: DataFrame, key: str, order: str, version: str, limit: int) -> DataFrame:
    """Rows with their lag behind the newest parameter version seen so far, and whether it is within the limit."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(name, frames: Iterator[pd.DataFrame], state: GroupState):
        newest = state.get[0] if state.exists else 0
        pdf = _ordered(frames, order, version)
        for at in range(0, len(pdf), FRAME_ROWS):
            some = pdf.iloc[at : at + FRAME_ROWS]
            running = some[version].cummax().clip(lower=newest)
            newest = int(running.iloc[-1])
            lag = (running - some[version]).astype("int64")
            yield pd.DataFrame({key: name[0], order: some[order], "lag": lag, "is_fresh": lag <= limit})
        state.update((newest,))

    return stream.select(key, order, F.col(version).cast("bigint").alias(version)).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, lag bigint, is_fresh boolean", "newest bigint", "append",
        GroupStateTimeout.NoTimeout,
    )


def ingest_traces(stream: DataFrame, ident: str, when: str, delay: str = "1 hour") -> DataFrame:
    """Traces once each. The watermark bounds the ids kept in state; it is an addition of this library."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark([ident])


def trace_writer(stream: DataFrame, store: TraceStore, replace: bool = False):
    """Stream writer that appends traces and their session rows; a batch that runs again adds nothing.

    Micro-batch N is append N of the store, so the stream is its only writer.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: store.append(batch, number, replace))


def generated_rows_writer(stream: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, n_tokens: Column, limit: int):
    """Stream writer that appends the rows generated from each batch, over-long ones left out."""

    def each(batch: DataFrame, number: int) -> None:
        made = generate(batch).filter(not_longer(n_tokens, limit))
        # A batch that runs again replaces its own rows.
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each)


def session_stream(stream: DataFrame, key: str, order: str, marker: str, turn: str, idle: str | None = None):
    """(key, session, turns) of each finished session; a row with ``marker`` true opens the next one.

    The open session waits in state until a marker row, or the ``idle`` time where one is given; when a stream has ended,
    ``open_sessions`` reads it from the checkpoint. A session is one row, so it must fit in one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    wait, timeout = _idle_timeout(idle)

    def emit(name, number, turns):
        return pd.DataFrame({key: [name], "session": [number], "turns": [turns]})

    def step(names, frames: Iterator[pd.DataFrame], state: GroupState):
        turns, number = state.get if state.exists else ([], 0)
        turns = list(turns)
        if state.hasTimedOut:
            if turns:
                yield emit(names[0], number, turns)
            state.update(([], number + 1 if turns else number))
            return
        pdf = _ordered(frames, order, "__marker", "__turn")
        for opens, text in zip(pdf["__marker"], pdf["__turn"]):
            if opens and turns:
                yield emit(names[0], number, turns)
                turns, number = [], number + 1
            turns.append(text)
        state.update((turns, number))
        if wait:
            state.setTimeoutDuration(wait)

    rows = stream.select(key, order, F.col(marker).alias("__marker"), F.col(turn).alias("__turn"))
    return rows.groupBy(key).applyInPandasWithState(
        step,
        f"`{key}` {kinds[key]}, session bigint, turns array<{kinds[turn]}>",
        f"turns array<{kinds[turn]}>, number bigint",
        "append",
        timeout,
    )
