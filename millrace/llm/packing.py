"""Best-fit packing of token pieces into sequences by bulk-synchronous sweeps.

Only documents longer than a sequence are cut: full pieces fill sequences of their own, the first piece
takes what is left over. The remaining pieces are sorted by length and the gaps of open sequences by size. One sweep gives
every gap at most one piece: going down in size, each length takes the smallest gap above it that is still
free, so pieces and gaps match like brackets. Pieces of one length are interchangeable and so are gaps of one
size, so a sweep handles runs of them; the rank of a piece among those of its length decides which gap
of the run it gets. Then the gaps shrink and the sweep is repeated. Pieces that fit in no gap open new sequences, as many as
their total length needs at least.

Lengths are at most ``capacity``, so the runs are bounded by the capacity and the number of sweeps whatever the
number of documents; only the count per length reaches the driver. Ranks and placements stay distributed.

Defined results: a null text is empty; an empty text is its end id alone; repeated rows are documents of their own;
an empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Encoder, encoder, joined_batches, per_batch, stored

CAPACITY = 2048
END_ID = 0


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, ids followed by the end id."""

    def run(batch: pa.RecordBatch):
        rows = []
        offsets, ids = encoder(vocabulary).encode(batch.column("text"), end_id)
        view, bounds = memoryview(ids).cast("B"), offsets.tolist()
        for doc_id, start, stop in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:]):
            n = stop - start
            cuts = [0, *range(n % capacity or capacity, n, capacity), n]
            rows += [
                (doc_id, i, a, b - a, zlib.crc32(view[4 * (start + a) : 4 * (start + b)])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
            ]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        ) if rows else None

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(joined_batches(run, Encoder.GROUP_BYTES), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Run:
    """``count`` sequences from number ``first`` on, all filled up to ``fill``."""

    __slots__ = ("count", "fill", "first")

    def __init__(self, first: int, count: int, fill: int):
        self.first, self.count, self.fill = first, count, fill


def sweeps(counts: Iterable[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, count, first sequence, offset) for ``counts`` of pieces by length; sequences used."""
    left = {int(length): int(n) for length, n in counts if n}
    rank = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    open_runs: list[_Run] = []
    opened = 0

    def place(length: int, n: int, first: int, fill: int) -> _Run:
        placed.append((length, rank[length], n, first, fill))
        rank[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        return _Run(first, n, fill + length)

    while left:
        # one sweep, from large to small: free gaps form a stack with the smallest on top
        gaps = sorted((r for r in open_runs if r.fill < capacity), key=lambda r: (r.fill, r.first))
        free: list[_Run] = []
        after: list[_Run] = []
        at = 0
        for length in sorted(left, reverse=True):
            while at < len(gaps) and capacity - gaps[at].fill >= length:
                free.append(gaps[at])
                at += 1
            while free and length in left:
                run = free[-1]
                n = min(run.count, left[length])
                after.append(place(length, n, run.first, run.fill))
                if n == run.count:
                    free.pop()
                else:
                    free[-1] = _Run(run.first + n, run.count - n, run.fill)
        smallest = min(left, default=capacity + 1)
        open_runs = [r for r in (*after, *free, *gaps[at:]) if capacity - r.fill >= smallest]
        widest = max((capacity - r.fill for r in open_runs), default=0)
        homeless = sorted((length for length in left if length > widest), reverse=True)
        new = -(-sum(length * left[length] for length in homeless) // capacity)
        for length in homeless:  # the largest of them open the new sequences
            n = min(new, left[length])
            if n:
                open_runs.append(place(length, n, opened, 0))
                opened += n
                new -= n
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Full pieces have negative sequence numbers."""
    table = stored(pieces.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "pieces")
    full = table.filter(F.col("length") == capacity)
    short = table.filter(F.col("length") < capacity)
    by_part = short.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    counts = [(r["length"], r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()]  # at most one row per length
    placed, _ = sweeps(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__part").orderBy("__at")
    ranked = short.join(starts, ["length", "__part"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    lengths, ranks = placed[:, 0], placed[:, 1]
    wide = int(ranks.max(initial=0)) + 1
    shared = table.sparkSession.sparkContext.broadcast((lengths * wide + ranks, placed, wide))
    names = [c for c in pieces.columns]

    def run(batch: pa.RecordBatch):
        keys, runs, width = shared.value
        length = batch.column("length").to_numpy()
        rank = batch.column("__rank").to_numpy()
        at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
        return pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])],
            [*names, "sequence_id", "offset"],
        )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    fitted = ranked.mapInArrow(per_batch(run), f"{kinds}, sequence_id long, offset long")
    alone = full.select(*names, (-1 - F.col("__at")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return fitted.unionByName(alone)
