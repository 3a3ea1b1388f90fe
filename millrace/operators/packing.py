"""Packing rows into bins of a fixed length, and balancing row lengths over partitions.

Packing works on (id, length) pairs in groups of bounded size, so a task sees a fixed number of pairs
and the token arrays are joined only afterwards.
"""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .ordering import row_total, with_position

ROUND_ROWS = 1000

# Cost of a sequence as a function of its length, a * length + length ** 2.
LINEAR_COST = 24576


def workload(length: Column | str) -> Column:
    return col(length) * LINEAR_COST + col(length) * col(length)


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin number of each item: longest first, each into the fullest bin that still takes it."""
    bins: list[int] = [0] * len(lengths)
    open_bins: list[tuple[int, int]] = []  # (free space, bin number), sorted
    n = 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect.bisect_left(open_bins, (lengths[i], -1))
        if at < len(open_bins):
            free, number = open_bins.pop(at)
        else:
            free, number = capacity, n
            n += 1
        bins[i] = number
        if free - lengths[i] > 0:
            bisect.insort(open_bins, (free - lengths[i], number))
    return bins


def largest_first(lengths: list[int], capacity: int) -> list[int]:
    """Bin number of each item: fill one bin at a time with the largest item that fits.

    Items wait in one pile per length; going down the lengths once fills a bin, since free space only shrinks.
    """
    piles: dict[int, list[int]] = {}
    for item, length in enumerate(lengths):
        piles.setdefault(length, []).append(item)
    if max(piles, default=0) > capacity:
        raise ValueError(f"item of length {max(piles)} is over the bin length {capacity}")
    bins, number = [0] * len(lengths), 0
    while piles:
        free = capacity
        for length in sorted(piles, reverse=True):
            fits = len(piles[length]) if length <= 0 else min(len(piles[length]), free // length)
            for _ in range(fits):
                bins[piles[length].pop()] = number
            free -= fits * length
            if not piles[length]:
                del piles[length]
        number += 1
    return bins


def _packed(groups: DataFrame, key: str, length: str, capacity: int, rule) -> DataFrame:
    kind = groups.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        bins = rule([int(v) for v in pdf[length]], capacity)
        out = pdf[[key, "__group", length]].copy()
        out["__bin"] = bins
        # Only the bin opened last can be far from full.
        last = max(bins)
        out["__open"] = [b == last for b in bins]
        return out

    schema = f"`{key}` {kind}, __group bigint, `{length}` bigint, __bin bigint, __open boolean"
    return groups.select(key, "__group", "__pos", F.col(length).cast("bigint").alias(length)).groupBy("__group").applyInPandas(pack, schema)


def pack_rows(df: DataFrame, key: str, length: str, capacity: int, carry_rounds: int = 1) -> DataFrame:
    """(key, length, pack): best-fit packs of total length within the capacity.

    Each group of 1000 rows is packed by itself; the rows of its last bin go through the next round
    with the last bins of other groups. A row longer than the capacity has a pack of its own.
    """
    rows = df.select(key, F.col(length).cast("bigint").alias(length))
    done = None
    for turn in range(carry_rounds + 1):
        placed = with_position(rows, key, "__pos").withColumn("__group", F.floor(F.col("__pos") / ROUND_ROWS))
        packed = cut_lineage(_packed(placed, key, length, capacity, best_fit))  # read for its packs and for the next round
        last = turn == carry_rounds
        kept = packed if last else packed.filter("not __open")
        named = kept.select(key, length, F.concat_ws("-", F.lit(str(turn)), "__group", "__bin").alias("pack"))
        done = named if done is None else done.unionByName(named)
        rows = packed.filter("__open").select(key, length)
    return done


def knapsack_rows(df: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """(key, length, pack): largest-fitting-first packs per group of 1000 rows; an over-long row raises."""
    placed = with_position(df.select(key, length), key, "__pos").withColumn(
        "__group", F.floor(F.col("__pos") / ROUND_ROWS)
    )
    packed = _packed(placed, key, length, capacity, largest_first)
    return packed.select(key, length, F.concat_ws("-", "__group", "__bin").alias("pack"))


def differencing(costs: list[int], k: int, equal_size: bool = False) -> list[int]:
    """Partition number of each item by the largest differencing method.

    With ``equal_size`` items enter k at a time, so every partition gets the same number of them.
    """
    order = sorted(range(len(costs)), key=lambda i: costs[i])
    blocks = []
    if equal_size:
        if len(costs) % k:
            raise ValueError("item count is not a multiple of the partition count")
        blocks = [[[i] for i in order[at : at + k]] for at in range(0, len(order), k)]
    else:
        blocks = [[[i]] + [[] for _ in range(k - 1)] for i in order]

    def total(items):
        return sum(costs[i] for i in items)

    heap = []
    for n, block in enumerate(blocks):
        parts = sorted(((total(p), p) for p in block), key=lambda e: -e[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    serial = len(blocks)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Heaviest of one side joins the lightest of the other.
        merged = sorted(((x + y, p + r) for (x, p), (y, r) in zip(a, reversed(b))), key=lambda e: -e[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), serial, merged))
        serial += 1
    out = [0] * len(costs)
    for number, (_, items) in enumerate(heap[0][2] if heap else []):
        for i in items:
            out[i] = number
    return out


def _balanced(df: DataFrame, batch: str, key: str, length: str, assign) -> DataFrame:
    kind, batch_kind = (df.schema[c].dataType.simpleString() for c in (key, batch))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        lengths = [int(v) for v in pdf[length]]
        out = pdf[[batch, key, length]].copy()
        out["part"] = assign(lengths, [LINEAR_COST * n + n * n for n in lengths])
        return out

    schema = f"`{batch}` {batch_kind}, `{key}` {kind}, `{length}` bigint, part bigint"
    rows = df.select(batch, key, F.col(length).cast("bigint").alias(length))
    return rows.groupBy(batch).applyInPandas(split, schema)


def balanced_partitions(df: DataFrame, batch: str, key: str, length: str, k: int, equal_size: bool = False):
    """Rows of each batch over k partitions of like workload. A batch is of bounded size."""
    return _balanced(df, batch, key, length, lambda lengths, costs: differencing(costs, k, equal_size))


def micro_batches(df: DataFrame, batch: str, key: str, length: str, max_tokens: int) -> DataFrame:
    """Rows of each batch over as few micro-batches as its tokens need at ``max_tokens`` each, balanced."""

    def assign(lengths, costs):
        if lengths and max(lengths) > max_tokens:
            raise ValueError("a row is longer than the token limit")
        k = max(1, min(len(lengths), -(-sum(lengths) // max_tokens)))
        while True:
            parts = differencing(costs, k)
            sums = [0] * k
            for n, p in zip(lengths, parts):
                sums[p] += n
            if max(sums, default=0) <= max_tokens or k >= len(lengths):
                return parts
            k += 1

    return _balanced(df, batch, key, length, assign)


def snake_partitions(df: DataFrame, key: str, length: str, k: int) -> DataFrame:
    """Whole-table balance without groups: rows by falling length, dealt forward and back over k parts."""
    from .ordering import with_value_position

    placed = with_value_position(df, length, key, "__rank")
    at = row_total(df) - 1 - F.col("__rank")
    turn, seat = F.floor(at / k), F.pmod(at, F.lit(k))
    return placed.withColumn("part", F.when(F.pmod(turn, F.lit(2)) == 0, seat).otherwise(k - 1 - seat)).drop("__rank")


def pack_members(packs: DataFrame, key: str) -> DataFrame:
    """Place of each row inside its pack."""
    return packs.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(key)) - 1)
