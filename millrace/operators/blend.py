"""Weighted mixing of datasets by closed form: no sort, no loop, no shuffle for the positions.

Item k of dataset i is due at (k + 1/2) / w_i. Its place in the mix is the number of items of all
datasets due before it (ties go to the dataset listed first), which is plain integer arithmetic on k.
The order keeps every prefix within two items of each dataset's share; it is not the order a sequential
largest-deficit loop gives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ITEMS = 1 << 16


def parse_blend(entries: Sequence[str]) -> tuple[list[str], list[float] | None]:
    """(names, weights) of "w1 name1 w2 name2 ..", or of names alone (no weights)."""
    entries = list(entries)
    if len(entries) == 1:
        return entries, None
    try:
        weights = [float(w) for w in entries[::2]] if len(entries) % 2 == 0 else None
    except ValueError:
        weights = None
    if weights is None:
        return entries, None
    return [name.strip() for name in entries[1::2]], weights


def normalise_weights(weights: Sequence[float]) -> list[float]:
    total = math.fsum(weights)
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return [w / total for w in weights]


def integer_weights(weights: Sequence[float]) -> list[int]:
    """The smallest whole numbers in the exact proportion of the given decimals."""
    exact = [Fraction(str(w)) for w in weights]
    if sum(exact) <= 0 or min(exact) < 0:
        raise ValueError("weights must not be negative, and have a positive sum")
    scale = math.lcm(*[w.denominator for w in exact])
    units = [int(w * scale) for w in exact]
    common = math.gcd(*units)
    units = [u // common for u in units]
    if max(units) >= 2**63:
        raise ValueError("the weights need more digits than 64-bit numbers hold")
    return units


def dataset_sizes(weights: Sequence[float], target: int, surplus: float = 0.0) -> list[int]:
    """Samples to build per dataset for a blend of ``target`` samples."""
    return [math.ceil(math.ceil(target * w) * (1 + surplus)) for w in normalise_weights(weights)]


def _place(units: Sequence[int], limits: Sequence[int] | None, kind: str) -> Column:
    """Items of all datasets due before item ``item`` of dataset ``dataset_index``, whose weight is ``unit``."""
    due = (F.col("item") * 2 + 1).cast(kind)
    place = F.col("item")
    for j, unit in enumerate(units):
        if unit == 0:
            continue
        tie = F.when(F.col("dataset_index") > j, 0).otherwise(1).cast(kind)
        # Odd numbers up to ``bound`` are the items of dataset j due before this one.
        bound = F.call_function("div", due * F.lit(unit).cast(kind) - tie, F.col("unit").cast(kind))
        earlier = F.floor((bound + 1) / 2).cast("bigint")
        if limits is not None:
            earlier = F.least(earlier, F.lit(limits[j]))
        place = place + F.when(F.col("dataset_index") == j, 0).otherwise(earlier)
    return place


def _grid(spark: SparkSession, names, counts, units, limits) -> DataFrame:
    kind = "bigint" if (2 * max(counts) + 1) * max(units) < 2**62 else "decimal(38,0)"
    config = [(name, i, u, n) for i, (name, u, n) in enumerate(zip(names, units, counts)) if n > 0]
    datasets = spark.createDataFrame(config, "dataset string, dataset_index int, unit bigint, n bigint")
    # Blocks of items are dealt out first, so a large dataset fills many tasks.
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(BLOCK_ITEMS).cast("bigint"))
    blocks = datasets.withColumn("start", F.explode(starts)).repartition("dataset_index", "start")
    stop = F.least(F.col("start") + BLOCK_ITEMS, F.col("n")) - 1
    items = blocks.withColumn("item", F.explode(F.sequence(F.col("start"), stop)))
    return items.select("dataset", "dataset_index", "item", _place(units, limits, kind).alias("pos"))


def weighted_blend(spark: SparkSession, names: Sequence[str], weights: Sequence[float], size: int) -> DataFrame:
    """(pos, dataset, dataset_index, item) for the first ``size`` places of the endless weighted mix.

    ``item`` counts a dataset's turns; take it modulo the dataset size to read rows.
    """
    units = integer_weights(weights)
    total = sum(units)
    # A prefix of ``size`` places holds fewer than share + 2 items of a dataset.
    counts = [0 if u == 0 else size * u // total + 3 for u in units]
    return _grid(spark, names, counts, units, None).filter(F.col("pos") < size)


def exhaustive_blend(spark: SparkSession, names: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """The mix that uses every item of every dataset exactly once, in proportion throughout."""
    return _grid(spark, names, sizes, sizes, sizes)


def gather_blend(blend: DataFrame, items: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rows of ``items`` (dataset, item, ..) at each blend position; turns wrap at the dataset size."""
    size_of = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("dataset"))
    wrapped = blend.withColumn("item", F.pmod("item", size_of))
    return wrapped.join(items, ["dataset", "item"])
