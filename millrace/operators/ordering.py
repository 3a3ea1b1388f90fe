"""Contiguous positions and running sums over one global order, without a one-task window.

A global ``Window.orderBy`` moves the whole table to one task. Here the order is cut into buckets that
respect it; the per-bucket totals are a small table, its running sum gives each bucket an offset, and a
window inside each bucket finishes the job. Buckets come from the key itself, so the result needs no
sampling, no driver step and no partition ids, and is unchanged by task retries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnOrName, col
from ..functions.seeded import seeded_hash

# A unique integer key has at most 2**20 buckets under one parent; a finest bucket, whose rows go to one task whole, has
# at most 2**10 of them. Values are cut down to 2**20 only: their rows are narrow.
_FINE_BITS = 20
_COARSE_BITS = 40
_ROW_BITS = 10
# Hex digits of an md5 that name a bucket: at most 65,536 buckets, evenly filled.
_HASH_DIGITS = 4


def _same(names: Sequence[str], prefix: str) -> Column:
    """Equality of columns with their prefixed copies, nulls equal."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names])


def running_totals(
    df: DataFrame,
    levels: Sequence[str],
    order: Sequence[ColumnOrName],
    sums: Sequence[str] = (),
    position: str = "pos",
    restart: int = 0,
) -> DataFrame:
    """Add ``position`` (from 0) and, for each column of ``sums``, ``<column>_before``.

    ``levels`` are bucket columns, coarsest first, that agree with the order: rows sort by all levels
    and then by ``order`` inside the last one. ``<column>_before`` is the sum over all earlier rows.
    Counts and sums start again for each value of the first ``restart`` levels.
    """
    levels = list(levels)
    measures = ["__n"] + [f"__s_{c}" for c in sums]
    table = df.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{c}") for c in sums],
    )
    offsets = None
    for depth in range(restart + 1, len(levels) + 1):
        keys, parents = levels[:depth], levels[: depth - 1]
        grouped = table
        if depth < len(levels):
            grouped = table.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
        earlier = (
            Window.partitionBy(*(parents or [F.lit(0)]))
            .orderBy(levels[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        grouped = grouped.select(
            *keys, *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"__off{m}") for m in measures]
        )
        if offsets is not None:
            parent = offsets.select(
                *[F.col(c).alias(f"__p{c}") for c in parents], *[F.col(f"__off{m}").alias(f"__up{m}") for m in measures]
            )
            grouped = grouped.join(parent, _same(parents, "__p")).select(
                *keys, *[(F.col(f"__off{m}") + F.col(f"__up{m}")).alias(f"__off{m}") for m in measures]
            )
        offsets = grouped

    inside = Window.partitionBy(*levels).orderBy(*[col(o) for o in order])
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    named = offsets.select(*[F.col(c).alias(f"__p{c}") for c in levels], *[f"__off{m}" for m in measures])
    out = df.join(named, _same(levels, "__p")).withColumn(
        position, F.row_number().over(inside).cast("bigint") - 1 + F.col("__off__n")
    )
    for c in sums:
        local = F.coalesce(F.sum(c).over(before), F.lit(0))
        out = out.withColumn(f"{c}_before", local + F.col(f"__off__s_{c}"))
    return out.drop(*[f"__off{m}" for m in measures], *[f"__p{c}" for c in levels])


def with_position(
    df: DataFrame,
    key: str,
    position: str = "pos",
    sums: Sequence[str] = (),
    within: Sequence[str] = (),
) -> DataFrame:
    """Number rows from 0 by a unique integer ``key``; ``within`` restarts the count per group.

    A group may be of any size: it is cut into key ranges like the whole table.
    """
    bits = {"__hi": _COARSE_BITS, "__lo": _FINE_BITS, "__rows": _ROW_BITS}
    bucketed = df.withColumns({name: F.shiftright(F.col(key).cast("bigint"), n) for name, n in bits.items()})
    return _numbered(bucketed, list(bits), [key], position, sums, within).drop(*bits)


def with_shuffled_position(
    df: DataFrame,
    seed: int | str,
    salt: str,
    *ids: str,
    position: str = "pos",
    sums: Sequence[str] = (),
    within: Sequence[str] = (),
) -> DataFrame:
    """Number rows from 0 in seeded-shuffle order; ``ids`` identify a row."""
    hashed = df.withColumn("__hash", seeded_hash(seed, salt, *ids)).withColumn(
        "__hi", F.substring("__hash", 1, _HASH_DIGITS)
    )
    return _numbered(hashed, ["__hi"], ["__hash", *ids], position, sums, within).drop("__hi", "__hash")


def _numbered(df, levels, order, position, sums, within):
    return running_totals(df, [*within, *levels], order, sums, position, restart=len(within))


def row_total(df: DataFrame) -> Column:
    """Row count as a scalar subquery column."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def value_levels(df: DataFrame, value: str) -> tuple[list[str], DataFrame]:
    """Names of bucket columns that agree with the order of a numeric ``value``, and the table with them.

    Integers are cut by their high bits. Other numbers are cut as a float is stored, by sign and exponent, then 12
    and 32 leading bits of the mantissa, so outliers do not widen the buckets of the rest: a finest bucket has
    at most 2**20 distinct doubles. A power of two may be taken as the end of the exponent below; both
    forms give one number. Nulls come first, NaN last.
    """
    names = ["__v0", "__v1", "__v2"]
    if isinstance(df.schema[value].dataType, T.IntegralType):
        code = F.col(value).cast("bigint")
        top, middle = _COARSE_BITS, _FINE_BITS
        fine = F.shiftright(code, middle)
        return names[:2], df.withColumns({"__v0": F.shiftright(code, top), "__v1": fine})
    v = F.col(value).cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    # Halves of the power keep 2 ** exponent from leaving the range of doubles before it is divided by.
    half = F.floor(exponent / 2)
    mantissa = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half)
    code = (exponent + 1076) * F.lit(2**32) + F.floor((mantissa - 1) * F.lit(float(2**32)))
    beyond = F.lit(2**12) * F.lit(2**32)
    signed = (
        F.when(v.isNull(), F.lit(None).cast("bigint"))
        .when(F.isnan(v), beyond + F.lit(2**32))
        .when(size == 0, F.lit(0))
        .when(size == F.lit(float("inf")), F.signum(v).cast("bigint") * beyond)
        .otherwise(F.signum(v).cast("bigint") * code.cast("bigint"))
    )
    coded = df.withColumn("__v2", signed)
    return names, coded.withColumns({"__v0": F.shiftright("__v2", 32), "__v1": F.shiftright("__v2", 20)})


def with_value_position(
    df: DataFrame, value: str, key: str, position: str = "pos", within: Sequence[str] = ()
) -> DataFrame:
    """Number rows from 0 in order of a numeric ``value``, equal values by the unique integer ``key``.

    Distinct values are counted first, so a value held by any share of the rows is one row of the
    running sum; the rows of one value are numbered by key ranges.
    """
    same = [*within, value]
    counts = value_offsets(df, value, within).select(*[F.col(c).alias(f"__c_{c}") for c in same], "n_before")
    placed = with_position(df, key, "__in_value", within=same)
    return (
        placed.join(counts, _same(same, "__c_"))
        .withColumn(position, F.col("n_before") + F.col("__in_value"))
        .drop("__in_value", "n_before", *[f"__c_{c}" for c in same])
    )


def value_offsets(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """(within.., value, n, n_before): each distinct value, its count and the count of smaller ones."""
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    return value_running_sum(counts, value, "n", within).select(*within, value, "n", F.col("n_before"))


def value_running_sum(df: DataFrame, value: str, measure: str, within: Sequence[str] = ()) -> DataFrame:
    """``df``, one row per value (of each ``within`` group), with ``<measure>_before``: the sum over smaller values."""
    levels, bucketed = value_levels(df, value)
    return running_totals(bucketed, [*within, *levels], [value], [measure], "__pos", restart=len(within)).drop(*levels, "__pos")
