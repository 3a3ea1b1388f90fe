"""Union, intersection and exact de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col, counted
from .sampling import top_per_group


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def fingerprint(*columns: ColumnOrName) -> Column:
    """md5 of the canonical JSON of the columns, sorted by name."""
    named = [(c if isinstance(c, str) else f"c{i}", col(c)) for i, c in enumerate(columns)]
    return F.md5(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(named, key=lambda x: x[0])])))


def first_per_key(df: DataFrame, key: Column, order: Sequence[ColumnOrName]) -> DataFrame:
    """First row per key. A key with any number of copies reaches the shuffle as one row per task."""
    keyed = df.withColumn("__key", key)
    return top_per_group(keyed, ["__key"], [col(o) for o in order], 1, "__rank").drop("__key", "__rank")


def common_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    return left.select(name).intersect(right.select(name))


def epochs_union(df: DataFrame, epochs: int) -> DataFrame:
    """The table once per epoch, with an ``epoch`` column."""
    return df.withColumn("epoch", F.explode(counted(epochs)))
