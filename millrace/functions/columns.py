"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: ColumnOrName) -> Column:
    return col(value).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row.

    An expression named inside a lambda is otherwise computed again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields null, not an error, for an empty denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def counted(n: int) -> Column:
    """The array 0 .. n - 1, empty for n = 0."""
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")
