"""Repeatable randomness: every draw is an md5 of (seed, salt, row id).

The value depends on nothing but its inputs, so a sample, a split or a shuffle is the same for any
partitioning, after any task retry, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, text


def seeded_hash(seed: int | str, salt: str, *ids: ColumnOrName) -> Column:
    """32 hex digits; order by this column for a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[text(i) for i in ids]))


def seeded_long(seed: int | str, salt: str, *ids: ColumnOrName) -> Column:
    """Uniform integer in [0, 2**48)."""
    digits = F.substring(seeded_hash(seed, salt, *ids), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint")


def seeded_unit(seed: int | str, salt: str, *ids: ColumnOrName) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_long(seed, salt, *ids).cast("double") / F.lit(float(2**48))


def seeded_pick(options: Column, seed: int | str, salt: str, *ids: ColumnOrName) -> Column:
    """One element of an array column, null when it is empty."""
    n = F.size(options).cast("bigint")
    index = F.when(n > 0, F.pmod(seeded_long(seed, salt, *ids), n) + 1)
    return F.try_element_at(options, index.cast("int"))
