"""Batch-table operators: a table with a contiguous position column ``pos`` from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import counted

from .ordering import row_total


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("pos", *[c for c in columns if c != "pos"])


def pop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rest, popped); both keep ``pos``."""
    return df.drop(*columns), select_columns(df, columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(mask)


def slice_rows(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start+step, .. below stop, renumbered."""
    rows = df.filter((F.col("pos") >= start) & (F.pmod(F.col("pos") - start, F.lit(step)) == 0))
    if stop is not None:
        rows = rows.filter(F.col("pos") < stop)
    return rows.withColumn("pos", F.floor((F.col("pos") - start) / step))


def chunk(df: DataFrame, n: int, strict: bool = True) -> DataFrame:
    """Column ``chunk``: n equal parts by position; a row count n does not divide is an error.

    Without ``strict`` the parts have the whole quotient of rows, and what is left follows in chunks from n on; of fewer
    than n rows none has a chunk (null).
    """
    total = row_total(df)
    if not strict:
        size = F.nullif(F.floor(total / n), F.lit(0).cast("bigint"))
        return df.withColumn("chunk", F.floor(F.col("pos") / size).cast("bigint"))
    per = F.when(total % n == 0, total / n)
    checked = F.coalesce(per, F.raise_error(F.lit(f"row count is not divisible by {n}")).cast("double"))
    return df.withColumn("chunk", F.floor(F.col("pos") / checked).cast("bigint"))


def split_by_size(df: DataFrame, size: int) -> DataFrame:
    """Column ``chunk``: parts of ``size`` rows, the last may be short."""
    return df.withColumn("chunk", F.floor(F.col("pos") / size).cast("bigint"))


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables one after another, positions renumbered."""
    out, offset = None, F.lit(0).cast("bigint")
    for table in tables:
        moved = table.withColumn("pos", F.col("pos") + offset)
        offset = offset + row_total(table)
        out = moved if out is None else out.unionByName(moved)
    return out


def merge_meta(metas: Sequence[dict]) -> dict:
    """Common meta of several batches: metric lists are joined, any other difference is an error."""
    merged: dict = {}
    for meta in metas:
        for key, value in meta.items():
            if key == "metrics":
                merged.setdefault(key, []).extend(value if isinstance(value, list) else [value])
            elif key in merged and merged[key] != value:
                raise ValueError(f"conflicting meta value for {key!r}")
            else:
                merged[key] = value
    return merged


def reorder(df: DataFrame, order: DataFrame) -> DataFrame:
    """Row order[out_pos].pos moves to out_pos."""
    return order.join(df, "pos").drop("pos").withColumnRenamed("out_pos", "pos")


def repeat(df: DataFrame, n: int, interleaved: bool = True) -> DataFrame:
    """Each row n times: copies adjacent (a a b b), or the batch tiled (a b a b)."""
    copies = df.withColumn("__copy", F.explode(counted(n)))
    if interleaved:
        place = F.col("pos") * n + F.col("__copy")
    else:
        place = F.col("__copy") * row_total(df) + F.col("pos")
    return copies.withColumn("pos", place).drop("__copy")


def repeat_by_count(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count column says; 0 drops it. ``copy`` numbers the copies."""
    return df.filter(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def pad_to_divisor(df: DataFrame, divisor: int) -> DataFrame:
    """Repeat head rows until the row count divides; added rows have ``is_pad`` set.

    The head wraps round when more rows are needed than the table has.
    """
    total = row_total(df)
    missing = F.pmod(-total, F.lit(divisor))
    n_wraps = F.ceil((missing - F.col("pos")) / total)
    padded = (
        df.filter(F.col("pos") < missing)
        .withColumn("__w", F.explode(F.sequence(F.lit(0).cast("bigint"), n_wraps - 1)))
        .withColumn("pos", total + F.col("__w") * total + F.col("pos"))
        .drop("__w")
        .withColumn("is_pad", F.lit(True))
    )
    return df.withColumn("is_pad", F.lit(False)).unionByName(padded)


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def fold(df: DataFrame, size: int) -> DataFrame:
    """``size`` neighbouring rows become one row with an array ``items``; groups are of fixed size."""
    values = F.struct(F.col("pos"), *[F.col(c) for c in df.columns if c != "pos"])
    return (
        df.groupBy(F.floor(F.col("pos") / size).cast("bigint").alias("row"))
        .agg(F.sort_array(F.collect_list(values)).alias("items"))
        .withColumnRenamed("row", "pos")
    )


def unfold(df: DataFrame) -> DataFrame:
    return df.select(F.explode("items").alias("item")).select("item.*")


def unfold_column(df: DataFrame, column: str, n: int) -> DataFrame:
    """Split an array column into n equal chunks, one output row per chunk; a length that n does not divide is an error."""
    size = F.size(column)
    per = F.when(size % n == 0, size / n).otherwise(F.raise_error(F.concat(F.lit(f"{n} chunks do not divide a length of "), size))).cast("int")
    return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        column, F.slice(F.col(column), F.col("chunk") * per + 1, per)
    )


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two batches side by side; a shared column must hold equal values."""
    shared = [c for c in left.columns if c in right.columns and c != "pos"]
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    out = left.join(other, "pos")
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        out = out.withColumn(
            c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs between the tables")))
        )
    return out.drop(*[f"__r_{c}" for c in shared])


def mini_batches(df: DataFrame, size: int, epochs: int, seed: int = 42) -> DataFrame:
    """(epoch, batch) of every row, shuffled per epoch; each batch is full or the last of its epoch."""
    from .ordering import with_shuffled_position

    spread = df.withColumn("epoch", F.explode(counted(epochs)))
    placed = with_shuffled_position(spread, seed, "mini", "epoch", "pos", position="__at", within=["epoch"])
    return placed.withColumn("batch", F.floor(F.col("__at") / size).cast("bigint")).withColumnRenamed("__at", "at")
