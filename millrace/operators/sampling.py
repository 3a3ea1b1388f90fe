"""Sampling, splitting, shuffling, repeating and mixing of tables.

Every function takes the columns that identify a row, so a result is a function of the data alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col
from ..functions.seeded import seeded_long, seeded_unit
from ..session import cut_lineage
from ..sources.files import path_exists
from .ordering import row_total, running_totals, with_position, with_shuffled_position


def _copies(df: DataFrame, copies: Column, copy: str) -> DataFrame:
    """Each row ``copies`` times, numbered from 0 in column ``copy``."""
    return df.withColumn("__c", copies.cast("int")).filter("__c > 0").withColumn(
        copy, F.explode(F.sequence(F.lit(0), F.col("__c") - 1))
    ).drop("__c")


def sample_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42, shuffle: bool = True, copy: str = "copy"):
    """Exactly ``n`` rows: whole copies of the table while it fits, the rest drawn (or the first rows)."""
    total = row_total(df)
    if shuffle:
        placed = with_shuffled_position(df, seed, "sample", *ids, position="__pos")
    else:
        placed = with_position(df, ids[0], "__pos")
    n_copies = F.floor(F.lit(n) / total) + F.when(F.col("__pos") < F.lit(n) % total, 1).otherwise(0)
    return _copies(placed, n_copies, copy).drop("__pos")


def train_val_split(
    df: DataFrame, ratio: float, ids: Sequence[str], seed: int = 42, n: int | None = None, split: str = "split"
):
    """Label rows ``val`` (a share of them, at least one) or ``train``.

    With ``n``, train rows are sampled, or repeated, so that both parts hold ``n`` rows together.
    """
    total = row_total(df)
    base = total if n is None else F.least(total, F.lit(n))
    n_val = F.greatest(F.floor(base * F.lit(float(ratio))), F.lit(1)).cast("bigint")
    placed = with_shuffled_position(df, seed, "split", *ids, position="__pos").withColumn(
        split, F.when(F.col("__pos") < n_val, "val").otherwise("train")
    )
    if n is None:
        return placed.drop("__pos")
    n_train, have = F.lit(n) - n_val, total - n_val
    at = F.col("__pos") - n_val
    copies = F.floor(n_train / have) + F.when(at < n_train % have, 1).otherwise(0)
    return _copies(placed, F.when(F.col(split) == "val", 1).otherwise(copies), "__copy").drop("__pos", "__copy")


def shuffled_ratio_split(df: DataFrame, ratio: float, ids: Sequence[str], seed: int = 42):
    """Shuffle, first ``ratio`` of the rows to ``train``, rest to ``test``; ``index`` restarts per split."""
    n_train = F.floor(row_total(df) * F.lit(float(ratio))).cast("bigint")
    placed = with_shuffled_position(df, seed, "shuffle", *ids, position="__pos")
    train = F.col("__pos") < n_train
    return placed.select(
        *df.columns,
        F.when(train, "train").otherwise("test").alias("split"),
        F.when(train, F.col("__pos")).otherwise(F.col("__pos") - n_train).alias("index"),
    )


def percent_slice(df: DataFrame, start: float, stop: float, key: str):
    """Rows of the table between two percentages of its order; bounds round half to even."""
    total = row_total(df)
    low, high = (F.bround(total * F.lit(float(p)) / 100.0).cast("bigint") for p in (start, stop))
    placed = with_position(df, key, "__pos")
    return placed.filter((F.col("__pos") >= low) & (F.col("__pos") < high)).drop("__pos")


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: int = 42, position: str = "pos"):
    return with_shuffled_position(df, seed, "shuffle", *ids, position=position)


def repeat_rows(df: DataFrame, n: int, key: str, position: str = "pos"):
    """Each row ``n`` times, copies adjacent in the new ``position``."""
    placed = with_position(df, key, "__pos")
    return _copies(placed, F.lit(n), "copy").withColumn(position, F.col("__pos") * n + F.col("copy")).drop("__pos")


def upsample(df: DataFrame, n: int):
    """The table ``n`` times over."""
    return _copies(df, F.lit(n), "copy")


def select_positions(df: DataFrame, key: str, positions: DataFrame, position: str = "pos"):
    """Rows at the listed positions, in list order and as often as listed.

    ``positions`` has the columns (out_pos, ``position``).
    """
    return positions.join(with_position(df, key, position), position)


def head_rows(df: DataFrame, n: int, *order: ColumnOrName):
    return df.orderBy(*[col(o) for o in order]).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "rank"):
    """First ``k`` rows of each group. Tasks keep only k rows per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def interleave(
    df: DataFrame,
    dataset: str,
    key: str,
    probabilities: dict[str, float],
    seed: int = 42,
    stop: str = "first_exhausted",
):
    """Mix datasets by a seeded draw per output position.

    Output position p belongs to the dataset its draw selects, and holds that dataset's next row. The
    mix ends with the row that empties the first dataset (``first_exhausted``), or the last one
    (``all_exhausted``, where emptied datasets begin again).
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(f"unknown stop rule {stop!r}")
    spark = df.sparkSession
    # A few config rows: dataset names and sizes.
    sizes = {r[0]: r[1] for r in df.filter(F.col(dataset).isin(list(probabilities))).groupBy(dataset).count().collect()}
    names = [name for name in probabilities if sizes.get(name)]
    if not names:
        return df.limit(0).withColumn("pos", F.lit(0).cast("bigint"))
    total = sum(probabilities[n] for n in names)
    items = with_position(df.filter(F.col(dataset).isin(names)), key, "__item", within=[dataset])
    size_of = F.element_at(F.create_map(*[v for n in names for v in (F.lit(n), F.lit(sizes[n]))]), F.col(dataset))

    def draws(n_positions):
        unit = seeded_unit(seed, "interleave", F.col("pos"))
        choice, edge = None, 0.0
        for name in names[:-1]:
            edge += probabilities[name] / total
            choice = F.when(unit < edge, name) if choice is None else choice.when(unit < edge, name)
        choice = F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])
        # Ids 0..n-1 as ``pos``; the 2**20-position blocks are the buckets of the running count.
        grid = spark.range(n_positions).select(F.col("id").alias("pos"), choice.alias(dataset))
        grid = grid.withColumn("__block", F.shiftright("pos", 20))
        return running_totals(grid, [dataset, "__block"], ["pos"], position="__turn", restart=1).drop("__block")

    if stop == "first_exhausted":
        # After sum(sizes) draws some dataset is empty, whatever the draws were.
        drawn = draws(sum(sizes[n] for n in names))
        ends = drawn.filter(F.col("__turn") == size_of - 1).agg(F.min("pos").alias("end")).scalar()
    else:
        guess = int(2 * max(sizes[n] * total / probabilities[n] for n in names)) + 1000
        while True:
            drawn = draws(guess)
            finished = drawn.filter(F.col("__turn") == size_of - 1).agg(F.max("pos"), F.count(F.lit(1))).first()
            if finished[1] == len(names):
                ends = F.lit(finished[0])
                break
            guess *= 2
    wanted = drawn.filter(F.col("pos") <= ends).withColumn("__item", F.pmod(F.col("__turn"), size_of)).drop("__turn")
    return wanted.join(items, [dataset, "__item"]).drop("__item")


class Curriculum:
    """A table of sampling weights that every batch of results changes.

    Version N of the weights is a folder below ``path``, written whole before it counts, so an update that runs again gives the
    same version and one that stopped is not seen. Version 0 is the start.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, seed: int = 42):
        self.spark, self.path, self.key, self.seed = spark, path.rstrip("/"), key, seed

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def start(self, weights: DataFrame) -> None:
        """Version 0 from (key, weight)."""
        weights.select(self.key, F.col("weight").cast("double").alias("weight")).write.mode("overwrite").parquet(self._folder(0))

    def version(self) -> int:
        """The newest version that is whole."""
        version = -1
        while path_exists(self.spark, f"{self._folder(version + 1)}/_SUCCESS"):
            version += 1
        return version

    def weights(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._folder(self.version() if version is None else version))

    def draw(self, n: int, version: int | None = None) -> DataFrame:
        """(key, weight) of ``n`` rows drawn without replacement by weight: the smallest exponential keys. Rows of weight 0 are left out."""
        version = self.version() if version is None else version
        unit = (seeded_long(self.seed, "curriculum", F.lit(version), self.key).cast("double") + 0.5) / float(1 << 48)
        rows = self.weights(version).filter(F.col("weight") > 0)
        return rows.withColumn("__e", -F.ln(unit) / F.col("weight")).orderBy("__e", self.key).limit(n).drop("__e")

    def update(self, results: DataFrame, version: int | None = None, low: float = 0.0, high: float = float("inf")) -> int:
        """The version after ``version``: weights times the factors in ``results`` (key, factor), held between two bounds.

        Keys without a result keep their weight; several factors of a key are multiplied.
        """
        version = self.version() if version is None else version
        factors = results.groupBy(self.key).agg(F.product(F.col("factor").cast("double")).alias("factor"))
        moved = F.greatest(F.least(F.col("weight") * F.coalesce("factor", F.lit(1.0)), F.lit(high)), F.lit(low))
        made = self.weights(version).join(factors, self.key, "left").select(self.key, moved.alias("weight"))
        made.write.mode("overwrite").parquet(self._folder(version + 1))
        return version + 1

    def writer(self, stream: DataFrame, low: float = 0.0, high: float = float("inf")):
        """Stream writer: micro-batch N of (key, factor) makes version N + 1 of version N."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.update(batch, number, low, high))


def write_weights(weights: DataFrame) -> DataFrame:
    """Weights a curriculum step produced, cut from the plan that made them."""
    return cut_lineage(weights)
