"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null or
non-positive quality counts as 1; repeated rows are rows of their own; an empty table gives an empty mix.
Only the named columns are read, so extra columns cannot clash; ``materialise`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seeded import seeded_long
from .common import WORD, stored

WEIGHTS = (5, 2, 1)
PERCENT = 150
MAX_EPOCHS = 2
KEY_STEPS = 1024  # buckets per unit of the exponential key; its tail beyond 16 units is one bucket


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source: its size and its target.

    Sources in code point order take the weights in turn. With sources sorted by limit / weight, a source is
    full when its share of what the earlier ones left exceeds its limit; the first that is not full fixes the
    common rate. The windows run over sources, not documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limits = totals.select(
        "source", "source_size", choice.alias("w"), (F.col("source_size") * max_epochs).cast("double").alias("limit")
    )
    rank = [(F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*rank).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rates = limits.withColumn(
        "rate",
        (F.sum("source_size").over(every) * percent / 100.0 - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("w").over(onward),
    ).withColumn("open", F.col("w") * F.col("rate") < F.col("limit"))
    at = F.when(F.col("open"), F.struct((F.col("limit") / F.col("w")).alias("at"), "rate"))
    common = F.min(at).over(every).getField("rate")
    return rates.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("limit"), F.col("w") * common), F.col("limit")).alias("target"),
    )


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    seed: int = 7,
    weights=WEIGHTS,
    percent: int = PERCENT,
    max_epochs: int = MAX_EPOCHS,
    with_row: bool = False,
) -> DataFrame:
    """Words taken of every document of ``docs`` (doc_id, text, source); ``quality`` has (doc_id, quality) weights.

    A source's budget is the whole words of its target. Whole epochs take every document; the rest goes to
    documents in ascending order of -ln(u) / quality (u from a seeded md5 of doc_id) until the budget is spent,
    the last one in part. The order is bucketed by the key itself, so a hot source is many small windows.
    """
    base = docs.withColumn("size", word_count(F.col("text"))).select(
        "doc_id", F.col("source").cast("string").alias("source"), "size", *(["row"] if with_row else [])
    )
    if quality is None:
        base = base.withColumn("quality", F.lit(1.0))
    else:
        weights_of = quality.groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("quality"))
        base = base.join(weights_of, "doc_id", "left")
    base = stored(base, "mix-sizes")  # the texts are read once
    good = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1.0))
    unit = (seeded_long(seed, "mix", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) + F.lit(0.5)) / F.lit(
        float(2**48)
    )
    keyed = base.select("*", (-F.log(unit) / good).alias("key")).withColumn(
        "bucket", F.least(F.lit(16 * KEY_STEPS), F.floor(F.col("key") * KEY_STEPS)).cast("int")
    )
    targets = source_targets(base, weights, percent, max_epochs)
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        "source", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("bucket_start")
    )
    offsets = offsets.join(
        targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))
    ).select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "bucket_start", "source_size", "target")
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("key", "doc_id", "size", *(["row"] if with_row else []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    ).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("bigint")
    has = F.col("source_size") > 0
    epochs = F.when(has, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select(
        "doc_id",
        *(["row"] if with_row else []),
        "source",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("bigint").alias("taken"),
    )


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a stable name of each row in ``__row``.

    A table just read from Parquet files has one: the file and the place in it. Any other table is numbered in a stored copy, so that
    both of its uses see the same numbers.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
        if plan.relation().fileFormat().toString() == "Parquet" and "_metadata" not in docs.columns:
            return docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__row"))
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")


def materialise(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: ``docs``' rows repeated as often as taken, all columns kept.

    A document taken in part ends after its taken words (at most one per source). Documents without words carry
    nothing to take and go.
    """
    numbered = _with_row(docs)
    chosen = mix(numbered.withColumn("row", F.col("__row")).select("doc_id", "text", "source", "row"), quality, with_row=True, **options)
    chosen = chosen.filter("taken > 0").select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    joined = numbered.join(chosen, "__row")
    copies = F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("__taken") / F.col("__size")).cast("bigint"))
    out = joined.select("*", F.explode(copies).alias("__copy"))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, left.cast("int")), "")
    out = out.withColumn("text", F.when(left < F.col("__size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(left < F.col("__size"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
