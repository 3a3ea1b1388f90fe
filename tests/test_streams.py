"""Streams over keys larger than one frame, and what they hold when the input has ended."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import writers
from millrace.streaming import stateful


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "in")
    shuffled = spark.range(40_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 7 + 1).alias("n")).orderBy(F.xxhash64("id"))
    shuffled.coalesce(1).write.parquet(path)
    return spark.readStream.schema("k string, id bigint, n bigint").parquet(path)


def run(spark, stream, still_open=None):
    out, checkpoint = writers.scratch_path(spark, "out"), writers.scratch_path(spark, "state")
    stateful.run_available(stream, out, checkpoint)
    done = spark.read.schema(stream.schema).parquet(out)
    return done if still_open is None else done.unionByName(still_open(checkpoint))


def test_take_split_of_a_large_key(spark, rows):
    got = run(spark, stateful.take_split(rows, "k", "id", 40, 5)).collect()
    assert sorted((r.id, r.split) for r in got) == [(i, "val" if i < 5 else "train") for i in range(40)]


def test_queue_of_a_large_key(spark, rows):
    (got,) = run(spark, stateful.bounded_queue(rows, "k", "id", 25)).collect()
    assert got.kept == list(range(39_975, 40_000)) and (got.produced, got.dropped) == (40_000, 39_975)


def test_every_row_is_packed_once(spark, rows):
    sized = rows.withColumn("n", F.when(F.col("id") == 77, 99).when(F.col("id") == 78, F.lit(None)).otherwise(F.col("n")))
    packed = run(spark, stateful.pack_stream(sized, "k", "id", "n", 50), lambda c: stateful.open_packs(spark, c, "k", "id", "n"))
    assert sorted(r.id for r in packed.select("id").collect()) == list(range(40_000))
    sums = packed.groupBy("pack").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    assert sums.filter("n > 50 and c > 1").count() == 0 and packed.filter("n = 99").count() == 1


def test_last_session_is_read_from_the_checkpoint(spark, rows):
    marked = rows.withColumn("opens", F.col("id").isin(0, 30_000))
    got = run(spark, stateful.session_stream(marked, "k", "id", "opens", "id"), lambda c: stateful.open_sessions(spark, c, "k"))
    assert sorted((r.session, len(r.turns), r.turns[0]) for r in got.collect()) == [(0, 30_000, 0), (1, 10_000, 30_000)]
