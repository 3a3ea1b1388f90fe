"""Files per row, the trace store and its stream, and the carried shuffle buffer, against plain Python."""

import datetime
import json
import random

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.sources import files, writers
from millrace.sources.traces import TraceStore
from millrace.streaming import stateful

SCHEMA = "id string, event_type string, value long, created_at timestamp"
DAY = datetime.datetime(2024, 3, 1)


def test_repeated_and_failed_jobs_add_no_files(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("%03d.bin", "id").alias("file"), F.encode(F.repeat(F.col("id").cast("string"), 5), "UTF-8").alias("bytes"))
    folder = "file://" + str(tmp_path / "out")
    for _ in range(2):
        files.write_files(rows.repartition(4), folder)
        found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.suffix == ".bin"}
        assert found == {f"{i:03d}.bin": str(i).encode() * 5 for i in range(40)}
        assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"files": 40, "bytes": 5 * (10 + 60)}
        assert not (tmp_path / "out" / "_temporary").exists()
    broken = rows.withColumn("file", F.when(F.col("file") == "031.bin", "a/b").otherwise(F.col("file")))
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(broken.repartition(4), str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "_temporary").exists() and not (tmp_path / "bad" / "_SUCCESS").exists()


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", session_uids array<string>")


@pytest.mark.parametrize("replace", [False, True])
def test_appends_are_those_of_a_dictionary(spark, replace):
    rng, store = random.Random(7), TraceStore(spark, writers.scratch_path(spark, "store"), SCHEMA)
    assert store.traces().count() == 0 and store.bridge().count() == 0
    known, links = {}, {}
    for number in range(4):
        ids = rng.sample(range(40), 15)
        rows = [(f"t{i}", rng.choice("ab"), rng.randrange(99), DAY + datetime.timedelta(days=i % 5, hours=number), rng.choice([["s1"], ["s1", "s2"], [], None])) for i in ids]
        report = store.append(batch(spark, rows), replace=replace)
        fresh = [r for r in rows if r[0] not in known]
        assert (report.batch, report.added, report.replaced) == (number, 15 if replace else len(fresh), 15 - len(fresh) if replace else 0)
        for i, kind, value, at, sessions in rows:
            if i not in known or replace:
                known[i] = (i, kind, value, known[i][3] if i in known else at)
                links[i] = {(i, s, known[i][3]) for s in sessions or []}
        assert store.append(batch(spark, rows), number, replace).was_done
        assert {tuple(r) for r in store.traces().collect()} == set(known.values()) and store.traces().count() == len(known)
        assert sorted(map(tuple, store.bridge().collect())) == sorted(set().union(*links.values()))
    since = DAY + datetime.timedelta(days=3)
    assert {r.id for r in store.query(["s2"], since).collect()} == {i for i, k in known.items() if k[3] >= since and any(x[1] == "s2" for x in links[i])}


def test_an_append_that_did_not_commit_is_not_seen(spark):
    root = writers.scratch_path(spark, "store")
    store = TraceStore(spark, root, SCHEMA)
    first, second = [("a", "x", 1, DAY, ["s"])], [("a", "x", 9, DAY, ["s"]), ("b", "x", 2, DAY, ["s"])]
    store.append(batch(spark, first))
    store._write(batch(spark, second), 1)
    manifest = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/batch=1")
    manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(manifest, True)  # lost before the commit
    assert [(r.id, r.value) for r in store.traces().collect()] == [("a", 1)] and store.bridge().count() == 1
    report = store.append(batch(spark, second))
    assert (report.batch, report.added, report.rows_read) == (1, 1, 1)
    assert sorted((r.id, r.value) for r in store.traces().collect()) == [("a", 1), ("b", 2)]


def test_store_reads_stay_level_for_new_ids(spark):
    store = TraceStore(spark, writers.scratch_path(spark, "store"), SCHEMA)
    rng = random.Random(3)
    for _ in range(6):
        rows = [(f"{rng.getrandbits(64):x}", "x", 1, DAY, []) for _ in range(300)]
        assert store.append(batch(spark, rows)).rows_read == 0


def test_polling_since_gives_every_trace_once(spark):
    store = TraceStore(spark, writers.scratch_path(spark, "store"), SCHEMA)
    since = DAY + datetime.timedelta(hours=10)
    out, checkpoint = writers.scratch_path(spark, "out"), writers.scratch_path(spark, "state")
    for part in range(3):
        store.append(batch(spark, [(f"{part}-{i}", "x", i, DAY + datetime.timedelta(hours=i), ["s"]) for i in range(20)]))
        if part != 1:  # two appends are polled at once
            stateful.run_available(store.stream(since.isoformat()), out, checkpoint)
    got = sorted((r.id, r.created_at) for r in spark.read.schema(SCHEMA).parquet(out).collect())
    assert got == sorted((f"{p}-{i}", DAY + datetime.timedelta(hours=i)) for p in range(3) for i in range(10, 20))


def test_the_store_is_asked_for_every_session(spark, tmp_path):
    def event(i):
        return i, DAY + datetime.timedelta(hours=i % 240), None if i % 11 == 0 else i * 37, ("click", "view", "error")[i % 3], 0.5

    events = [event(i) for i in range(600)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = plans.queries()["j2_store_since"](spark, str(tmp_path))
    since = max(ts for _, ts, *_ in events) - datetime.timedelta(days=5)
    assert sorted(r.id for r in found.collect()) == [i for i, ts, user, kind, _ in events if ts >= since and user is not None and kind != "error"]
    con = duckdb.connect()
    con.execute(f"create view events as from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert oracle.difference(found, con, plans.oracle_sql()["j2_store_since"]) is None


@pytest.mark.parametrize("buffer", [1, 7, 500])
def test_shuffle_buffer_is_carried(spark, buffer):
    path, rng = writers.scratch_path(spark, "rows"), random.Random(2)
    stamp = datetime.datetime(2024, 1, 1, 1, 2, 3, 456789)
    rows = [(f"l{i % 2}", i, rng.random() if i % 5 else None, stamp + datetime.timedelta(microseconds=i)) for i in range(300)]
    for at in range(0, 300, 100):
        spark.createDataFrame(rows[at : at + 100], "lane string, i long, x double, t timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("lane string, i long, x double, t timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = writers.scratch_path(spark, "out"), writers.scratch_path(spark, "state")
    shuffled = stateful.shuffle_stream(stream, "lane", "i", buffer)
    with pytest.raises(Exception, match="stopped after batch 1"):
        stateful.batch_writer(shuffled, out, 1).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    stateful.batch_writer(shuffled, out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(shuffled.schema).parquet(out).drop("batch").unionByName(stateful.open_buffers(spark, checkpoint, "lane", stream.schema))
    got = done.orderBy("lane", "place").collect()
    assert sorted(tuple(r.row) for r in got if r.lane == "l0") == sorted(r for r in rows if r[0] == "l0")
    assert len(got) == 300
    for lane in ("l0", "l1"):
        mine = [r for r in got if r.lane == lane]
        assert [r.place for r in mine] == list(range(150))
        assert all(r.row.i // 2 - r.place <= buffer for r in mine)  # early by at most the buffer
    assert buffer == 1 or [r.row.i for r in got if r.lane == "l0"] != sorted(r.row.i for r in got if r.lane == "l0")
