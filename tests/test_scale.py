"""Steps that must not hold a whole table, group or file in one task, in the driver or as Python objects."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.operators import batch, joins, metrics, ordering
from millrace.plans import io_queries
from millrace.sources import traces
from millrace.streaming import stateful


def test_drawn_samples_are_never_a_broadcast(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 1, "y", 0.0), ("b", 0, "x", 3.0)], "task string, step long, vote string, reward double")
    made = metrics.bootstrap_majority(rows, ["task"], "vote", "reward", "step", 2, 20)
    assert {r["task"]: (r["mean"], r["std"]) for r in made.collect()}["b"] == (3.0, 0.0)
    assert "strategy=merge" in made._jdf.queryExecution().optimizedPlan().toString()


def test_continuations_of_packed_tokens(spark):
    chunks = spark.createDataFrame([(0, "a b"), (1, "c"), (2, "d e")], "chunk_id long, tokens string")
    wanted = spark.createDataFrame([(7, 1, 0), (7, 0, 2), (8, 0, 1)], "query long, rank int, neighbour long")
    made = joins.with_continuations(wanted, chunks, F.lit(3), 2, lambda t: F.split(t, " "))
    got = {r["query"]: [(n["rank"], n["neighbour"], n["tokens"]) for n in r["neighbours"]] for r in made.collect()}
    assert got == {7: [(0, 2, ["d", "e", "a", "b"]), (1, 0, ["a", "b", "c"])], 8: [(0, 1, ["c", "d", "e"])]}
    arrays = chunks.withColumn("tokens", F.split("tokens", " "))
    assert {r["query"]: [(n["rank"], n["neighbour"], n["tokens"]) for n in r["neighbours"]] for r in joins.with_continuations(wanted, arrays, F.lit(3), 2).collect()} == got


def test_chunks_of_a_row_count_that_does_not_divide(spark):
    df = spark.range(13).withColumnRenamed("id", "pos")
    assert [r["chunk"] for r in batch.chunk(df, 5, strict=False).orderBy("pos").collect()] == [p // 2 for p in range(13)]
    assert {r["chunk"] for r in batch.chunk(df.limit(3), 5, strict=False).collect()} == {None}


def test_a_stream_reads_a_file_and_a_folder_of_files(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    pd.DataFrame({"id": range(40)}).to_parquet(tmp_path / "one.parquet")
    for name in ("many", "one"):
        rows = io_queries.finished(io_queries.stream_of(spark, str(tmp_path), name, "id long"), spark, name)
        assert sorted(r["id"] for r in rows.collect()) == list(range(40))


def test_position_buckets_are_small(spark, monkeypatch):
    seen, whole = [], ordering.running_totals

    def kept(df, levels, *rest, **named):
        seen.append(df.groupBy(*levels).count().agg(F.max("count")).first()[0])
        return whole(df, levels, *rest, **named)

    monkeypatch.setattr(ordering, "running_totals", kept)
    placed = ordering.with_position(spark.range(5000, 0, -1), "id")
    assert all(r["pos"] == r["id"] - 1 for r in placed.collect()) and seen == [1024]


class _State:
    def __init__(self):
        self.get, self.exists, self.hasTimedOut = None, False, False

    def update(self, value):
        self.get, self.exists = value, True


class _Stream:
    """Keeps the step of a stream operator."""

    def __init__(self, df):
        self.schema, self.columns = df.schema, df.columns

    def select(self, *_):
        return self

    groupBy = select

    def applyInPandasWithState(self, step, *_):
        self.step = step
        return self


def test_stream_steps_send_frames_of_many_rows_and_bounded_size(spark):
    n = 3 * stateful.FRAME_ROWS
    ids = np.random.default_rng(1).permutation(n)
    rows = pd.DataFrame({"lane": "x", "id": ids, "n": ids % 50 + 1, "v": (ids * 7) % 1000})
    frames = [rows.iloc[i : i + 7000] for i in range(0, n, 7000)]
    stream = _Stream(spark.createDataFrame([], "lane string, id long, n long, v long"))

    made = list(stateful.staleness(stream, "lane", "id", "v", 20).step(("x",), iter(frames), _State()))
    assert max(map(len, made)) <= stateful.FRAME_ROWS
    placed = rows.sort_values("id")
    assert (pd.concat(made)["lag"].to_numpy() == (placed["v"].cummax() - placed["v"]).to_numpy()).all()

    state = _State()
    made = list(stateful.pack_stream(stream, "lane", "id", "n", 200).step(("x",), iter(frames), state))
    packs = pd.concat(made).groupby("pack")["n"].sum()
    assert packs.max() <= 200 and len(packs) == state.get[2] and len(made) <= 5
    assert sorted([*pd.concat(made)["id"], *state.get[0]]) == list(range(n))

    texts = [pd.DataFrame({"__order": f["id"], "__row": f["id"].astype(str)}) for f in frames]
    lists = list(stateful._texts_in_order(iter(texts), "__order", "__row"))
    assert max(map(len, lists)) <= stateful.FRAME_ROWS and [int(t) for some in lists for t in some] == list(range(n))


def test_trace_files_are_described_by_many_tasks(spark, tmp_path, monkeypatch):
    """The manifest is one file, but not by one task doing the work before it; found files are not asked again."""
    df = spark.range(300).select("id", (F.col("id") * 1000.0).alias("created_at"), F.array(F.lit("s")).alias("session_uids"))
    monkeypatch.setattr(type(df), "coalesce", lambda *_: (_ for _ in ()).throw(AssertionError("coalesce")))
    monkeypatch.setattr(traces, "PROBE_IDS", 100)
    store = traces.TraceStore(spark, str(tmp_path / "store"), "id long, created_at double")
    assert store.append(df).added == 300
    assert len(list((tmp_path / "store/manifest/batch=0").glob("*.parquet"))) == 1
    assert store.append(df.withColumn("id", F.col("id") + 100)).added == 100
    assert store.traces().count() == 400


def test_bloom_filters_say_yes_to_their_own_hashes():
    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 40_000)
    bloom = traces.bloom_filter(hashes[:20_000])
    assert all(traces.may_hold(bloom, hashes[i : i + 1]) for i in range(0, 20_000, 997))
    assert not traces.may_hold(bloom, hashes[20_000:])


def test_tokenizer_ids_of_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "a b"), (3, "b " * 3000)], "k int, t string")
    ids = registry.tokenizer_column(lambda: lambda t: [ord(w) for w in t.split()])("t")
    assert {r["k"]: r["ids"] for r in df.select("k", ids.alias("ids")).collect()} == {0: None, 1: [], 2: [97, 98], 3: [98] * 3000}
    assert "ArrowEvalPython" in df.select(ids)._jdf.queryExecution().executedPlan().toString()
