"""A trace store that appends without reading itself, and a stream over it.

Below ``root``: ``traces/batch=N/day=D`` and ``bridge/batch=N`` hold the rows of append N, ``replaced/batch=N`` names the older
versions it took the place of, and ``manifest/batch=N`` has one row per trace file: its rows, id range, newest time and a Bloom
filter of its ids. The manifest is written last, as one file, and is the commit: an append without one is not seen, and its folders are
written anew when the append is repeated; an append with one is not run again. One writer at a time.

An append asks the manifest which files can hold one of its ids and reads only those, so the trace rows that it reads do not grow with
the store as long as its ids are new; the manifest, about four bytes an id, is read by tasks, and id ranges leave out most of it
where ids rise with time. Files hold at most FILE_ROWS rows, which bounds a Bloom filter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.joins import session_traces
from ..session import cut_lineage
from .files import opened, path_exists, qualified

FILE_ROWS = 100_000
BITS_PER_ID, PROBES = 32, 20  # one wrong yes in some million ids: one would have a whole file read
PROBE_IDS, PROBE_STEP = 1_000_000, 10_000  # ids that go to the tasks at a time, and that a filter is asked for at a time
MANIFEST = "batch long, file string, n long, first_id string, last_id string, newest timestamp, bloom binary"


def _place(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Place of each hash in a filter of ``size`` bits at one of PROBES probes, by double hashing of a 64-bit hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low + np.uint64(probe) * high) % np.uint64(size)


def bloom_filter(hashes: np.ndarray) -> bytes:
    size = max(64, 1 << int(len(hashes) * BITS_PER_ID - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    hashes = hashes.astype(np.int64).view(np.uint64)
    for probe in range(PROBES):
        bits[_place(hashes, probe, size).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> bool:
    """Whether the filter says yes to any of the hashes: probe by probe, of the hashes that all probes before said yes to."""
    bits = np.unpackbits(np.frombuffer(bloom, dtype=np.uint8), bitorder="little")
    for at in range(0, len(hashes), PROBE_STEP):
        left = hashes[at : at + PROBE_STEP].view(np.uint64)
        for probe in range(PROBES):
            left = left[bits[_place(left, probe, len(bits)).astype(np.int64)] == 1]
            if not len(left):
                break
        else:
            return True
    return False


@dataclass
class AppendReport:
    """What an append did: rows added, versions replaced, and the stored rows it had to read."""

    batch: int
    added: int = 0
    replaced: int = 0
    files_read: int = 0
    rows_read: int = 0
    was_done: bool = False


class TraceStore:
    """Traces with an ``id`` and ``created_at`` (seconds or timestamp), and their (trace, session) rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        missing = {"id", "created_at"} - set(self.schema.names)
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")

    def _created(self, column: Column | None = None) -> Column:
        column = F.col("created_at") if column is None else column
        numeric = isinstance(self.schema["created_at"].dataType, T.NumericType)
        return F.timestamp_seconds(column) if numeric else column.cast("timestamp")

    def _key(self) -> Column:
        """The id as text, whole numbers so that their order is that of the numbers."""
        whole = isinstance(self.schema["id"].dataType, T.IntegralType)
        return F.format_string("%020d", F.col("id")) if whole else F.col("id").cast("string")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def manifest(self) -> DataFrame:
        return self._table("manifest", MANIFEST)

    def _all_traces(self, *paths: str) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
        folder = f"{self.root}/traces"
        if not paths and not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("basePath", folder).parquet(*(paths or [folder]))

    def _live(self, rows: DataFrame, ident: str) -> DataFrame:
        """Rows of committed appends that no later append has replaced."""
        replaced = self._table("replaced", "id string, version long, batch long")
        committed = self.manifest().select("batch").distinct()
        gone = replaced.join(committed, "batch", "left_semi").select(F.col("id").alias("__id"), F.col("version").alias("__version"))
        same = (rows[ident].cast("string") == F.col("__id")) & (rows["batch"] == F.col("__version"))
        return rows.join(committed, "batch", "left_semi").join(gone, same, "left_anti")

    def traces(self, since=None) -> DataFrame:
        """All traces, or those created at ``since`` or later; older days are not read."""
        rows = self._all_traces()
        if since is not None:
            rows = rows.filter((F.col("day") >= F.to_date(self._created(F.lit(since)))) & (F.col("created_at") >= F.lit(since)))
        return self._live(rows, "id").select(*self.schema.names)

    def bridge(self, since=None) -> DataFrame:
        """(trace_id, session_uid, created_at), once each."""
        ident, made = self.schema["id"].dataType.simpleString(), self.schema["created_at"].dataType.simpleString()
        rows = self._table("bridge", f"trace_id {ident}, session_uid string, created_at {made}, batch long")
        if since is not None:
            rows = rows.filter(F.col("created_at") >= F.lit(since))
        return self._live(rows, "trace_id").drop("batch")

    def query(self, sessions: Sequence[str] | DataFrame | None = None, since=None, **filters) -> DataFrame:
        """``session_traces`` over the store: by sessions, types, namespaces and time."""
        return session_traces(self.traces(since), self.bridge(since), sessions, since, **filters)

    def _candidates(self, incoming: DataFrame) -> list[tuple[str, int]]:
        """(file, rows) of the stored files that can hold an id of ``incoming``."""
        hashed = incoming.select(self._key().alias("id"), F.xxhash64(self._key()).alias("h"))
        facts = hashed.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("n")).first()
        if not facts["n"]:
            return []
        files = self.manifest().filter((F.col("n") > 0) & (F.col("first_id") <= facts["b"]) & (F.col("last_id") >= facts["a"]))
        parts, found = -(-facts["n"] // PROBE_IDS), {}
        for part in range(parts):  # about PROBE_IDS hashes of 8 bytes go to the tasks at a time
            some = hashed.filter(F.pmod("h", F.lit(parts)) == part).select("h").toPandas()["h"].to_numpy()

            def hits(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array([may_hold(x.as_py(), some) for x in batch.column("bloom")], pa.bool_())).select(["file", "n"])

            found.update((r["file"], r["n"]) for r in files.select("file", "n", "bloom").mapInArrow(hits, "file string, n long").collect())
            files = files.filter(~F.col("file").isin(list(found))) if found else files  # what is found is not asked again
            if files.isEmpty():
                break
        return sorted(found.items())

    def append(self, batch: DataFrame, number: int | None = None, replace: bool = False) -> AppendReport:
        """Add traces (the schema's columns and ``session_uids``) as append ``number``, by default the next one.

        Rows without an id are left out; of rows with one id any one counts. A stored id is left as it is, or with ``replace`` gets a
        new version, new session rows and keeps its ``created_at``. A number that is committed already does nothing.
        """
        done = self.manifest().agg(F.max("batch")).first()[0]
        number = (-1 if done is None else done) + 1 if number is None else number
        if done is not None and number <= done:
            return AppendReport(number, was_done=True)
        incoming = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], "session_uids")
        incoming = cut_lineage(incoming.filter(F.col("id").isNotNull()).dropDuplicates(["id"]))
        report = AppendReport(number)
        files = self._candidates(incoming)
        report.files_read, report.rows_read = len(files), sum(n for _, n in files)
        if files:
            paths = [f"{self.root}/traces/{file}" for file, _ in files]
            held = self._live(self._all_traces(*paths), "id").select("id", F.col("created_at").alias("__made"), F.col("batch").alias("__version"))
            if replace:
                incoming = cut_lineage(incoming.join(held, "id", "left").withColumn("created_at", F.coalesce("__made", "created_at")))
                older = incoming.filter(F.col("__version").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("__version").alias("version"))
                older.write.mode("overwrite").parquet(f"{self.root}/replaced/batch={number}")
                report.replaced = older.count()
                incoming = incoming.drop("__made", "__version")
            else:
                incoming = cut_lineage(incoming.join(held, "id", "left_anti"))
        self._write(incoming, number)
        report.added = self.manifest().filter(F.col("batch") == number).agg(F.sum("n")).first()[0]
        return report

    def _write(self, incoming: DataFrame, number: int) -> None:
        links = incoming.select(F.col("id").alias("trace_id"), F.explode(F.col("session_uids").cast("array<string>")).alias("session_uid"), "created_at")
        links.distinct().write.mode("overwrite").parquet(f"{self.root}/bridge/batch={number}")
        folder = f"{self.root}/traces/batch={number}"
        dated = incoming.select(*self.schema.names, F.to_date(self._created()).alias("day"))
        # few files a day, and more than one task for a day that holds most rows
        dated.hint("rebalance", "day").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("day").parquet(folder)

        def describe(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["id"].astype(str)
            return pd.DataFrame(
                {
                    "file": [rows["file"].iloc[0]], "n": [len(rows)], "first_id": [min(ids)], "last_id": [max(ids)],
                    "newest": [rows["made"].max()], "bloom": [bloom_filter(rows["h"].to_numpy())],
                }
            )

        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("day", T.DateType())])).parquet(folder)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/traces/(batch=[^/]+/.*)$", 1)
        ids = stored.select(
            name.alias("file"), self._key().alias("id"), F.xxhash64(self._key()).alias("h"), self._created().alias("made")
        )
        described = ids.groupBy("file").applyInPandas(describe, MANIFEST.split(", ", 1)[1])  # a file has at most FILE_ROWS rows
        nothing = self.spark.createDataFrame([(None, 0, None, None, None, None)], MANIFEST.split(", ", 1)[1])
        # One file of narrow rows: a coalesce would do all of the describing in its one task.
        described.unionByName(nothing).repartition(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={number}")

    def stream(self, since=None) -> DataFrame:
        """The store as a stream: every trace of every append once, from ``since`` on, in appends after the checkpoint's."""
        self.spark.dataSource.register(TraceSource)
        options = {"path": qualified(self.spark, self.root), **({} if since is None else {"since": str(since)})}
        return self.spark.readStream.format("trace_store").schema(self.schema).options(**options).load()


class TraceSource(DataSource):
    """Streaming source over a store. Offsets are append numbers; a partition is one trace file, read by a task."""

    @classmethod
    def name(cls) -> str:
        return "trace_store"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TraceReader(self.options["path"], schema, self.options.get("since"))


@dataclass
class TraceFile(InputPartition):
    path: str


class TraceReader(DataSourceStreamReader):
    def __init__(self, root: str, schema: T.StructType, since: str | None):
        self.root, self.schema, self.since = root.rstrip("/"), schema, since

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def _files(self, number: int) -> list[str]:
        """Manifest files of an append, none if it is not committed."""
        from pyarrow import fs

        system, root = opened(self.root)
        found = system.get_file_info(fs.FileSelector(f"{root}/manifest/batch={number}", allow_not_found=True))
        return [f.path for f in found if f.path.endswith(".parquet")]

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = opened(self.root)
        folders = system.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True))
        numbers = sorted((int(f.base_name[6:]) for f in folders if f.base_name.startswith("batch=")), reverse=True)
        return {"batch": next((n for n in numbers if self._files(n)), -1)}

    def partitions(self, start: dict, end: dict) -> list[TraceFile]:
        from pyarrow import parquet

        system, root = opened(self.root)
        out = []
        for number in range(start["batch"] + 1, end["batch"] + 1):
            for path in self._files(number):
                names = parquet.read_table(path, filesystem=system, columns=["file"]).column("file").to_pylist()
                out += [TraceFile(f"{root}/traces/{name}") for name in names if name is not None]
        return out

    def _from(self, column: pa.ChunkedArray):
        """``since`` as a value of the time column's type."""
        if pa.types.is_timestamp(column.type):
            moment = pd.Timestamp(self.since)
            if column.type.tz and moment.tzinfo is None:
                moment = moment.tz_localize("UTC")
            return pa.scalar(moment, column.type)
        return pa.scalar(float(self.since)).cast(column.type)

    def read(self, partition: TraceFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import parquet
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = opened(self.root)
        wanted = to_arrow_schema(self.schema)
        with parquet.ParquetFile(system.open_input_file(partition.path), coerce_int96_timestamp_unit="us") as file:
            for batch in file.iter_batches(columns=self.schema.names):
                rows = pa.Table.from_batches([batch]).select(self.schema.names)
                rows = pa.table([_as(c, f.type) for c, f in zip(rows.columns, wanted)], schema=wanted)
                if self.since is not None:
                    rows = rows.filter(pc.greater_equal(rows.column("created_at"), self._from(rows.column("created_at"))))
                yield from rows.to_batches()


def _as(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """Stored instants have no zone in the file; they are UTC."""
    if pa.types.is_timestamp(kind) and kind.tz and not column.type.tz:
        return column.cast(pa.timestamp(kind.unit)).cast(pa.timestamp(kind.unit, "UTC")).cast(kind)
    return column.cast(kind)
