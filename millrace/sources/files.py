"""One file per row, written by tasks to the file system that a URI names.

``write_files`` is a Python data source: tasks write below ``_temporary/<job>/<attempt>`` and move a file to its name once all
of the attempt's files are whole, so a repeated or speculative task replaces files by equal ones and adds none. The driver
sees one count per task; when the job commits it removes the temporary folder and writes ``_SUCCESS`` with the totals, and when
the job fails it removes the temporary folder only (files of tasks that had ended stay, and the next run replaces them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that the session takes it for."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def opened(uri: str):
    """(file system, path on it) of a URI, in any Python process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class WrittenFiles(WriterCommitMessage):
    files: int
    size: int


class RowFiles(DataSource):
    """Sink of (name, bytes) rows. Options: ``folder`` (a URI) and ``job`` (a name for its temporary folder)."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("row files are added to a folder; use the append mode")
        return RowFilesWriter(self.options["folder"], self.options["job"])


class RowFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder.rstrip("/"), job

    def write(self, iterator: Iterator) -> WrittenFiles:
        system, root = opened(self.folder)
        attempt = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        names, size = [], 0
        for batch in iterator:
            for name, data in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                if not data.is_valid:
                    continue
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"not a file name: {name!r}")
                with system.open_output_stream(f"{attempt}/{len(names)}") as out:
                    out.write(data.as_buffer())
                names.append(name)
                size += len(data.as_buffer())
        for i, name in enumerate(names):
            source, target = f"{attempt}/{i}", f"{root}/{name}"
            try:
                system.move(source, target)
            except OSError:  # file systems that do not replace
                system.delete_file(target)
                system.move(source, target)
        return WrittenFiles(len(names), size)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        done = [m for m in messages if m is not None]
        system, root = opened(self.folder)
        self._clean(system, root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        self._clean(*opened(self.folder))

    def _clean(self, system, root: str) -> None:
        from pyarrow import fs

        folder = f"{root}/_temporary/{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
        # the folder above is shared with other jobs: gone only when it is empty
        above = f"{root}/_temporary"
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


def write_files(rows: DataFrame, folder: str, name: str = "file", data: str = "bytes") -> None:
    """One file ``folder``/name for every row with bytes. Rows of one name end as one file, the last one moved."""
    spark = rows.sparkSession
    spark.dataSource.register(RowFiles)
    options = {"folder": qualified(spark, folder), "job": uuid.uuid4().hex}
    rows.select(name, data).write.format("row_files").options(**options).mode("append").save()
