"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Files hold documents in ascending id order (nulls first; equal ids by text). A stripe can be read by a task of its own, and a
filter on ``doc_id`` is answered from file, stripe and row-group statistics and Bloom filters.

Defined results: a null text is empty; an empty text is the end id alone; repeated rows are documents of their own; an
empty table gives no documents. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Encoder, encoder, joined_batches, per_batch, stored

END_ID = 2
FILE_SCHEMA = "doc_id long, place long, tokens array<int>"


def encode_documents(docs: DataFrame, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, place, tokens) in ascending doc_id order; ``place`` is (partition << 33) + row."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", F.monotonically_increasing_id().alias("place"), "text")
    )

    def run(batch: pa.RecordBatch):
        offsets, ids = encoder(vocabulary).encode(batch.column("text"), end_id)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), lists], ["doc_id", "place", "tokens"])

    return ordered.mapInArrow(joined_batches(run, Encoder.GROUP_BYTES), FILE_SCHEMA)


def write_tokens(tokens: DataFrame, path: str, stripe_bytes: int = 16 << 20, index_rows: int = 1000, fpp: float = 0.01) -> None:
    (
        tokens.write.option("orc.compress", "SNAPPY")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", fpp)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_report(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts all ids before it.

    Sums run inside a file's rows; the offsets of files come from one total per file.
    """

    def run(batch: pa.RecordBatch):
        column = batch.column("tokens")
        offsets = np.asarray(column.offsets)
        values = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        pairs = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("place"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in pairs], pa.int64()),
            ],
            ["doc_id", "place", "n_tokens", "ids_crc32"],
        )

    each = stored(files.mapInArrow(per_batch(run), "doc_id long, place long, n_tokens long, ids_crc32 long"), "token-report")
    each = each.withColumn("part", F.shiftrightunsigned("place", 33))
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return each.join(offsets, "part").select(
        "doc_id",
        (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
