"""The corpus pipeline: reject toxic documents, drop near duplicates, redact secrets, mix sources, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``. A stage
works on all rows that the one before kept; its rows are written as Parquet and read again. Null and empty texts
pass the filters, have nothing to mix and so end at the mix; repeated rows are one group of copies; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, near_duplicates, packing, secrets, toxicity
from millrace.llm.common import prepared, read_table, stored
from millrace.llm.queries import quality_weights


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated toxicity score under 0.5."""
    return toxicity.drop_toxic(docs, read_table(prepared(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    prepared(spark)
    return near_duplicates.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with found secrets, also those under layers of encoding, replaced in the text."""
    prepared(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that every source reaches its target weight."""
    return mixing.materialise(docs, quality_weights(prepared(spark), sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences of at most 2048 tokens."""
    prepared(spark)
    return packing.pack(packing.pieces_of(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # trees, signatures and tokens are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
