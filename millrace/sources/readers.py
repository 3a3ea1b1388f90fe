"""Readers: files by extension, dataset references, corpora, evidence tables, tasks and image rows."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import with_shuffled_position

FORMATS = {"jsonl": "json", "txt": "text"}
FILE_FORMATS = ("json", "csv", "parquet", "text", "orc")


def file_format(path: str) -> str:
    extension = os.path.splitext(path)[1].lstrip(".")
    return FORMATS.get(extension, extension)


def load_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None, streaming: bool = False) -> DataFrame:
    """A table by file extension. In CSV nothing is read as missing: "NA" and empty fields stay text."""
    kind = file_format(path)
    reader = (spark.readStream if streaming else spark.read).format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
    return reader.load(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    if file_format(path) not in ("json", "csv", "parquet"):
        raise ValueError(f"unsupported file type: {path}")
    return load_file(spark, path)


def load_splits(spark: SparkSession, folder: str, splits: Sequence[str], extension: str = "parquet") -> DataFrame:
    """Splits of a local dataset folder, one after another, with a ``split`` column."""
    tables = [load_file(spark, f"{folder}/{s}.{extension}").withColumn("split", F.lit(s)) for s in splits]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


_REFERENCE = re.compile(
    r"(?:(?P<source>[^:/#]+)::)?(?P<rest>(?P<name>(?:[A-Za-z][\w+.-]*://)?[^:#]+)(?::(?P<subsets>[^:#]+))?(?:#(?P<n>\d+))?)"
)


@dataclass(frozen=True)
class DatasetReference:
    """``source::name:subset1/subset2#n``; every part but the name is optional."""

    name: str
    subsets: tuple[str, ...] = ()
    n: int | None = None
    source: str | None = None

    @classmethod
    def parse(cls, text: str, exists=os.path.exists) -> DatasetReference:
        """By one grammar; a URI keeps its scheme, and an existing path is a name whatever it holds."""
        found = _REFERENCE.fullmatch(text)
        if exists(text) or found is None:
            return cls(text.strip())
        if exists(found["rest"]):
            return cls(found["rest"].strip(), (), None, found["source"] and found["source"].lower())
        return cls(
            found["name"].strip(),
            tuple(s.strip() for s in found["subsets"].split("/")) if found["subsets"] else (),
            int(found["n"]) if found["n"] else None,
            found["source"] and found["source"].lower(),
        )


@dataclass(frozen=True)
class Subset:
    name: str
    weak: bool = False


def select_subsets(wanted: Sequence[str], available: Sequence[Subset]) -> list[str]:
    """Subset names to read: the listed ones, ``default`` or the only one; ``all`` leaves weak ones out."""
    held = {s.name: s for s in available}
    meanings = {(): [n for n in held if n == "default" or len(held) == 1]}
    if "all" not in held:
        meanings["all",] = [s.name for s in available if not s.weak]
    chosen = meanings.get(tuple(wanted), list(wanted))
    if held and not wanted and not chosen:
        raise ValueError(f"name a subset, one of {list(held)}")
    return chosen


def filter_subsets(df: DataFrame, wanted: Sequence[str], available: Sequence[Subset], column: str = "subset") -> DataFrame:
    return df.filter(F.col(column).isin(select_subsets(wanted, available)))


def read_corpus(spark: SparkSession, paths: str | Sequence[str], schema: str = "text string") -> DataFrame:
    """JSON-lines corpus, plain or gzip, by path or glob."""
    return spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths))


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """The table, or an error when a key occurs twice."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1))).scalar()
    failed = F.raise_error(F.lit(f"duplicate {key}")).cast("boolean")
    return df.filter(F.when(repeated == 0, True).otherwise(failed))


def read_evidence(spark: SparkSession, path: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Evidence TSV with header (doc_id, text, title), ids unique; optionally a share of its rows."""
    rows = spark.read.schema("doc_id int, text string, title string").csv(path, sep="\t", header=True)
    rows = unique_key(rows, "doc_id")
    if share >= 1.0:
        return rows
    from ..functions.seeded import seeded_unit

    return rows.filter(seeded_unit(seed, "evidence", "doc_id") < share)


def image_rows(df: DataFrame, key: str, images: str = "images") -> DataFrame:
    """(key, image_index, bytes): one row per image."""
    return df.select(key, F.posexplode(images).alias("image_index", "bytes"))


def strict_tasks(df: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejects): question and answer are required and must hold text; unknown columns raise."""
    allowed = {"question", "answer", "images"} | ({key} if key else set())
    missing, unknown = {"question", "answer"} - set(df.columns), set(df.columns) - allowed
    if missing or unknown:
        raise ValueError(f"missing columns {sorted(missing)}, unknown columns {sorted(unknown)}")
    reason = F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "empty question").when(
        F.coalesce(F.trim(F.col("answer").cast("string")), F.lit("")) == "", "empty answer"
    )
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def limit_rows(df: DataFrame, n: int | None, key: str, shuffle: bool = False, seed: int = 1) -> DataFrame:
    """All rows, the first n by key, or n drawn rows."""
    if n is None or n < 0:
        return df
    if shuffle:
        return with_shuffled_position(df, seed, "limit", key, position="__p").filter(F.col("__p") < n).drop("__p")
    from ..operators.ordering import with_position

    return with_position(df, key, "__p").filter(F.col("__p") < n).drop("__p")


def read_parquet_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def nested_field(df: DataFrame, column: str, keys: Sequence[str], name: str) -> DataFrame:
    """``column`` followed down the nested keys, as a column ``name``."""
    c = F.col(column)
    for key in keys:
        c = c.getField(key)
    return df.withColumn(name, c)


def image_text_pairs(texts: DataFrame, key: str, tokens: str, images: DataFrame, path: str, length: int, pad: int) -> DataFrame:
    """Texts with the image whose file name is their key, tokens cut or padded to ``length``."""
    stem = F.regexp_extract(F.col(path), r"([^/]+)\.[^./]+$", 1)
    named = images.withColumn("__key", stem)
    cut = F.slice(F.col(tokens), 1, length)
    filled = F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))
    return texts.withColumn(tokens, filled).join(named, F.col(key).cast("string") == F.col("__key")).drop("__key")


@dataclass
class DatasetMeta:
    """What the registry knows of a dataset: where it is, its subsets and splits, and its row mapping."""

    name: str
    path: str
    subsets: list[Subset] = field(default_factory=list)
    splits: list[str] = field(default_factory=lambda: ["train"])
    preprocess: object = None
    tags: list[str] = field(default_factory=list)
    subset_column: str = "subset"


_REGISTRY: dict[str, DatasetMeta] = {}


def register_meta(meta: DatasetMeta, replace: bool = False) -> None:
    if meta.name in _REGISTRY and not replace:
        raise ValueError(f"dataset {meta.name!r} is registered already")
    _REGISTRY[meta.name] = meta


def get_meta(name: str) -> DatasetMeta | None:
    return _REGISTRY.get(name)


def load_reference(spark: SparkSession, text: str, key: str | None = None, seed: int = 42) -> DataFrame:
    """Read, map and sample the dataset a reference string names."""
    from ..operators.sampling import sample_rows

    reference = DatasetReference.parse(text)
    meta = get_meta(reference.name)
    path = meta.path if meta else reference.name
    # A registered folder is read by its splits.
    df = load_splits(spark, path, meta.splits) if meta and file_format(path) not in FILE_FORMATS else load_file(spark, path)
    if meta and meta.subsets:
        df = filter_subsets(df, reference.subsets, meta.subsets, meta.subset_column)
    if meta and meta.preprocess:
        df = meta.preprocess(df)
    if reference.n is not None:
        if key is None:
            raise ValueError("a sampled reference needs the row key")
        df = sample_rows(df, reference.n, [key], seed).drop("copy")
    return df
