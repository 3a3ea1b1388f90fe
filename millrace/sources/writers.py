"""Sinks: JSON lines, Parquet per split, image files, sharded and partitioned output."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .files import write_files

# Leading bytes (hex) that name an image type, and the type of anything else.
IMAGE_SIGNATURES = [("89504E470D0A1A0A", "png"), ("FFD8", "jpg"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp")]
RIFF, WEBP, OTHER_IMAGE = "52494646", "57454250", "png"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return posixpath.join(checkpoint_dir(spark), "millrace", f"{name}-{uuid.uuid4().hex}")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def rl_wrapper(df: DataFrame) -> DataFrame:
    """RL-format copy of a table: placeholder prompt, rule reward without truth, the row as ``extra_info``."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.lit("placeholder").alias("content")))
    reward = F.struct(F.lit("rule").alias("style"), F.lit(None).cast("string").alias("ground_truth"))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(prompt.alias("prompt"), reward.alias("reward_model"), row.alias("extra_info"))


def write_split(df: DataFrame, folder: str, split: str, mode: str = "overwrite") -> dict[str, str]:
    """A split as Parquet, and its RL-format copy beside it."""
    plain, wrapped = f"{folder}/{split}.parquet", f"{folder}/{split}_rl.parquet"
    df.write.mode(mode).parquet(plain)
    rl_wrapper(df).write.mode(mode).parquet(wrapped)
    return {"path": plain, "rl_path": wrapped}


def image_type(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    kind = F.when(head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP), "webp")
    for signature, name in IMAGE_SIGNATURES:
        kind = kind.when(head.startswith(signature), name)
    return kind.otherwise(OTHER_IMAGE)


def named_images(images: DataFrame, row: str, image_index: str = "image_index", data: str = "bytes") -> DataFrame:
    """Image rows with the file name <row, six digits>_<image, two digits>.<type>."""
    name = F.format_string("%06d_%02d.%s", F.col(row), F.col(image_index), image_type(F.col(data)))
    return images.withColumn("file", name)


def image_lists(named: DataFrame, row: str, folder: str) -> DataFrame:
    """(row, images): file paths of each row in image order; images without bytes have none."""
    path = F.struct("image_index", F.concat(F.lit(folder + "/"), F.col("file")).alias("p"))
    files = F.sort_array(F.collect_list(F.when(F.col("bytes").isNotNull(), path)))
    return named.groupBy(row).agg(F.transform(files, lambda f: f["p"]).alias("images"))


def write_images(named: DataFrame, folder: str) -> None:
    """Image files on the file system of ``folder``; images without bytes have none."""
    write_files(named, folder)


def write_shards(df: DataFrame, path: str, max_rows: int = 10_000, mode: str = "errorifexists") -> None:
    """Files of at most ``max_rows`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).parquet(path)


def write_cache(train: DataFrame, val: DataFrame | None, folder: str) -> None:
    train.write.mode("overwrite").parquet(f"{folder}/train")
    if val is not None:
        val.write.mode("overwrite").parquet(f"{folder}/val")


def write_episode_log(episodes: DataFrame, path: str) -> None:
    """Episodes as JSON lines below mode=/epoch=/step= folders."""
    episodes.write.mode("append").partitionBy("mode", "epoch", "step").json(path)


def write_evaluation(episodes: DataFrame, metrics: DataFrame, folder: str) -> None:
    episodes.write.mode("overwrite").json(f"{folder}/episodes")
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
