"""Centroid clustering of integer vectors by a bisector tournament.

The plane half-way between two centroids has the integer normal c_j - c_i and the threshold |c_j|^2 - |c_i|^2; both are made once a
round for every pair of centroids. A vector starts with centroid 0 as champion and meets 1, 2, .. in turn: the sign of
2 x . (c_j - c_i) - (|c_j|^2 - |c_i|^2) says which of champion i and challenger j is nearer, and zero keeps the smaller number. After k - 1
tests the champion is the nearest centroid, and only its distance is computed. All of it is exact in 64-bit integers.

Each task sends on one sum and count per centroid, so no rows are shuffled and a centroid may hold any share of them; the
driver sees k * dim numbers a round and the tasks get the same back.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part. Components
beyond +-limit(dim) are an error, because distances would leave 64 bits. Repeated rows are vectors of their own; a null id is no
first centroid unless there are too few others; equal hashes are ordered by vector. Fewer vectors than k give as many
centroids; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored

MAX_CENTROIDS = 512  # the pair tables hold k * k normals


def limit(dim: int) -> int:
    """Largest absolute component for which 2 x . n and squared distances stay within 2**62."""
    return math.isqrt(2**62 // dim) // 2


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of every usable vector."""
    usable = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    far = F.exists(scaled, lambda x: F.abs(x) > limit(dim))
    ints = F.transform(scaled, lambda x: F.floor(x).cast("bigint"))
    checked = F.when(far, F.raise_error(F.lit(f"a component is beyond {limit(dim)}"))).otherwise(ints)
    return vectors.filter(usable).select(F.col(id_col).alias("vec_id"), checked.alias("vec"))


def first_centroids(table: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = table.orderBy(digest.asc_nulls_last(), "vec").limit(k).select("vec").collect()  # k rows
    return np.array([r["vec"] for r in rows], dtype=np.int64)


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normals = centroids[None, :, :] - centroids[:, None, :]
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, vectors: np.ndarray) -> np.ndarray:
        champion = np.zeros(len(vectors), dtype=np.int64)
        for challenger in range(1, len(self.centroids)):
            side = 2 * np.einsum("nd,nd->n", vectors, self.normals[champion, challenger]) - self.thresholds[champion, challenger]
            champion[side > 0] = challenger
        return champion


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moved_centroids(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid with vectors becomes the floor of their exact mean; the others stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch, dim)
            won = tournament.winners(vectors)
            counts += np.bincount(won, minlength=k)
            np.add.at(sums, won, vectors)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    partial = table.select("vec").mapInArrow(run, "cluster int, n long, sums array<long>")
    whole = (
        partial.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    )
    moved = centroids.copy()
    for row in whole.collect():  # at most k * dim rows
        moved[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return moved


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector and the squared distance to it."""
    dim = centroids.shape[1]

    def run(batch: pa.RecordBatch):
        vectors = _matrix(batch, dim)
        won = Tournament(centroids).winners(vectors)
        apart = vectors - centroids[won]
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(won.astype(np.int32)), pa.array((apart * apart).sum(axis=1))], ["vec_id", "cluster", "distance"]
        )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.select("vec_id", "vec").mapInArrow(per_batch(run), f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Assignments of (vec_id, vec) after ``rounds`` rounds, stored, and the final centroids."""
    if not 0 < k <= MAX_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MAX_CENTROIDS}")
    table = stored(vectors, "vectors")
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        empty = table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return empty, centroids
    for _ in range(rounds):
        centroids = moved_centroids(table, centroids)
    return stored(assigned(table, centroids), "clusters"), centroids


def cluster_report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the inertia of each vector's cluster and of all, and the digest of its centroid."""
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    rows = [
        (i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist())
    ]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
