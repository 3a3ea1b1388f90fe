"""Exact similarity joins, near-duplicate removal and nearest neighbours without all-pairs work.

Text similarity is the Jaccard overlap of word shingles. Two sets over a threshold t share one of
their rarest |x| - ceil(t |x|) + 1 shingles, so candidates come from an equi join on those, are pruned by
size and place, and verified. Copies of one shingle set are compared once, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnOrName, col, let
from ..functions.seeded import seeded_hash
from ..functions.text import words
from ..session import cut_lineage, spread
from ..sources.files import path_exists
from .ordering import with_value_position
from .sampling import top_per_group

LEADERS = 8
HASH_SLOTS = 64  # equal parts of the hash range of shingles
BLOCK_ROWS = 4096
MAX_LEAVES, PIVOT_BYTES = 65_536, 32 << 20  # of the pivot tree, which every task gets
FIRST_VISITS, MEETING_BLOCKS, MEETINGS_PER_CORE = 4, 8, 4


# --- text ---------------------------------------------------------------------------------------


def shingle_hashes(c: ColumnOrName, n: int = 3) -> Column:
    """Distinct word n-grams of the normalised text as 64-bit hashes; a text under n words is one shingle."""

    def grams(tokens):
        count = F.size(tokens) - n + 1
        hashes = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])
        )
        whole = F.array(F.xxhash64(F.array_join(tokens, " ")))
        return F.when(count > 0, F.array_distinct(hashes)).when(F.size(tokens) > 0, whole)

    return let(words(F.lower(col(c))), grams)


def shingle_sets(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, n, grams): the shingle set of every row and its size, null for a row without words."""
    sets = spread(df.select(key, text)).select(key, shingle_hashes(text, n).alias("grams"))
    return sets.select(key, F.size("grams").alias("n"), "grams")


def _set_name(*columns: str) -> Column:
    """128 bits that name a set: two hashes of different seeds."""
    return F.concat_ws("-", F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))


def distinct_sets(df: DataFrame, key: str, text: str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows (key, set_id), and sets (set_id, n, grams): each distinct set once, named by its smallest row key.

    Keys are unique. Sets are read several times, so they are written out once instead of cutting every text again.
    """
    found = cut_lineage(shingle_sets(df, key, text, n).withColumn("grams", F.sort_array("grams")).withColumn("__set", _set_name("grams")))
    found = found.filter(F.col("grams").isNotNull())
    names = found.groupBy("__set").agg(F.min(key).alias("set_id"))
    sets = found.join(names.withColumnRenamed("set_id", key), ["__set", key], "left_semi")
    return found.select(key, "__set").join(names, "__set").select(key, "set_id"), sets.select(F.col(key).alias("set_id"), "n", "grams")


def _frequency(sets: DataFrame, at_least: int = 1) -> DataFrame:
    """(gram, df): the number of sets that hold each shingle."""
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return counts.filter(F.col("df") >= at_least)


def _rare_first(sets: DataFrame, name: str, frequency: DataFrame, threshold: float) -> DataFrame:
    """(name, n, grams): of each set of n shingles those that ``frequency`` holds, rarest first.

    Shingles it lacks match nothing, so their number is all that is kept of them; sets left with too few
    for the threshold go. The outer explode keeps Spark from cutting each text a second time for a null test.
    """
    exploded = sets.select(name, "n", F.explode_outer("grams").alias("gram"))
    known = exploded.join(frequency, "gram").groupBy(name).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g")
    )
    enough = known.filter(F.size("g") >= _least_shared(F.col("n"), threshold))
    return enough.select(name, "n", F.transform("g", lambda x: x["gram"]).alias("grams"))


def _least_shared(n: Column, threshold: float) -> Column:
    # The small margin keeps a product like 0.8 * 5 from rounding up past its integer.
    return F.ceil(n * F.lit(threshold) - 1e-9)


def _postings(sets: DataFrame, name: str, threshold: float) -> DataFrame:
    """(name, n, gram, rest): the rarest shingles of each set, enough of them for the threshold.

    ``rest`` is the number of the set's known shingles from this one on: the most that a pair can share
    when this is its first common one.
    """
    length = F.size("grams") - _least_shared(F.col("n"), threshold) + 1
    prefix = F.slice("grams", F.lit(1), F.least(length, F.size("grams")).cast("int"))
    placed = sets.select(name, "n", F.size("grams").alias("__known"), F.posexplode(prefix).alias("__at", "gram"))
    return placed.select(name, "n", "gram", (F.col("__known") - F.col("__at")).alias("rest"))


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key) of sets with a common posting whose sizes and places leave room for the threshold.

    Both sides hold their key, n, gram and rest. A pair over the threshold passes at its first common shingle.
    """
    pairs = left.withColumnsRenamed({"n": "__ln", "rest": "__lr"}).join(right.withColumnsRenamed({"n": "__rn", "rest": "__rr"}), "gram")
    room = F.least("__lr", "__rr") * F.lit(1 + threshold) >= (F.col("__ln") + F.col("__rn")) * F.lit(threshold) - 1e-9
    return pairs.filter(room)


def _scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key, score): Jaccard of the pairs. Known shingles hold all that two sets share."""
    named = left.withColumnsRenamed({"n": "__ln", "grams": "__lg"}), right.withColumnsRenamed({"n": "__rn", "grams": "__rg"})
    joined = pairs.join(named[0], "left_key").join(named[1], "right_key")
    shared = F.size(F.array_intersect("__lg", "__rg"))
    return joined.select("left_key", "right_key", (shared / (F.col("__ln") + F.col("__rn") - shared).cast("double")).alias("score"))


def _matchable_sets(df: DataFrame, key: str, text: str, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, set_id), and sets (set_id, n, grams) like those of ``distinct_sets``, without most that have no similar set.

    What is counted are neighbours in the sorted set, as two unlike texts seldom share them however large the table is. A similar set
    lacks u of the n shingles and adds v: u breaks two neighbourhoods each and v one each, at most 2 (1 - t) n together. So a
    set goes if more of them are its own. Those that start in a fixed part of the hash range suffice; they are all that is kept and
    shuffled of every set. The texts of the sets that stay are cut again.
    """
    slots = min(HASH_SLOTS, max(HASH_SLOTS // 4, math.ceil(2.4 * (1 - threshold) * HASH_SLOTS)))
    cut = shingle_sets(df, key, text, n).withColumn("grams", F.sort_array("grams"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i < F.col("n") - 1) & (F.pmod(F.get("grams", i), F.lit(HASH_SLOTS)) < slots))
    part = F.transform(starts, lambda i: F.xxhash64(F.get("grams", i), F.get("grams", i + 1)))
    found = cut_lineage(cut.select(key, "n", _set_name("grams").alias("__set"), part.alias("__part"))).filter(F.col("n") > 0)
    marked = found.select(F.xxhash64("__set").alias("__mark"), F.explode("__part").alias("__two"))
    own = marked.groupBy("__two").agg(F.min("__mark").alias("__mark"), F.max("__mark").alias("__last")).filter("__mark = __last")
    own = own.groupBy("__mark").agg(F.count(F.lit(1)).alias("__own"))
    names = cut_lineage(found.groupBy("__set").agg(F.min(key).alias("set_id"), F.first("n").alias("n")))
    few = F.coalesce("__own", F.lit(0)) <= F.col("n") * F.lit(2 * (1 - threshold)) + 1e-9
    stay = names.withColumn("__mark", F.xxhash64("__set")).join(own, "__mark", "left").filter(few)
    texts = df.select(F.col(key).alias("set_id"), F.col(text).alias("__text")).join(stay.select("set_id", "__mark"), "set_id")
    again = cut_lineage(texts.select("set_id", "__mark", F.sort_array(shingle_hashes("__text", n)).alias("grams")))
    sets = again.filter(F.xxhash64(_set_name("grams")) == F.col("__mark"))  # a key may come with other texts too
    rows = found.select(key, "__set").join(names.select("__set", "set_id"), "__set").select(key, "set_id")
    return rows, sets.select("set_id", F.size("grams").alias("n"), "grams")


def similar_rows(
    df: DataFrame, key: str, text: str, other: DataFrame, other_key: str, other_text: str, threshold: float,
    n: int = 3, inclusive: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows (key, left_key), and pairs (left_key, right_key, score) over the threshold (or from it on).

    Any one order of the shingles will do, so they are counted in the other table only. Of ``df`` nothing
    but the shingles found there is shuffled or kept; rows alike in them are compared once.
    """
    _, theirs = distinct_sets(other, other_key, other_text, n)
    frequency = _frequency(theirs)
    right = _rare_first(theirs.withColumnRenamed("set_id", "right_key"), "right_key", frequency, threshold)
    mine = cut_lineage(_rare_first(shingle_sets(df, key, text, n), key, frequency, threshold).withColumn("left_key", _set_name("n", "grams")))
    left = mine.select("left_key", "n", "grams").dropDuplicates(["left_key"])
    pairs = _candidates(_postings(left, "left_key", threshold), _postings(right, "right_key", threshold), threshold)
    scored = _scored(pairs.select("left_key", "right_key").distinct(), left, right)
    over = F.col("score") >= threshold if inclusive else F.col("score") > threshold
    return mine.select(key, "left_key"), scored.filter(over)


def contaminated_keys(
    df: DataFrame, key: str, text: str, other: DataFrame, other_key: str, other_text: str, threshold: float,
    n: int = 3, top_k: int | None = None, inclusive: bool = False,
) -> DataFrame:
    """Keys of rows similar to any row of the other table.

    With ``top_k`` only the most similar k rows of ``df`` count for each row of the other table.
    """
    rows, pairs = similar_rows(df, key, text, other, other_key, other_text, threshold, n, inclusive)
    if top_k is None:
        return rows.join(pairs, "left_key", "left_semi").select(key)
    # Rows of one set tie, so a set needs no more than its k smallest keys.
    members = top_per_group(rows, ["left_key"], [F.asc(key)], top_k, "__m")
    ranked = top_per_group(pairs.join(members, "left_key"), ["right_key"], [F.desc("score"), F.asc(key)], top_k, "__r")
    return ranked.select(key).distinct()


def decontaminate(
    df: DataFrame, key: str, text: str, other: DataFrame, other_key: str, other_text: str, threshold: float = 0.95,
    n: int = 3, top_k: int | None = None, inclusive: bool = False,
) -> DataFrame:
    """Rows of ``df`` that are not similar to any row of the other table."""
    hits = contaminated_keys(df, key, text, other, other_key, other_text, threshold, n, top_k, inclusive)
    return df.join(hits, key, "left_anti")


def drop_listed_errors(df: DataFrame, key: str, text: str, errors: DataFrame, error_text: str, threshold: float = 0.99) -> DataFrame:
    """Drop the row that each listed text stands for: its most similar row, from the threshold on."""
    listed = errors.select(F.md5(error_text).alias("__e"), F.col(error_text).alias("__t")).dropDuplicates(["__e"])
    return decontaminate(df, key, text, listed, "__e", "__t", threshold, top_k=1, inclusive=True)


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.792, n: int = 3) -> DataFrame:
    """Keys to remove so that the rest is what a pass in key order keeps: a row goes when a kept row
    before it is similar.

    Most sets without a similar one go first. Each round compares the undecided sets of a shingle bucket with the bucket's smallest ones, its leaders, and
    confirms the pairs. A set that leads all its buckets has met every set before it that could be
    similar: without a confirmed one it is kept, and sets similar to it go. Families of copies go in the first
    rounds; leaders grow eightfold, so buckets of unlike sets take a number of rounds that grows with the
    logarithm of their size. Once every set leads, only the confirmed pairs are left to decide on.
    """
    rows, sets = _matchable_sets(df, key, text, threshold, n)
    # A shingle of one set only joins nothing.
    known = cut_lineage(_rare_first(sets, "set_id", _frequency(sets, 2), threshold))
    earlier, later = known.withColumnRenamed("set_id", "left_key"), known.withColumnRenamed("set_id", "right_key")
    undecided = cut_lineage(_postings(known, "set_id", threshold))
    removed, n_leaders, complete, edges = [], LEADERS, False, None
    while True:
        if not complete:
            leaders = top_per_group(undecided, ["gram"], [F.asc("set_id")], n_leaders, "__rank").drop("__rank")
            pairs = _candidates(leaders.withColumnRenamed("set_id", "left_key"), undecided.withColumnRenamed("set_id", "right_key"), threshold)
            pairs = pairs.filter("left_key < right_key").select("left_key", "right_key").distinct()
            edges = cut_lineage(_scored(pairs, earlier, later).filter(F.col("score") > threshold).select("left_key", "right_key"))
            behind = undecided.join(leaders, ["gram", "set_id"], "left_anti")
            waiting = cut_lineage(behind.select("set_id").distinct())
            complete = waiting.isEmpty()
        if complete and edges.isEmpty():
            break
        beaten = edges.select(F.col("right_key").alias("left_key"))
        kept = edges.join(beaten, "left_key", "left_anti").join(waiting.withColumnRenamed("set_id", "left_key"), "left_key", "left_anti")
        lost = cut_lineage(kept.select(F.col("right_key").alias("set_id")).distinct())
        removed.append(lost)
        gone = lost.withColumnRenamed("set_id", "left_key"), lost.withColumnRenamed("set_id", "right_key")
        edges = cut_lineage(edges.join(gone[0], "left_key", "left_anti").join(gone[1], "right_key", "left_anti"))
        if not complete:
            still = waiting.unionByName(edges.select(F.col("left_key").alias("set_id"))).unionByName(edges.select(F.col("right_key").alias("set_id")))
            undecided = undecided.join(still, "set_id", "left_semi").join(lost, "set_id", "left_anti")
            undecided = cut_lineage(undecided)
            n_leaders *= 8
    copies = rows.filter(F.col(key) != F.col("set_id")).select(key)
    out = [rows.join(lost, "set_id", "left_semi").filter(F.col(key) == F.col("set_id")).select(key) for lost in removed]
    return reduce(DataFrame.unionByName, out, copies)


def drop_near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.792, n: int = 3) -> DataFrame:
    return df.join(near_duplicates(df, key, text, threshold, n), key, "left_anti")


# --- vectors ------------------------------------------------------------------------------------


def embed(
    df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray], done: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, embedding, kept columns) by batches; rows that ``done`` already has are left out, so a stopped run goes on."""
    rows = df if done is None else df.join(done.select(key), key, "left_anti")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            vectors = np.asarray(embedder(list(pdf[text])), dtype="float32")
            yield pd.DataFrame({key: pdf[key], "embedding": list(vectors), **{n: pdf[n] for n in keep}})

    kept = "".join(f", `{n}` {df.schema[n].dataType.simpleString()}" for n in keep)
    return rows.select(key, text, *keep).mapInPandas(run, f"`{key}` {kind}, embedding array<float>{kept}")


BLOCK_FACTS = "block long, n long, digest string"


def _block_facts(rows: DataFrame, key: str) -> DataFrame:
    """(block, n, digest): the rows of a block and a digest of their ids and vectors that does not depend on their order."""
    mark = F.xxhash64(key, F.transform("embedding", lambda x: x.cast("double"))).cast("decimal(38,0)")
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.md5(F.sum(mark).cast("string")).alias("digest"))


def embed_blocks(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray], folder: str, n_blocks: int) -> list[int]:
    """Embeddings of ``df`` in blocks dealt by key hash, below ``folder``; blocks that are whole are left alone.

    A block is whole if its stored rows have the count and digest that the manifest names, and are as many as ``df`` has for it. All others
    are made again, each in its folder, and the manifest gets their facts after that, so a run that stops goes on. Gives the
    numbers of the blocks that were made.
    """
    spark = df.sparkSession
    dealt = df.select(key, text, F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"))
    wanted = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a block
    whole = {block: n for block, n in check_blocks(spark, folder, key, df.schema[key].dataType).items() if n == wanted.get(block)}
    missing = sorted(set(wanted) - set(whole))
    if not missing:
        return []
    made = embed(dealt.filter(F.col("block").isin(missing)), key, text, embedder, keep=["block"])
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{folder}/vectors")
    facts = _block_facts(_stored_blocks(spark, folder, key, df.schema[key].dataType).filter(F.col("block").isin(missing)), key)
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{folder}/manifest")
    return missing


def _stored_blocks(spark, folder: str, key: str, kind: T.DataType) -> DataFrame:
    fields = [T.StructField(key, kind), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("block", T.LongType())]
    return spark.read.schema(T.StructType(fields)).option("ignoreCorruptFiles", "true").parquet(f"{folder}/vectors")


def check_blocks(spark, folder: str, key: str, kind: T.DataType) -> dict[int, int]:
    """Blocks whose stored rows are those the manifest names, with their number of rows."""
    if not (path_exists(spark, f"{folder}/vectors") and path_exists(spark, f"{folder}/manifest")):
        return {}
    named = spark.read.schema(BLOCK_FACTS).parquet(f"{folder}/manifest")
    there = _block_facts(_stored_blocks(spark, folder, key, kind), key)
    return {r["block"]: r["n"] for r in there.join(named, ["block", "n", "digest"]).collect()}  # one row a block


def read_blocks(spark, folder: str, key: str, kind: T.DataType) -> DataFrame:
    """(key, embedding) of the blocks written by ``embed_blocks``."""
    return _stored_blocks(spark, folder, key, kind).select(key, "embedding")


def train_clusters(df: DataFrame, key: str, vector: str, k: int, n_sample: int, seed: int = 42):
    """Cluster model from a seeded sample of the vectors."""
    sample = df.orderBy(seeded_hash(seed, "clusters", key)).limit(n_sample)
    features = sample.select(array_to_vector(F.col(vector)).alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)


def assign_clusters(df: DataFrame, model, vector: str) -> DataFrame:
    return model.transform(df.withColumn("features", array_to_vector(F.col(vector)))).drop("features")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


class PivotTree:
    """Leaf pivots, each below the cell pivot it is nearest to. The first pivots are the cells' own."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.cells = pivots[: max(1, math.isqrt(len(pivots)))]
        owner = _distances(pivots, self.cells).argmin(1)
        self.leaves = [np.flatnonzero(owner == cell) for cell in range(len(self.cells))]

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, leaf, distance to its pivot) of every vector: the nearest cell, in it the nearest leaf."""
        near = _distances(vectors, self.cells)
        near[:, [i for i, x in enumerate(self.leaves) if not len(x)]] = np.inf  # cells of repeated pivots
        cell = near.argmin(1)
        leaf, apart = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            d = _distances(vectors[rows], self.pivots[self.leaves[c]])
            at = d.argmin(1)
            leaf[rows], apart[rows] = self.leaves[c][at], d[np.arange(len(rows)), at]
        return cell, near[np.arange(len(vectors)), cell], leaf, apart

    def within(self, vectors: np.ndarray, bounds: np.ndarray, radius: dict[int, float]) -> list[tuple[int, float, float, float]]:
        """(leaf, nearest, from, to) for the leaves that may hold a row within any vector's bound: the distance of the nearest vector to the
        leaf's pivot, and the distances from the pivot at which such rows lie."""
        norms, out = np.linalg.norm(vectors, axis=1), []
        near = _distances(vectors, self.cells)
        for cell, reach in radius.items():
            # Distances are rounded in proportion to the vectors; a visit too many changes nothing.
            slack = 1e-6 + 1e-7 * (2 * norms + 3 * near[:, cell] + np.where(np.isfinite(bounds), bounds, 0))
            rows = np.flatnonzero(near[:, cell] - reach <= bounds + slack)
            if not len(rows):
                continue
            d = _distances(vectors[rows], self.pivots[self.leaves[cell]])
            limit = (bounds + slack + 1e-7 * norms)[rows, None] + 3e-7 * d
            for leaf, nearest, low, high in zip(self.leaves[cell].tolist(), d.min(0), (d - limit).min(0), (d + limit).max(0)):
                out.append((leaf, float(nearest), float(low), float(high)))
        return out


def _pivot_tree(corpus: DataFrame, key: str, vector: str, seed: int) -> PivotTree | None:
    """None without rows, else a tree of about one leaf per BLOCK_ROWS rows, of at most MAX_LEAVES and PIVOT_BYTES, from rows drawn by hash."""
    facts = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dim")).first()
    leaves = max(1, min(-(-facts["n"] // BLOCK_ROWS), MAX_LEAVES, PIVOT_BYTES // (8 * max(1, facts["dim"] or 1))))
    chosen = corpus.orderBy(seeded_hash(seed, "pivots", key)).limit(leaves).select(vector).collect()
    return PivotTree(np.array([r[0] for r in chosen], dtype="float64")) if chosen else None


def _packed(rows: DataFrame, tree: PivotTree, wide: bool) -> DataFrame:
    """(name, cell, leaf, block, low, high, far, ids, gs, v): rows (id, g, v) in blocks of at most BLOCK_ROWS of one leaf, cut by the
    distance to its pivot, their vectors as one binary value, rows by id; ``far`` is the greatest distance to the cell's pivot."""
    place = T.StructType([T.StructField(n, t) for n, t in (("cell", T.IntegerType()), ("far", T.DoubleType()), ("leaf", T.LongType()), ("d", T.DoubleType()))])

    @F.pandas_udf(place)
    def placed(vs: pd.Series) -> pd.DataFrame:
        found = tree.place(np.stack(vs.to_numpy())) if len(vs) else [[]] * 4
        return pd.DataFrame(dict(zip(["cell", "far", "leaf", "d"], found)))

    # Places are Python work and are read several times: written out once.
    kept = cut_lineage(spread(rows).withColumn("p", placed("v")).select("id", "g", "v", "p.*").withColumn("row", F.monotonically_increasing_id()))
    numbered = with_value_position(kept, "d", "row", "__at", within=["leaf"]).withColumn("block", F.floor(F.col("__at") / BLOCK_ROWS))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        d, (leaf, block) = table.column("d").to_numpy(), (table.column(n)[0].as_py() for n in ("leaf", "block"))
        one = {
            "name": [f"{leaf}:{block}"], "cell": table.column("cell").slice(0, 1), "leaf": [leaf], "block": [block],
            "low": [float(d.min())], "high": [float(d.max())], "far": [float(table.column("far").to_numpy().max())],
            "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)),
            "gs": pa.array([table.column("g").to_pylist()], pa.list_(pa.string())), "v": [values.astype("<f8" if wide else "<f4").tobytes()],
        }
        return pa.table({n: x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for n, x in one.items()})

    packed = numbered.drop("__at").groupBy("leaf", "block").applyInArrow(
        pack, f"name string, cell int, leaf long, block long, low double, high double, far double, ids array<{kind}>, gs array<string>, v binary"
    )
    return cut_lineage(packed)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    key: str,
    vector: str,
    k: int,
    group: str | None = None,
    metric: str = "l2",
    seed: int = 42,
) -> DataFrame:
    """(query, rank, neighbour, score): the exact k nearest corpus rows of every query.

    ``metric`` is ``l2`` (smallest distance) or ``ip`` (largest inner product). With ``group``, rows of
    the query's own group are left out.

    Rows hang on a tree of pivots with two levels and are cut, by distance to their leaf's pivot, into blocks of at most BLOCK_ROWS; so are
    the queries. A block of queries first meets the nearest block of its own leaf, then the FIRST_VISITS nearest ones, and last
    all that the bounds found so far leave; what a block may still hold follows from the distances of its cell, leaf and band. Blocks
    travel as binary values, once to each task that needs them, which has up to MEETING_BLOCKS of either side. A task works on bounded
    matrices, tightens the bounds from block to block and sends on at most k rows a query.
    """
    if metric not in ("l2", "ip"):
        raise ValueError(f"unknown metric {metric!r}")
    base = [F.col(key).alias("id"), (F.lit(None).cast("string") if group is None else F.col(group).cast("string")).alias("g")]
    c = corpus.select(*base, F.col(vector).cast("array<double>").alias("v"))
    q = queries.select(*base, F.col(vector).cast("array<double>").alias("v"))
    single = all(f.schema[vector].dataType.elementType == T.FloatType() for f in (queries, corpus))
    wide = metric == "ip" or not single
    if metric == "ip":
        # One more coordinate makes all corpus rows equally long; distance order is then product order.
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        top = c.agg(F.max(norm)).first()[0] or 0.0
        c = c.withColumn("v", F.concat("v", F.array(F.sqrt(F.greatest(F.lit(top) - norm, F.lit(0.0))))))
        q = q.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    kind = c.schema["id"].dataType.simpleString()
    empty = f"query {q.schema['id'].dataType.simpleString()}, rank int, neighbour {kind}, score double"
    tree = _pivot_tree(c, "id", "v", seed)
    if tree is None:
        return queries.sparkSession.createDataFrame([], empty)
    blocks = _packed(c, tree, wide)
    chunks = blocks if queries is corpus and metric == "l2" else _packed(q, tree, wide)
    bands = blocks.select("name", "leaf", "low", "high")
    radius = {r["cell"]: r["r"] for r in blocks.groupBy("cell").agg(F.max("far").alias("r")).collect()}  # one row a cell
    # queries may be the corpus: their columns get names of their own
    chunks = chunks.select(F.col("name").alias("chunk"), *[F.col(n).alias(f"q_{n}") for n in ("leaf", "low", "high", "ids", "gs", "v")])
    none = F.array().cast("array<struct<at: int, bound: double>>")

    # the nearest block of the own leaf
    own = chunks.select("chunk", F.col("q_leaf").alias("leaf"), F.col("q_low").alias("a"), F.col("q_high").alias("b")).join(bands, "leaf")
    gap = F.struct(F.greatest(F.col("low") - F.col("b"), F.col("a") - F.col("high"), F.lit(0.0)), F.abs(F.col("low") + F.col("high") - F.col("a") - F.col("b")), "name")
    visits = own.groupBy("chunk").agg(F.min_by("name", gap).alias("name"))
    found = done = None
    for round_ in range(3):
        if round_:
            limits = found.groupBy("chunk", "at").agg(F.max(F.struct("rank", "dist")).alias("last")).filter(F.col("last.rank") == k)
            limits = limits.groupBy("chunk").agg(F.collect_list(F.struct("at", F.col("last.dist").alias("bound"))).alias("bounds"))
            bounded = chunks.join(limits, "chunk", "left").withColumn("bounds", F.coalesce("bounds", none))
            reached = _reach(bounded, tree, radius, wide)
            near = (F.col("low") <= F.col("b")) & (F.col("high") >= F.col("a"))
            visits = reached.join(bands, "leaf").filter(near).join(done, ["chunk", "name"], "left_anti")
            if round_ == 1:
                apart = F.greatest(F.col("low") - F.col("nearest"), F.col("nearest") - F.col("high"), F.lit(0.0))
                order = Window.partitionBy("chunk").orderBy(apart, "nearest", "name")
                visits = visits.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= FIRST_VISITS)
            visits = cut_lineage(visits.select("chunk", "name"))
        else:
            bounded = chunks.withColumn("bounds", none)
            visits = cut_lineage(visits)
        met = _search_blocks(visits, blocks, bounded, k, kind, metric, wide)
        met = met if found is None else met.unionByName(found.drop("rank"))
        best = Window.partitionBy("chunk", "at").orderBy("dist", "neighbour")
        found = cut_lineage(met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        done = visits if done is None else done.unionByName(visits)
    names = chunks.select("chunk", F.posexplode("q_ids").alias("at", "query"))
    return found.join(names, ["chunk", "at"]).select("query", "rank", "neighbour", "score")


def _block(v: bytes, n: int, wide: bool) -> np.ndarray:
    return np.frombuffer(v, dtype="<f8" if wide else "<f4").reshape(n, -1).astype("float64")


def _bounds(n: int, known: list[dict]) -> np.ndarray:
    out = np.full(n, np.inf)
    for x in known:
        out[x["at"]] = x["bound"]
    return out


def _reach(chunks: DataFrame, tree: PivotTree, radius: dict[int, float], wide: bool) -> DataFrame:
    """(chunk, leaf, nearest, a, b): the leaves a block of queries may have to visit, and the band of distances there."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _block(row["q_v"], row["n"], wide)
                found = tree.within(vectors, _bounds(row["n"], row["bounds"]), radius)
                yield pd_to_batch([(row["chunk"], *x) for x in found])

    def pd_to_batch(rows):
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk", "leaf", "nearest", "a", "b"])

    return chunks.select("chunk", "q_v", "bounds", F.size("q_ids").alias("n")).mapInArrow(run, "chunk string, leaf long, nearest double, a double, b double")


def _search_blocks(visits: DataFrame, blocks: DataFrame, chunks: DataFrame, k: int, kind: str, metric: str, wide: bool) -> DataFrame:
    """(chunk, at, neighbour, dist, score): of the rows of every visited (chunk, name) those within the bound of a query, the k nearest of a task.

    A task takes up to MEETING_BLOCKS blocks of queries and as many of the corpus, fewer where there would not be tasks for all cores.
    """
    cores = visits.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(MEETING_BLOCKS, math.isqrt(visits.count() // (MEETINGS_PER_CORE * cores))))

    def part(name: str, n: int) -> Column:
        return F.floor(F.pmod(F.xxhash64(name), F.lit(1 << 30)) % F.lit(max(1, -(-n // side))))

    dealt = visits.select("chunk", "name", part("chunk", chunks.count()).alias("part"), part("name", blocks.count()).alias("block_part"))
    asked = dealt.groupBy("chunk", "part", "block_part").agg(F.collect_list("name").alias("names"))
    asked = asked.join(chunks.select("chunk", "q_ids", "q_gs", "q_v", "bounds"), "chunk")
    met = dealt.select("name", F.col("part").alias("met_part"), F.col("block_part").alias("met_block_part")).distinct()
    held = blocks.select(F.col("name").alias("block_name"), *[F.col(n).alias(n) for n in ("ids", "gs", "v")])
    held = held.join(met, F.col("block_name") == F.col("name")).drop("name")
    inner = metric == "ip"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, there, all_ids = {}, {}, []
        for block in (r for i in range(len(right)) for r in right.slice(i, 1).to_pylist()):
            n = len(block["ids"])
            there[block["block_name"]] = (len(all_ids), _block(block["v"], n, wide), np.array([-1 if g is None else codes.setdefault(g, len(codes)) for g in block["gs"]]))
            all_ids += block["ids"]
        places = {x: i for i, x in enumerate(sorted(set(all_ids), key=lambda x: (x is not None, x)))}
        order = np.array([places[x] for x in all_ids], dtype=np.int64)
        out = []
        for row in (r for i in range(len(left)) for r in left.slice(i, 1).to_pylist()):
            n = len(row["q_ids"])
            a, bounds = _block(row["q_v"], n, wide), _bounds(n, row["bounds"])
            groups = np.array([-2 if g is None else codes.get(g, -2) for g in row["q_gs"]])
            best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
            for start, b, b_groups in (there[name] for name in sorted(row["names"])):
                found = [_within(a[at : at + 512], groups[at : at + 512], b, b_groups, bounds[at : at + 512], k) for at in range(0, n, 512)]
                rows = np.concatenate([x[0] + 512 * i for i, x in enumerate(found)])
                columns, dist = (np.concatenate([x[i] for x in found]) for i in (1, 2))
                exact = (a[rows] * b[columns]).sum(1) if inner else dist
                rows, columns, dist, exact = (np.concatenate(x) for x in zip(best, (rows, columns + start, dist, exact)))
                by = np.lexsort((order[columns], dist, rows))
                rank = np.arange(len(by)) - np.searchsorted(rows[by], rows[by])
                by = by[rank < k]
                best = rows[by], columns[by], dist[by], exact[by]
                last = rank[rank < k] == k - 1
                bounds[best[0][last]] = np.minimum(bounds[best[0][last]], best[2][last])
            out.append((row["chunk"], *best))
        return pa.table(
            {
                "chunk": pa.array([c for c, rows, *_ in out for _ in rows], pa.string()),
                "at": pa.array(np.concatenate([x[1] for x in out] or [[]]).astype(np.int32)),
                "neighbour": pa.array([all_ids[j] for x in out for j in x[2].tolist()], right.schema.field("ids").type.value_type),
                "dist": pa.array(np.concatenate([x[3] for x in out] or [[]]).astype(float)),
                "score": pa.array(np.concatenate([x[4] for x in out] or [[]]).astype(float)),
            }
        )

    return asked.groupBy("part", "block_part").cogroup(held.groupBy("met_part", "met_block_part")).applyInArrow(
        search, f"chunk string, at int, neighbour {kind}, dist double, score double"
    )


def _within(
    a: np.ndarray, a_groups: np.ndarray, b: np.ndarray, b_groups: np.ndarray, bounds: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of pairs of different groups: for each row of ``a`` all of its k nearest that lie within its bound, and few more.

    One product in single precision decides which pairs are measured: what it may be off by is added to every limit.
    """
    # Moved to their middle, vectors far from the origin lose nothing in the products.
    middle = b.mean(0)
    middle[~np.isfinite(middle)] = 0.0
    ac, bc = a - middle, b - middle
    norms, b_norms = (ac * ac).sum(1), (bc * bc).sum(1)
    most = np.fmax.reduce(b_norms, initial=0.0)
    small = max(np.fmax.reduce(norms, initial=0.0), most) < 1e30
    kind = np.float32 if small else np.float64
    rounding = (a.shape[1] + 8) * 2 * float(np.finfo(kind).eps)
    slack = rounding * (np.sqrt(norms) + math.sqrt(most)) ** 2 + 1e-30
    near = (-2.0 * ac).astype(kind) @ bc.T.astype(kind)
    near += b_norms.astype(kind)
    limit = (bounds * (1 + 1e-6) + 1e-6) ** 2 - norms + slack
    own = [(a_groups == g, b_groups == g) for g in np.unique(a_groups) if g >= 0]
    for rows, columns in own:
        if columns.all():
            limit[rows] = -np.inf
        elif columns.any():
            near[np.ix_(rows, columns)] = np.inf
    open_ = np.flatnonzero(np.isposinf(limit) | np.isnan(limit))
    if len(open_) and len(b) > k:
        limit[open_] = np.partition(near[open_], k - 1, axis=1)[:, k - 1] + 2 * slack[open_]
    # Rounded up, so that no limit is lowered by its own conversion.
    hit = near <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]
    if np.isinf(limit).any():
        hit &= near < np.inf
    crowded = np.flatnonzero(hit.sum(1) > 4 * k + 64)
    if len(crowded):
        # Many rows as near as the bound, as copies are: the k nearest by the product in double precision.
        d = _distances(ac[crowded], bc)
        d[~hit[crowded]] = np.inf
        hit[crowded] = False
        hit[(crowded[(at := _smallest(d, bounds[crowded], k))[0]], at[1])] = True
    rows, columns = np.divmod(np.flatnonzero(hit), len(b))
    dist = np.concatenate([np.linalg.norm(a[rows[i : i + 65_536]] - b[columns[i : i + 65_536]], axis=1) for i in range(0, len(rows), 65_536)] or [np.empty(0)])
    kept = dist <= bounds[rows] * (1 + 1e-6) + 1e-6
    kept &= np.isfinite(dist)
    return rows[kept], columns[kept], dist[kept]


def _smallest(d: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k smallest finite distances within its bound; of equal ones at the edge the first columns."""
    edge = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    edge = np.minimum(edge, bounds * (1 + 1e-6) + 1e-6)[:, None]
    less, same = d < edge, (d == edge) & np.isfinite(d)
    same &= np.cumsum(same, axis=1) <= k - less.sum(1)[:, None]
    return np.nonzero((less & np.isfinite(d)) | same)


def padded_neighbours(found: DataFrame, queries: DataFrame, key: str, k: int, pad: int = -1) -> DataFrame:
    """(query, neighbours): ids in rank order, filled up with ``pad`` to k."""
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("n"))
    joined = queries.select(F.col(key).alias("query")).join(lists, "query", "left")
    ids = F.coalesce(F.transform("n", lambda x: x["neighbour"].cast("bigint")), F.array().cast("array<bigint>"))
    fill = F.array_repeat(F.lit(pad).cast("bigint"), F.lit(k) - F.size(ids))
    return joined.select("query", F.concat(ids, fill).alias("neighbours"))
