"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

1. Every text becomes its set of 64-bit five-word shingle hashes, and COORDINATES minima of it. Texts with equal sets are one
   node from here on.
2. Each (coordinate, value) pair of a node is a posting. Two sets with similarity 0.75 agree in fewer than MATCHES
   coordinates with probability 2e-7, so of a node's postings only the COORDINATES - MATCHES + 1 rarest are merged (prefix), and
   those no other node has are skipped.
3. Nodes that meet in a posting list have their collisions counted, coordinate by coordinate, and pairs with MATCHES or more go on.
   First every node meets the list's hub, the one nearest to the list's commonest values; found pairs are confirmed on the full sets and
   merged into components.
4. Lists that still hold several components count the collisions of all pairs of different components, in blocks; the members that
   have such a pair get their full sets and are compared exactly inside the task. A pair is looked
   at in the first list that holds both, only links that join components leave a task, and pairs within a component,
   which cannot change it, are never made.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer than five words make one shingle; a
null doc_id takes part, its component is named by the smallest id there is, or null; repeated rows are copies. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored, worker_cache
from .components import component_labels

WORDS = 5
COORDINATES, MATCHES = 48, 20
BLOCK = 1024
PERCENT = 75
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MEMO = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text`` (A-Z lower-cased)."""
    memo = worker_cache("shingles").setdefault("word hashes", _WordHashes())
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashes = np.fromiter(map(memo.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    mixed = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[j : j + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, count, dtype=np.uint64) * 2 + 1, draw.integers(0, 2**63, count, dtype=np.uint64)


def minima(values: np.ndarray, count: int, seed: int) -> np.ndarray:
    """MinHash minima of a non-empty set under ``count`` multiply-add functions."""
    key = ("minhash", count, seed)
    cache = worker_cache("shingles")
    if key not in cache:
        cache[key] = _functions(count, seed)
    factor, shift = cache[key]
    best = None
    for at in range(0, len(values), 512):
        part = (values[at : at + 512, None] * factor + shift).min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, mins, signature): ``node`` is a 128-bit digest of the set, null when it is empty.

    ``signature`` has 32 bits of every minimum.
    """

    def run(batch: pa.RecordBatch):
        counts, nodes, mins, signatures = [], [], [], []
        for text in batch.column("text").to_pylist():
            values = shingle_set(text)
            counts.append(len(values))
            nodes.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            least = minima(values, COORDINATES, 11) if len(values) else None
            mins.append(None if least is None else least.view(np.int64))
            signatures.append(None if least is None else (least & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "node", "mins", "signature"],
        )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(per_batch(run), "doc_id long, text_hash long, n_shingles long, node binary, mins array<long>, signature binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(node, token, n, at, prefix): prefix postings that some other node has too.

    ``n`` is the whole list's length, ``at`` the coordinate; ``prefix`` has 32 bits of each coordinate in the node's prefix.
    """
    tokens = nodes.select("node", F.posexplode("mins").alias("at", "token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = tokens.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "at", "token"))).alias("own"))
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("own"))  # those with a list of their own come first
    prefix = kept.filter(room > 0).select("node", F.slice("own", F.lit(1), F.least(room, F.size("own"))).alias("own"))

    def run(batch: pa.RecordBatch):
        column = batch.column("own")
        offsets = np.asarray(column.offsets)
        posts = column.values
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        at, token = posts.field("at").to_numpy(), posts.field("token").to_numpy()
        bits = np.zeros((batch.num_rows, COORDINATES), dtype="<u4")
        bits[row, at] = (token.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype("<u4") | 1
        bits = pa.array([b.tobytes() for b in bits], pa.binary())
        where = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column("node").take(where), posts.field("token"), posts.field("n"), posts.field("at"), bits.take(where)],
            ["node", "token", "n", "at", "prefix"],
        )

    return prefix.mapInArrow(per_batch(run), "node binary, token long, n long, at int, prefix binary")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, shingles) of every node in ``wanted`` (node, doc_id, text_hash), from one of its texts."""

    def run(batch: pa.RecordBatch):
        rows = []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
            values = shingle_set(text)
            if hashlib.blake2b(values.tobytes(), digest_size=16).digest() == node:  # else another text with the same id and hash
                rows.append((node, len(values), values.view(np.int64)))
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64())]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "n", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    held = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select("node", "text")
    return held.mapInArrow(per_batch(run), "node binary, n long, shingles array<long>")


def _lists(keys: list[str], work):
    """``work(table, bounds)`` on the whole runs of equal ``keys`` of sorted partitions, whatever the batch borders."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows, dtype=bool)
            change[0] = True
            for k in keys:
                values = table[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(change).tolist()
            held = table.slice(starts[-1])
            if starts[-1]:
                yield from work(table.slice(0, starts[-1]), [(a, b) for a, b in zip(starts, starts[1:]) if b - a > 1])
        if held is not None and held.num_rows > 1:
            yield from work(held, [(0, held.num_rows)])

    return run


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["signature"].to_pylist()), dtype="<u4").reshape(-1, COORDINATES)


def _commonest(column: np.ndarray) -> int:
    values, counts = np.unique(column, return_counts=True)
    return values[counts.argmax()]


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], ["a", "b"]
    )


def _hub_pairs(table: pa.Table, bounds):
    """Every member of a list with its hub, where their collisions reach the threshold."""
    nodes, signatures = table["node"].to_pylist(), _signatures(table)
    pairs = []
    for start, end in bounds:
        part, hub = signatures[start:end], 0
        if end - start > 2:
            common = np.array([_commonest(part[:, j]) for j in range(COORDINATES)], dtype="<u4")
            hub = int((part == common).sum(axis=1).argmax())
        collisions = (part == part[hub]).sum(axis=1)
        pairs += [(nodes[start + hub], nodes[start + i]) for i in np.flatnonzero(collisions >= MATCHES).tolist() if i != hub]
    if pairs:
        yield _pairs_batch(pairs)


def _sides(table: pa.Table, start: int, end: int) -> np.ndarray | None:
    """Block numbers where a run holds two blocks: then only pairs across them are its own."""
    side = table["side"].to_numpy()[start:end]
    return side if side.min() != side.max() else None


def _open_members(table: pa.Table, bounds):
    """Members of a list with MATCHES collisions or more with one of another component, in the first list that both are in."""
    signatures, label = _signatures(table), np.array(table["label"].to_pylist(), dtype="S16")
    posts = np.frombuffer(b"".join(table["prefix"].to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
    at = table["at"].to_numpy()
    chosen = np.zeros(table.num_rows, dtype=bool)
    for start, end in bounds:
        side = _sides(table, start, end)
        _, code = np.unique(label[start:end], return_inverse=True)
        for i in range(end - start - 1):
            other = code[i + 1 :] != code[i]
            if side is not None:
                other &= side[i + 1 :] != side[i]
            rest = np.flatnonzero(other) + start + i + 1
            rest = rest[np.count_nonzero(signatures[rest] == signatures[start + i], axis=1) >= MATCHES]
            if len(rest):
                mine = posts[start + i]
                shared = (posts[rest] == mine) & (mine != 0)
                rest = rest[shared.argmax(axis=1) == at[start]]
                if len(rest):
                    chosen[rest] = True
                    chosen[start + i] = True
    if chosen.any():
        yield from table.select(["token", "low", "high", "side", "node", "label"]).filter(pa.array(chosen)).combine_chunks().to_batches()


def _new_links(table: pa.Table, bounds):
    """Confirmed links between components inside a list, as many as join them."""
    nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
    column = table["shingles"].combine_chunks()
    offsets, values = np.asarray(column.offsets), column.values.to_numpy()
    sizes = np.diff(offsets)
    pairs = []
    for start, end in bounds:
        side = _sides(table, start, end)
        root = {x: x for x in labels[start:end]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        base = offsets[start]
        _, code = np.unique(values[base : offsets[end]], return_inverse=True)
        held = np.zeros(int(code.max()) + 1, dtype=np.int64)
        for i in range(start, end - 1):
            own = code[offsets[i] - base : offsets[i + 1] - base]
            held[own] = 1
            both = np.add.reduceat(held[code[offsets[i + 1] - base :]], offsets[i + 1 : end] - offsets[i + 1])
            held[own] = 0
            near = 100 * both >= PERCENT * (sizes[i] + sizes[i + 1 : end] - both)
            if side is not None:
                near &= side[i + 1 - start :] != side[i - start]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                a, b = find(labels[i]), find(labels[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    pairs.append((nodes[i], nodes[j]))
    if pairs:
        yield _pairs_batch(pairs)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    near = pairs.distinct().join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("s_a", "s_b")).cast("bigint"))
    return near.filter(100 * F.col("both") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, node, label, text_hash) of every row of ``docs`` (doc_id, text).

    ``label`` names the component by its smallest node; it is null for texts without words.
    """
    each = stored(sketches(docs), "sketches")
    full = each.filter("node is not null")
    nodes = full.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("held"), F.count(F.lit(1)).alias("copies"),
        F.first("mins").alias("mins"), F.first("signature").alias("signature"),
    )
    nodes = stored(nodes, "nodes")
    posts = stored(_postings(nodes), "postings")
    wanted = posts.select("node").distinct().join(nodes.select("node", "held.doc_id", "held.text_hash"), "node")
    signatures = nodes.select("node", "signature")
    sets = stored(_full_sets(docs, wanted).dropDuplicates(["node"]), "sets")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    members = posts.select("token", own.alias("block"), "node").join(signatures, "node")
    dealt = members.repartition("token", "block").sortWithinPartitions("token", "block", "node")
    hubs = dealt.mapInArrow(_lists(["token", "block"], _hub_pairs), "a binary, b binary")
    links = stored(_confirmed(hubs, sets), "links")
    labels = component_labels(links)

    named = posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    open_lists = named.join(mixed.select("token"), "token").join(signatures, "node")
    paired = open_lists.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    meeting = ["token", "low", "high"]
    paired = paired.select(
        "token", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "label", "at", "prefix", "signature"
    )
    dealt = paired.repartition(*meeting).sortWithinPartitions(*meeting, "node")
    open_members = stored(
        dealt.mapInArrow(_lists(meeting, _open_members), "token long, low int, high int, side int, node binary, label binary"), "open-members"
    )
    dealt = open_members.join(sets.select("node", "shingles"), "node").repartition(*meeting).sortWithinPartitions(*meeting, "node")
    more_links = stored(dealt.mapInArrow(_lists(meeting, _new_links), "a binary, b binary"), "links")
    if more_links.head(1):
        labels = component_labels(links.unionByName(more_links))

    classes = nodes.select("node", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("members"))
    grouped = classes.join(smallest.filter("members > 1"), "label").select("node", "label", "component_id")
    return (
        each.drop("mins", "signature")
        .join(grouped, "node", "left")
        .withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("label", F.coalesce("label", "node"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node", "label", "text_hash")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id; texts without words all stay."""
    groups = stored(near_duplicate_groups(docs), "groups")
    named = groups.filter("kept and label is not null")
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("n"))
    keep = first.select(F.col("one.doc_id").alias("k_id"), F.col("one.text_hash").alias("k_hash"), "n").unionByName(
        groups.filter("label is null").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.lit(0).cast("bigint").alias("n")).distinct()
    )
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash"))
    kept = docs.join(keep, same, "left_semi")
    if first.filter("n > 1").head(1):  # a kept row comes more than once
        once = docs.join(keep.filter("n > 0"), same, "left_semi").dropDuplicates(["doc_id", "text"])
        return once.unionByName(docs.join(keep.filter("n = 0"), same, "left_semi"))
    return kept
