"""Exact top-k inner product search over a bit-sliced index.

Every vector component becomes floor(scale * x). A block of rows keeps, per dimension, one bitmap for each bit of
(value - smallest value). For a query the bitmaps are added with weights by bitmap adders (three bitmaps of
one weight become a sum and a carry); the score's own slices come out. The top k rows are selected from the most
significant score slice downward; rows still equal after the last slice are cut by the smaller id.

Blocks and groups of queries meet as pairs: a query goes to every block once, a block to every QUERY_ROWS queries once, or to a few
groups more where there are fewer blocks than cores.

Defined results: vectors that are null, empty or hold null or non-finite components take no part. Every row is a candidate and, if
asked for, a query of its own, also where rows share an id; only a query's own row is left out. A null id comes last among equal scores.
Vectors meet only vectors of their own length. Components or scores that do not fit in 64 bits are an error. Empty tables give no
rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BLOCK_ROWS = 32_768
QUERY_ROWS = 16_384


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(row, id, vec), stored: every usable row with a number of its own and integer components."""
    usable = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    ints = F.transform(scaled, lambda x: F.floor(x).cast("bigint"))
    checked = F.when(F.exists(scaled, lambda x: F.abs(x) >= 2.0**62), F.raise_error(F.lit("a component does not fit in 62 bits"))).otherwise(ints)
    chosen = vectors.filter(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), checked.alias("vec"))
    return stored(chosen, "quantised")


def _slices(rows: np.ndarray, values: np.ndarray) -> dict:
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-len(rows) // 64)
    planes = np.zeros((values.shape[1], bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        planes[:, b, : packed.shape[0]] = packed.T
    return {"rows": rows.astype("<i8").tobytes(), "low": low.astype("<i8").tobytes(), "bits": bits, "planes": planes.tobytes()}


INDEX = "dim int, block int, n int, bits int, ids array<bigint>, rows binary, low binary, planes binary"
INDEX_ROW = pa.schema(
    [(n, pa.int32()) for n in ("dim", "block", "n", "bits")] + [("ids", pa.list_(pa.int64()))] + [(n, pa.binary()) for n in ("rows", "low", "planes")]
)


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of about ``block_rows`` vectors of one length (rows dealt by hash), by id inside a block, stored."""
    count = vectors.count()
    blocks = max(1, -(-count // block_rows))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        values = table.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        made = {"dim": dim, "block": block, "n": len(table), "ids": table.column("id").to_pylist(), **_slices(table.column("row").to_numpy(), values)}
        return pa.Table.from_pylist([made], INDEX_ROW)

    dealt = vectors.select(
        "row", "id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    )
    return stored(dealt.groupBy("dim", "block").applyInArrow(pack, INDEX), "bit-sliced")


def _add(weighted: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum of all bitmaps; ``weighted[k]`` holds stacks of bitmaps of weight 2**k."""
    out, k, carried = [], 0, []
    while k <= max(weighted, default=-1) or carried:
        stack = [s for s in (*weighted.get(k, ()), *carried) if len(s)]
        carried = []
        now = np.concatenate(stack) if stack else None
        while now is not None and len(now) > 1:
            if len(now) == 2:
                carried.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
                break
            m = len(now) // 3
            a, b, c, rest = now[:m], now[m : 2 * m], now[2 * m : 3 * m], now[3 * m :]
            half = a ^ b
            carried.append((a & b) | (half & c))
            half ^= c
            now = np.concatenate([half, rest]) if len(rest) else half
        out.append(now)
        k += 1
    return out


def _search_block(row: dict, query_rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int | None, int]]:
    """(query row, id, score) of the ``k`` best rows of a block for each query."""
    n, dim, bits = row["n"], row["dim"], row["bits"]
    ids, rows = row["ids"], np.frombuffer(row["rows"], dtype="<i8")
    places = {r: i for i, r in enumerate(rows.tolist())}
    low = np.frombuffer(row["low"], dtype="<i8")
    planes = np.frombuffer(row["planes"], dtype="<u8").reshape(dim, bits, -1)
    words = planes.shape[2]
    live = np.packbits(np.arange(words * 64) < n, bitorder="little").view("<u8")
    found = []
    for qrow, q in zip(query_rows.tolist(), queries):
        size = np.abs(q).astype(np.uint64)
        flipped = planes ^ np.where(q < 0, ~np.uint64(0), np.uint64(0))[:, None, None]
        weighted: dict[int, list[np.ndarray]] = {}
        for i in range(int(size.max(initial=0)).bit_length()):
            chosen = np.flatnonzero((size >> np.uint64(i)) & np.uint64(1))
            for b in range(bits):
                weighted.setdefault(i + b, []).append(flipped[chosen, b])
        total = _add(weighted)
        # value = low + above, and for a negative weight above is taken as (2**bits - 1) - above
        base = sum(int(x) * int(y) for x, y in zip(q.tolist(), low.tolist()))
        base -= sum(-int(x) for x in q.tolist() if x < 0) * (2**bits - 1)
        equal = live.copy()
        own = places.get(qrow)
        if own is not None:
            equal[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        taken = np.zeros_like(equal)
        for plane in reversed(total):
            ones = np.zeros_like(equal) if plane is None else plane[0] & equal
            ahead = int(np.bitwise_count(taken).sum() + np.bitwise_count(ones).sum())
            if ahead > k:
                equal = ones
            else:
                taken |= ones
                equal &= ~ones
                if ahead == k:
                    equal[:] = 0
                    break
        sure = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little"))
        ties = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))[: k - len(sure)]
        for r in (*sure.tolist(), *ties.tolist()):
            score = base
            for weight, plane in enumerate(total):
                if plane is not None and (int(plane[0, r // 64]) >> (r % 64)) & 1:
                    score += 1 << weight
            found.append((qrow, ids[r], score))
    return found


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all indexed rows but the query's own, for each row of ``queries``.

    ``queries`` has (row, id, vec). Groups of queries meet blocks of the index; a meeting sends on k rows per query.
    """
    blocks = max(1, index.agg(F.max("block") + 1).first()[0] or 1)
    cores = index.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-queries.count() // query_rows), -(-2 * cores // blocks))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    keys = ["dim", "block", "part"]
    asked = queries.select(
        "row", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block")
    )
    held = index.select("*", every(parts).alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            (block,) = left.select(["n", "dim", "bits", "ids", "rows", "low", "planes"]).to_pylist()
            values = right.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, block["dim"])
            out = _search_block(block, right.column("row").to_numpy(), values, k)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["row", "vec_id", "score"], columns)})

    best = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
