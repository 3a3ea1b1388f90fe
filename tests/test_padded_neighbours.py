"""Padded neighbour lists: the whole table is searched, and lists that are too short are filled up."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.operators import similarity


def test_short_lists_are_padded(spark):
    rows = [(1, "a", [0.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [2.0, 0.0]), (4, "a", [9.0, 0.0]), (5, "b", [0.4, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    found = similarity.nearest(vectors, vectors, "vec_id", "embedding", 3, group="label")
    got = {r.query: r.neighbours for r in similarity.padded_neighbours(found, vectors, "vec_id", 3).collect()}
    assert got == {1: [5, -1, -1], 2: [5, -1, -1], 3: [5, -1, -1], 4: [5, -1, -1], 5: [1, 2, 3]}


@pytest.mark.parametrize("name", ["j7_padded_whole_table"])
def test_all_vectors_are_searched(spark, sf_dir, name):
    lists = plans.queries()[name](spark, sf_dir).select(F.explode(F.split("neighbours", ",")).alias("n"))
    assert lists.filter("cast(n as bigint) >= 3").count() > 0


def test_blocks_of_queries_travel_once_to_a_task_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)
    monkeypatch.setattr(similarity, "MEETINGS_PER_CORE", 1)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(240, 6)).round(3)
    points[100:130] = points[100]  # copies, of all labels
    rows = [(i, None if i % 11 == 0 else "abc"[i % 3], points[i].tolist()) for i in range(240)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    sent = []
    meet = similarity._search_blocks

    def counted(visits, blocks, chunks, *args):
        out = meet(visits, blocks, chunks, *args).localCheckpoint()
        sent.append((visits.count(), blocks.count(), out.groupBy("chunk", "at").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(similarity, "_search_blocks", counted)
    found = similarity.nearest(vectors, vectors, "vec_id", "embedding", 5, group="label")
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    for i, label, _ in rows:
        others = [j for j, other, _ in rows if label is None or other != label]
        assert got[i] == sorted(others, key=lambda j: (np.linalg.norm(points[i] - points[j]), j))[:5], i
    # Not k rows a query from every meeting, but from every task.
    visits, n_blocks, most = sent[-1]
    side = min(similarity.MEETING_BLOCKS, math.isqrt(visits // spark.sparkContext.defaultParallelism))
    assert side > 1 and most <= 5 * -(-n_blocks // side)


@pytest.mark.parametrize("kind", ["near", "far", "huge"])
def test_single_precision_decides_nothing(kind):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(60, 16)), rng.normal(size=(300, 16))
    if kind == "near":
        a, b = 1000 + a * 1e-4, 1000 + b * 1e-4
    elif kind == "huge":
        a, b = a * 1e18, b * 1e18
    exact = np.array([[np.linalg.norm(x - y) for y in b] for x in a])
    groups = np.arange(60) % 4, np.arange(300) % 4
    exact[groups[0][:, None] == groups[1][None, :]] = np.inf
    for bounds in (np.full(60, np.inf), np.sort(exact, 1)[:, 9]):
        rows, columns, dist = similarity._within(a, groups[0], b, groups[1], bounds, 3)
        assert np.allclose(dist, exact[rows, columns], rtol=1e-12)
        found = set(zip(rows.tolist(), columns.tolist()))
        assert all((i, int(j)) in found for i in range(60) for j in np.argsort(exact[i])[:3])
