"""Reply order of linked conversations: every message stands behind the message it answers, before later answers to earlier ones.

A turn without a link answers the turn before it, so a conversation falls into runs of adjacent turns, cut only where a turn answers
an earlier one than the turn before. A run hangs on the turn it answers. Runs are read depth first: a run, then the runs on its last
turns before those on earlier ones, and on one turn by time. The tour is a linked list of "into" and "out of" steps of the runs, and
places are found by doubling: each round every step adds what its next step knows and jumps over it, so rounds grow with the
logarithm of the runs of a conversation, and no conversation or set of answers is ever in one task.

Only conversations that have such a cut take part. Keys may be null; rows that share a turn are one turn of several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import running_totals
from .common import stored

TURNS = 1024


def _step(kind: str, head: str) -> Column:
    """Name of a step of the tour; ``head`` is the first turn of its run, null for the run that starts the conversation."""
    return F.concat_ws("|", F.lit(kind), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.coalesce(F.col(head).cast("string"), F.lit("-")))


def _last_so_far(turns: DataFrame, mark: Column, name: str, own: bool) -> DataFrame:
    """Largest ``mark`` among the earlier turns of a conversation (and the turn's own where ``own``), bucket by bucket."""
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = turns.groupBy("conv_id", "bucket").agg(F.max(mark).alias("mark")).select(
        F.col("conv_id").alias("b_conv"), F.col("bucket").alias("b_bucket"), F.max("mark").over(earlier).alias("before_bucket")
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("bucket").eqNullSafe(F.col("b_bucket"))
    return turns.withColumn(name, F.max(mark).over(inside)).join(buckets, same).withColumn(name, F.coalesce(name, "before_bucket")).drop(
        "b_conv", "b_bucket", "before_bucket"
    )


def _places(runs: DataFrame) -> DataFrame:
    """(conv_id, head, behind): rows of a conversation from each run's first on, in the order of the tour."""
    # Siblings: later turns of the parent run first, then by time. Levels keep every bucket small.
    children = runs.filter("head is not null").withColumn("later", -F.col("parent_turn")).select(
        "conv_id", "parent", "head", F.floor(F.col("later") / TURNS).alias("far"), "later", F.floor(F.col("head") / TURNS).alias("near")
    )
    nth = running_totals(children, ["conv_id", "parent", "far", "later", "near"], ["head"], position="nth", restart=2)
    nth = stored(nth.select("conv_id", "parent", "head", "nth"), "reply-siblings")
    following = nth.select(F.col("conv_id").alias("f_conv"), F.col("parent").alias("f_parent"), F.col("head").alias("sibling"), (F.col("nth") - 1).alias("f_nth"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & F.col("parent").eqNullSafe(F.col("f_parent")) & (F.col("nth") == F.col("f_nth"))
    out = nth.join(following, same, "left").select(
        _step("out", "head").alias("step"), F.coalesce(F.when(F.col("sibling").isNotNull(), _step("in", "sibling")), _step("out", "parent")).alias("next"), F.lit(0).cast("bigint").alias("rows")
    )
    roots = runs.filter("head is null").select(_step("out", "head").alias("step"), F.lit(None).cast("string").alias("next"), F.lit(0).cast("bigint").alias("rows"))
    first = nth.filter("nth = 0").select(F.col("conv_id").alias("f_conv"), F.col("parent").alias("f_parent"), F.col("head").alias("child"))
    met = runs.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & F.col("head").eqNullSafe(F.col("f_parent")), "left")
    into = met.select(_step("in", "head").alias("step"), F.when(F.col("child").isNotNull(), _step("in", "child")).otherwise(_step("out", "head")).alias("next"), "rows")
    tour = stored(into.unionByName(out).unionByName(roots), "reply-tour")
    while not tour.filter("next is not null").isEmpty():
        ahead = tour.select(F.col("step").alias("next"), F.col("next").alias("next_next"), F.col("rows").alias("more"))
        jumped = tour.filter("next is not null").join(ahead, "next").select("step", F.col("next_next").alias("next"), (F.col("rows") + F.col("more")).alias("rows"))
        tour = stored(tour.filter("next is null").unionByName(jumped), "reply-tour")
    named = runs.withColumn("step", _step("in", "head")).drop("rows")
    return named.join(tour.select("step", F.col("rows").alias("behind")), "step")


def moves(rows: DataFrame, links: DataFrame) -> DataFrame | None:
    """(conv_id, turn, shift): what to add to a row's place by turns, for conversations that are out of reply order; None without any.

    ``rows`` has (conv_id, turn) of every message, ``links`` (conv_id, turn, parent_conv, parent_turn) of linked ones.
    """
    inner = links.filter(F.col("parent_conv").eqNullSafe(F.col("conv_id")) & (F.col("parent_turn") < F.col("turn")))
    inner = inner.select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), "parent_turn")
    if inner.isEmpty():
        return None
    meets = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    linked = rows.select("conv_id", "turn").join(inner.select("l_conv").distinct(), meets, "left_semi")
    turns = linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("turn") / TURNS))
    turns = turns.join(inner, meets & (F.col("turn") == F.col("l_turn")), "left").drop("l_conv", "l_turn")
    turns = _last_so_far(turns, F.col("turn"), "turn_before", own=False)
    cut = F.when(F.col("parent_turn") < F.col("turn_before"), F.col("turn"))
    turns = stored(_last_so_far(turns.withColumn("cut", cut), F.col("cut"), "head", own=True), "reply-turns")
    cuts = turns.filter("cut is not null")
    if cuts.isEmpty():
        return None
    branched = cuts.select(F.col("conv_id").alias("l_conv")).distinct()
    placed = running_totals(turns.join(branched, meets, "left_semi"), ["conv_id", "bucket"], ["turn"], sums=["n"], restart=1)
    placed = stored(placed.select("conv_id", "turn", "head", "n", "n_before", "cut", "parent_turn"), "reply-places")
    holders = placed.select(F.col("conv_id").alias("h_conv"), F.col("turn").alias("h_turn"), F.col("head").alias("parent"))
    on = F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("parent_turn") == F.col("h_turn"))
    parents = placed.filter("cut is not null").join(holders, on).select(
        F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_head"), "parent", "parent_turn"
    )
    sized = placed.groupBy("conv_id", "head").agg(F.sum("n").alias("rows"), F.min("n_before").alias("from"))
    same = F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("head") == F.col("p_head"))
    runs = stored(sized.join(parents, same, "left").drop("p_conv", "p_head"), "reply-runs")
    places = _places(runs)
    totals = runs.groupBy("conv_id").agg(F.sum("rows").alias("total")).withColumnRenamed("conv_id", "t_conv")
    shifted = places.join(totals, F.col("conv_id").eqNullSafe(F.col("t_conv"))).select(
        F.col("conv_id").alias("s_conv"), F.col("head").alias("s_head"), (F.col("total") - F.col("behind") - F.col("from")).alias("shift")
    )
    on = F.col("conv_id").eqNullSafe(F.col("s_conv")) & F.col("head").eqNullSafe(F.col("s_head"))
    return placed.join(shifted, on).select("conv_id", "turn", "shift")
