"""Reply order against a depth-first walk of each conversation's tree."""

import random

import pytest

from millrace.llm import quotations, reply_order


def walk(turns, parents):
    """Turns in reply order: children of a turn by time, a turn without a parent answers the one before."""
    children, before = {}, None
    for turn in sorted(turns, key=lambda t: (t is not None, t)):
        if before is not None or turn != min(turns, key=lambda t: (t is not None, t)):
            children.setdefault(parents.get(turn, before), []).append(turn)
        before = turn
    first = min(turns, key=lambda t: (t is not None, t))
    order, todo = [], [first]
    while todo:
        turn = todo.pop()
        order.append(turn)
        todo += reversed(children.get(turn, []))
    return order


@pytest.mark.parametrize("seed", [1, 2])
def test_places_equal_a_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(reply_order, "TURNS", 4)
    rng = random.Random(seed)
    rows, links, trees = [], [], {}
    for conv in [None, 5, 6, 7, 8]:
        turns = sorted(rng.sample(range(-20, 200), {7: 1, 8: 120}.get(conv, 30)))
        share = {8: 0.9, 6: 0.0}.get(conv, 0.4)
        parents = {t: rng.choice(turns[:i] if conv != 8 else turns[: min(i, 3)]) for i, t in enumerate(turns) if i and rng.random() < share}
        trees[conv] = (turns, parents)
        rows += [(conv, t) for t in turns for _ in range(1 + t % 2)]
        links += [(conv, t, conv, p) for t, p in parents.items()] + ([(conv, turns[0], 99, 3)] if conv else [])
    moved = reply_order.moves(
        spark.createDataFrame(rows, "conv_id long, turn long").repartition(5),
        spark.createDataFrame(links, "conv_id long, turn long, parent_conv long, parent_turn long"),
    ).collect()
    shift = {(r.conv_id, r.turn): r.shift for r in moved}
    assert len(moved) == len(shift)
    for conv, (turns, parents) in trees.items():
        before = {t: sum(1 + u % 2 for u in turns if u < t) for t in turns}
        got = sorted(turns, key=lambda t: before[t] + shift.get((conv, t), 0))
        assert got == walk(turns, parents)
        want, at = {}, 0
        for t in got:
            want[t], at = at, at + 1 + t % 2
        assert {t: before[t] + shift.get((conv, t), 0) for t in turns} == want


def test_conversations_in_reply_order(spark):
    said = ["Shall we meet on Friday in the main hall?", "And who brings the projector then, please?", "I can bring the projector from home.",
            "> Shall we meet on Friday in the main hall?\nYes, Friday.", "Good.", "> I can bring the projector from home.\nThanks!"]
    chats = spark.createDataFrame([(c, t, "user", text) for c in (1, 2) for t, text in enumerate(said[: 4 + 2 * (c == 1)])], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.reply_position, r.turn) for r in quotations.reply_ordered(chats).collect())
    assert [t for c, _, t in got if c == 1] == [0, 1, 2, 5, 3, 4] and [p for c, p, _ in got if c == 1] == list(range(6))
    assert [t for c, _, t in got if c == 2] == [0, 1, 2, 3]


def test_without_links_nothing_moves(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1)], "conv_id long, turn long")
    links = spark.createDataFrame([(1, 1, 1, 0)], "conv_id long, turn long, parent_conv long, parent_turn long")
    assert reply_order.moves(rows, links) is None and reply_order.moves(rows, links.limit(0)) is None


def test_one_turn_answered_by_a_third_of_all_rows(spark):
    n = 3000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn")
    links = spark.range(1, n).selectExpr("7L as conv_id", "id as turn", "7L as parent_conv", "0L as parent_turn")
    moved = reply_order.moves(rows, links)
    assert {(r.turn, r["shift"]) for r in moved.collect()} == {(t, 0) for t in range(n)}
