"""Literal cases."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import answers, chat, registry, rewards, text
from millrace.operators import batch, blend, corpus, groups, metrics, packing, rows
from millrace.sources import readers, writers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_group_mean_std(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "g int, s double")
    got = {r["g"]: (r["mean"], r["std"], r["n"]) for r in metrics.group_mean_std(df, "g", "s").collect()}
    assert got[0] == (2.0, pytest.approx(math.sqrt(2)), 2)
    assert got[1] == (0.0, 1.0, 1)
    assert metrics.group_mean_std(df.filter("g > 5"), "g", "s").count() == 0


def test_best_at_n_exact(spark):
    df = spark.createDataFrame([("s", 1, float(v)) for v in range(1, 6)], "src string, p int, v double")
    row = metrics.best_worst_at_n(df, "src", "p", "v", [3]).first()
    draws = [max(a, b, c) for a in range(1, 6) for b in range(1, 6) for c in range(1, 6)]
    assert row["best_at_n_exact"] == pytest.approx(sum(draws) / len(draws)) == pytest.approx(4.2)


@pytest.mark.parametrize("votes,want", [([("A", 0.9), ("B", 0.8), ("A", 0.7)], 0.9), ([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)], 0.9)])
def test_majority(spark, votes, want):
    df = spark.createDataFrame([(1, i, v, x) for i, (v, x) in enumerate(votes)], "g int, i int, vote string, val double")
    assert metrics.majority_value(df, ["g"], "vote", "val", "i").first()["majority"] == want


def test_validation_means(spark):
    df = spark.createDataFrame([("s1", "p1", 0.8), ("s1", "p1", 0.9), ("s2", "p2", 0.7)], "s string, p string, v double")
    got = {r["s"]: r["mean_at_n"] for r in metrics.mean_std_at_n(df, "s", "p", "v").collect()}
    assert got["s1"] == pytest.approx(0.85)


def test_boxed_answers(spark):
    assert one(spark, answers.unbox(F.lit(r"The answer is \boxed{42}"))) == "42"
    assert one(spark, answers.unbox(F.lit(r"\boxed{\frac{1}{2}} and \boxed{3}"))) == r"\frac{1}{2}"
    assert one(spark, answers.unbox(F.lit(r"\boxed{1"))) is None
    assert one(spark, answers.final_answer(F.lit(r"<think>x</think> so \boxed{100}"))) == "100"


@pytest.mark.parametrize(
    "response,want",
    [
        ("<think>a</think> It was **Paris** then", "Paris"),
        ("Founded on March 3, 1999 by them", "March 3, 1999"),
        ("He met John Ronald Smith there", "John Ronald Smith"),
        ("about 250 people came", "250"),
        ("the answer is: blue whale.", "blue whale"),
        ("", ""),
    ],
)
def test_short_answer(spark, response, want):
    assert one(spark, answers.short_answer(F.lit(response))) == want


@pytest.mark.parametrize(
    "response,want",
    [("(B)", "B"), ("The answer is C", "C"), ("I think it must be the red one surely", "A"), ("?", "A"), ("(A) no, (C)", "C"), ("A) or (B)", "B")],
)
def test_choice_answer(spark, response, want):
    options = F.array(F.lit("red"), F.lit("green"), F.lit("blue"))
    assert one(spark, answers.choice_answer(F.lit(response), list("ABC"), options)) == want


@pytest.mark.parametrize("response,golds,want", [("so it is 3,000.", ["3000"], True), ("x = 4", ["4"], True), ("maybe 5", ["4"], False), ("thus Blue", ["blue"], True)])
def test_open_answer(spark, response, golds, want):
    assert one(spark, answers.open_answer_correct(F.lit(response), F.array(*[F.lit(g) for g in golds]))) is want


def test_final_number(spark):
    assert one(spark, answers.final_number(F.lit("x #### 1,234"))) == "1234"
    assert one(spark, answers.final_number(F.lit("no"), "strict")) is None
    assert one(spark, answers.final_number(F.lit("a 3 then 7.5 ."), "flexible")) == "7.5"


def test_countdown(spark):
    def score(s):
        return one(spark, answers.countdown_score(F.lit(s), F.lit(24), F.array(F.lit(4), F.lit(6))))

    assert score("<answer>4 * 6</answer>") == 1.0
    assert score("<answer>4 + 6</answer>") == pytest.approx(0.1)
    assert score("<answer>4 * 6 * 1</answer>") == pytest.approx(0.1)
    assert score("<answer>__import__('os')</answer>") == pytest.approx(0.1)
    assert score("24") == 0.0


def test_rewards(spark):
    assert one(spark, rewards.format_reward(F.lit("<think>a\nb</think>\n<answer>c</answer>"))) == 1.0
    assert one(spark, rewards.format_reward(F.lit("<think>a</think><answer>c</answer>\n"))) == 0.0
    assert one(spark, rewards.format_reward(F.lit("<think>a</think>\nAction: x\nAction Input: y\nmore"), rewards.REACT)) == 1.0
    assert one(spark, text.repetition_penalty(F.lit("a b c a b c"))) == pytest.approx(-0.25)
    assert one(spark, text.repetition_penalty(F.lit("a b"))) == 0.0
    assert one(spark, rewards.soft_overlong(F.lit(950), 1000, 100)) == pytest.approx(-0.5)
    assert one(spark, rewards.vote_average(F.array(F.lit("1"), F.lit("x"), F.lit("2")))) == 1.5
    assert one(spark, rewards.cosine_length_reward(F.lit(True), F.lit(0))) == 1.0
    assert one(spark, rewards.cosine_length_reward(F.lit(False), F.lit(1000))) == pytest.approx(0.0)


def test_answer_normal_form(spark):
    assert one(spark, text.normalize_answer(F.lit("The  an A.B; é a!"))) == "ab é"
    f1 = one(spark, answers.token_f1(F.lit("a red red fox"), F.lit("red fox red dog")))
    assert (f1["precision"], f1["recall"]) == (1.0, 0.75)
    assert one(spark, answers.token_f1(F.lit("yes"), F.lit("yes it is")))["f1"] == 0.0
    assert one(spark, answers.anls(F.lit("Helo"), F.array(F.lit("hello"), F.lit("zzz")))) == pytest.approx(0.8)


def test_chat(spark):
    messages = F.array(chat.message("system", F.lit("s")), chat.message("user", F.lit("q")))
    assert one(spark, chat.render_chat(messages)) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>"
    h = one(spark, chat.history_of(messages))
    assert (h["query"], h["response"], h["system"], h["history"]) == ("q", None, "s", [])
    turns = F.array(*[chat.message(r, F.lit(r)) for r in ("system", "user", "assistant", "user", "assistant")])
    counts = F.array(*[F.lit(n) for n in (1, 2, 3, 1, 2)])
    assert one(spark, chat.loss_mask(turns, counts, "all")) == [0] * 3 + [1] * 3 + [0] + [1] * 2
    assert one(spark, chat.loss_mask(turns, counts, "last")) == [0] * 7 + [1] * 2
    assert one(spark, chat.loss_mask(turns, counts, "after_first")) == [0] * 3 + [1] * 3 + [0] + [1] * 2
    parts = one(spark, chat.delimiter_weights(F.lit("a<x>b"), {"<.>": (3.0,)}))
    assert [tuple(p) for p in parts] == [("a", 1.0), ("<x>", 3.0), ("b", 1.0)]


def test_aliases():
    assert rows.resolve_aliases(["Question", "TEXT"], rows.RESPONSE_COLUMNS) == {"Question": "query", "TEXT": "response"}
    assert rows.resolve_aliases(["answer", "response"], rows.RESPONSE_COLUMNS) == {}


def test_strict_rows_raise(spark):
    df = spark.createDataFrame([([("user", None)],)], "messages array<struct<role string, content string>>")
    assert rows.validate_messages(df)[1].first()["reason"] == "null content"
    with pytest.raises(Exception, match="null content"):
        rows.validate_messages(df, strict=True)[0].collect()


def test_batch_table(spark):
    df = spark.createDataFrame([(i, i + 1, c) for i, c in enumerate("abcdef")], "pos long, obs int, label string")
    with pytest.raises(Exception, match="not divisible"):
        batch.chunk(df, 5).collect()
    chunks = batch.chunk(df, 2)
    assert sorted(r["chunk"] for r in chunks.collect()) == [0, 0, 0, 1, 1, 1]
    halves = [chunks.filter(f"chunk = {i}").withColumn("pos", F.col("pos") - 3 * i).drop("chunk") for i in (0, 1)]
    assert [r["label"] for r in batch.concat(halves).orderBy("pos").collect()] == list("abcdef")
    counted = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "label string, n int")
    assert sorted(r["label"] for r in batch.repeat_by_count(counted, "n").collect()) == list("aaabcc")
    assert batch.merge_meta([{"a": 1, "metrics": 1}, {"a": 1, "metrics": [2]}]) == {"a": 1, "metrics": [1, 2]}
    with pytest.raises(ValueError):
        batch.merge_meta([{"a": 1}, {"a": 2}])
    clash = df.withColumn("label", F.lit("z"))
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(df, clash).collect()


def test_limits_and_fixed_rows(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "t array<int>")
    assert [r["t"] for r in corpus.limit_length(df, "t", 2, "split").collect()] == [[1, 2], [3, 4], [5]]
    assert corpus.limit_length(df, "t", 2, "left").first()["t"] == [1, 2]
    assert corpus.limit_length(df, "t", 2, "right").first()["t"] == [4, 5]
    with pytest.raises(Exception, match="longer than 2"):
        corpus.limit_length(df, "t", 2, "error").collect()
    row = df.select(corpus.fixed_length_row("t", "t", 7, 9, 0).alias("r")).first()["r"]
    assert (row["input"], row["label"]) == ([1, 2, 3, 4, 5, 9, 0], [2, 3, 4, 5, 9, -100, -100])
    assert row["mask"] == [1, 1, 1, 1, 1, 0, 0]


def test_blend_config():
    assert blend.parse_blend(["30", "a", "70", "b"]) == (["a", "b"], [30.0, 70.0])
    assert blend.parse_blend(["a", "b"]) == (["a", "b"], None)
    assert blend.dataset_sizes([30, 70], 10, 0.005) == [4, 8]
    assert corpus.split_bounds([0.99, 0.01, 0.0]) == [(0.0, 0.99), (0.99, 1.0), None]
    assert corpus.split_bounds([0.5, 0.5, 0], [0.4, 0.6, 0]) == [(0.0, 0.4), (0.5, 1.0), None]


def test_spans_and_generated_words(spark):
    spans = F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("end")))
    assert one(spark, rows.replace_spans(F.lit("the cat sat"), spans, "<>")) == "the <> sat"
    made = corpus.char_count_rows(spark.range(50), "id", 5, 20).collect()
    for r in made:
        word = r["prompt"].split("word ")[1].rstrip("?").split("-")
        target = r["prompt"].split()[2]
        assert 5 <= len(word) <= 20 and word.count(target) == r["gold"] >= 1
        assert r["response"].endswith(f"\\boxed{{{r['gold']}}} {target} in {'-'.join(word)}.")


def test_dataset_references():
    parse = readers.DatasetReference.parse
    assert parse("HF::org/name:a/b#20", lambda p: False) == readers.DatasetReference("org/name", ("a", "b"), 20, "hf")
    assert parse("/data/x#1.jsonl", lambda p: p == "/data/x#1.jsonl").n is None
    with pytest.raises(ValueError):
        readers.select_subsets([], [readers.Subset("a"), readers.Subset("b")])


def test_readers_check_input(spark, tmp_path):
    bad = tmp_path / "e.tsv"
    bad.write_text("doc_id\ttext\ttitle\n1\ta\tb\n1\tc\td\n")
    with pytest.raises(Exception, match="duplicate doc_id"):
        readers.read_evidence(spark, str(bad)).collect()
    with pytest.raises(ValueError, match="unknown columns"):
        readers.strict_tasks(spark.createDataFrame([("q", "a", 1)], "question string, answer string, x int"))


def test_catalog(spark):
    from millrace.sources.catalog import Catalog

    catalog = Catalog(spark, "millrace_test")
    catalog.register(spark.range(3), "numbers", "train")
    assert catalog.names() == ["numbers"] and catalog.splits("numbers") == ["train"]
    assert catalog.load("numbers", "train").count() == 3 and catalog.load("numbers", "val") is None
    assert catalog.remove("numbers") and not catalog.exists("numbers")
    spark.sql("DROP DATABASE millrace_test CASCADE")


def test_images(spark, tmp_path):
    df = spark.createDataFrame([(7, [bytearray(b"\x89PNG\r\n\x1a\n"), None, bytearray(b"GIF89a..")])], "row long, images array<binary>")
    named = writers.named_images(readers.image_rows(df, "row"), "row")
    writers.write_images(named, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix in (".png", ".gif")) == ["000007_00.png", "000007_02.gif"]
    assert writers.image_lists(named, "row", "d").first()["images"] == ["d/000007_00.png", "d/000007_02.gif"]


def test_user_functions(spark, tmp_path):
    (tmp_path / "r.py").write_text("def score(source, solution, truth, bonus=0):\n    return float(solution == truth) + bonus\n")
    scored = registry.load_reward(str(tmp_path / "r.py"), "score", bonus=2)
    assert one(spark, scored(F.lit("s"), F.lit("a"), F.lit("a"))) == 3.0
    with pytest.raises(Exception, match="no score for data source z"):
        spark.range(1).select(registry.route_scores(F.lit("z"), {"a": F.lit(1.0)})).collect()
    numbers = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.lit("x").alias("h"), "id").repartition(5)
    found = registry.accumulate_metric(numbers, ["g", "h"], "id", lambda: 0, lambda s, v: max(s, int(v.max())), max, float)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "x", 49999.0), (2, "x", 49997.0), (None, "x", 49998.0)]
    assert registry.mean_metric(numbers.limit(0), ["h"], "id").count() == 0


def test_messages_and_history_as_text(spark):
    texts = ["[{'from': 'human', 'value': 'a\\'b'}, {'from': 'gpt', 'value': 'c'}]", '[{"user": "q", "assistant": "r\\u00e9"}]', "no list", None]
    made = rows.standardise(spark.createDataFrame([(t,) for t in texts], "conversations string"))
    got = [None if r["messages"] is None else [(m["role"], m["content"]) for m in r["messages"]] for r in made.collect()]
    assert got == [[("user", "a'b"), ("assistant", "c")], [("user", "q"), ("assistant", "r\u00e9")], None, None]
    inner = spark.createDataFrame([("{'turns': [{'role': 'user', 'content': 'x'}]}",)], "messages string")
    assert rows.from_messages(inner, inner_key="turns").first()["messages"][0]["content"] == "x"
    past = spark.createDataFrame([("q2", "r2", "[['q1', 'r1']]"), ("q", "r", None)], "query string, response string, history string")
    assert [[m["content"] for m in r["messages"]] for r in rows.standardise(past).collect()] == [["q1", "r1", "q2", "r2"], ["q", "r"]]


def test_returns_and_soft_mean(spark):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(3000)], "t int, s long, r double")
    got = {r["s"]: r["return"] for r in groups.discounted_returns(df, ["t"], "s", "r", 0.5).collect()}
    assert len(got) == 3000 and got[0] == pytest.approx(2.0) and got[2999] == 1.0 and got[1023] == pytest.approx(2.0)
    constant = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, r double")
    assert groups.drop_constant_groups(constant, ["g"], "r").count() == 2
    assert [r["t"] for r in spark.createDataFrame([([1.0, 2.0, 3.0],)], "t array<double>").select(groups.reverse_cumulative("t").alias("t")).collect()] == [[6.0, 5.0, 3.0]]


def test_packing_rules():
    assert packing.largest_first([5, 3, 4, 2], 8) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        packing.largest_first([9], 8)
    parts = packing.differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(c for c, p in zip([8, 7, 6, 5, 4], parts) if p == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    equal = packing.differencing(list(range(12)), 3, equal_size=True)
    assert [equal.count(k) for k in range(3)] == [4, 4, 4]


def test_equations_of_one_shape_are_read_once():
    equations = ["(1 + 2) * 3", "(4 + 5) * 6", "007 + 1", "1.5.2", "8//3", "2**3", "1 # 2", "1/0", "-.5", None]
    answers._known_shape.cache_clear()
    got = answers.arithmetic_value.func(pa.array(equations, pa.string())).to_pylist()
    assert got == [9.0, 54.0, None, None, 2.0, None, None, None, -0.5, None]
    assert answers._known_shape.cache_info().hits == 1
