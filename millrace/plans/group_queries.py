"""Group-relative rewards, advantages and metrics. Orders stand for samples, customers for tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import groups, metrics
from ..operators.ordering import with_position
from . import sqltext as q
from .registry import query, table
from .text_queries import PAIRS_SQL, turn_pairs

RO = """ro as (select o_custkey as task, o_orderkey as sample, round(o_totalprice / 100000) as reward, o_orderstatus = 'F' as correct,
  o_orderpriority as source, o_orderstatus as vote, row_number() over (partition by o_custkey order by o_orderkey) - 1 as step,
  o_orderkey * 7 % 40 as n_tokens from orders)"""


def rollouts(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("task"),
        F.col("o_orderkey").alias("sample"),
        F.round(F.col("o_totalprice") / 100000).alias("reward"),
        (F.col("o_orderstatus") == "F").alias("correct"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("vote"),
        F.pmod(F.col("o_orderkey") * 7, F.lit(40)).alias("n_tokens"),
    )


def steps(spark, d):
    return with_position(rollouts(spark, d), "sample", "step", within=["task"])


# Line items stand for response tokens of the order's response.
TOK = "tok as (select l_orderkey as seq, l_discount - l_tax as x, -l_discount * 10 - 0.1 as t, -l_tax * 10 as r from lineitem)"


def tokens(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("seq"),
        (F.col("l_discount") - F.col("l_tax")).alias("x"),
        (-F.col("l_discount") * 10 - 0.1).alias("t"),
        (-F.col("l_tax") * 10).alias("r"),
    )


def rounded(df, *keep, digits=6):
    return df.select(*[F.col(c) if c in keep else F.round(c, digits).alias(c) for c in df.columns])


def sql_rounded(names, digits=6):
    return ", ".join(f"round({expr}, {digits}) as {name}" for name, expr in names.items())


# --- groups -------------------------------------------------------------------------------------


@query(
    "g1_flatten_episodes",
    """
    with s as (select conv_id, role, row_number() over o - 1 as step, count(*) over (partition by conv_id, role) as n,
                      (dense_rank() over (partition by conv_id order by role) - 1)::int as trajectory
               from conversations where role in ('user', 'assistant') window o as (partition by conv_id, role order by turn))
    select conv_id, trajectory, conv_id || '_' || role || '_' || trajectory as trajectory_id,
      step::int as step, n::int as n_steps, step = n - 1 as is_last from s
    """,
)
def _(spark, d):
    turns = table(spark, d, "conversations").filter("role in ('user', 'assistant')")
    paths = turns.groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.struct("turn"))).alias("steps"))
    empty = F.struct(F.lit("idle").alias("name"), F.array().cast("array<struct<turn:bigint>>").alias("steps"))
    made = paths.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("role").alias("name"), "steps"))).alias("t"))
    flat = groups.flatten_episodes(made.select("conv_id", F.concat("t", F.array(empty)).alias("trajectories")), ["conv_id"])
    return flat.select("conv_id", "trajectory", "trajectory_id", "step", "n_steps", "is_last")


@query(
    "g2_group_steps",
    """select coalesce('k:' || case when event_type <> 'error' then user_id end, 's:' || event_id) as trajectory, count(*) as n,
       md5(string_agg(event_id::varchar, ',' order by event_id)) as steps from events group by 1""",
)
def _(spark, d):
    events = table(spark, d, "events").withColumn("step", F.col("event_id"))
    grouped = groups.group_steps(events, "step", F.when(F.col("event_type") != "error", F.col("user_id")), "event_id")
    ids = F.array_join(F.transform("steps", lambda s: s["event_id"].cast("string")), ",")
    return grouped.select("trajectory", F.size("steps").cast("bigint").alias("n"), F.md5(ids).alias("steps"))


@query(
    "g3_merge_steps",
    """
    with s as (select conv_id, turn, (turn >= 3)::int + (turn >= 4)::int as segment, case when turn = 3 then 4 else 2 * turn + 1 end as n_prompt from conversations)
    select conv_id, segment, max(n_prompt) as n_input, count(*) as n_action from s group by 1, 2
    """,
)
def _(spark, d):
    turn = F.col("turn").cast("int")
    prompt = F.when(turn == 3, F.sequence(F.lit(100), turn + 100)).otherwise(F.sequence(F.lit(0), turn * 2))
    made = table(spark, d, "conversations").select(
        "conv_id", "turn", prompt.alias("prompt_ids"), F.array(turn * 2 + 1).alias("response_ids"),
        F.array(F.lit(-0.5)).alias("logprobs"), F.lit(1.0).alias("advantage"),
    )
    merged = groups.merge_steps(made, ["conv_id"], "turn")
    return merged.select(
        "conv_id",
        F.col("segment").cast("int").alias("segment"),
        F.size("input").cast("bigint").alias("n_input"),
        metrics.array_sum("mask").cast("bigint").alias("n_action"),
    )


@query("g4_group_key", f"with {RO} select task || '|' || source as key, count(*) as n from ro group by 1")
def _(spark, d):
    key = groups.group_key("trajectory", "task", "sample", "source", "n_tokens")
    return rollouts(spark, d).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g5_group_advantage",
    f"""
    with {RO}, s as (select *, avg(reward) over w as m, stddev_pop(reward) over w as sd, count(*) over w as n from ro window w as (partition by task))
    select task, sample, round(case when n = 1 then reward when sd > 1e-8 then (reward - m) / sd else reward - m end, 6) as advantage from s
    """,
)
def _(spark, d):
    out = groups.group_advantage(rollouts(spark, d), ["task"], "reward")
    return out.select("task", "sample", F.round(F.col("advantage") + 0.0, 6).alias("advantage"))


@query("g6_plain_advantage", f"with {RO} select sample, reward as advantage from ro")
def _(spark, d):
    return groups.plain_advantage(rollouts(spark, d), "reward").select("sample", "advantage")


@query(
    "g7_leave_one_out",
    f"""
    with {RO}, s as (select *, sum(reward) over w as s, count(*) over w as n from ro window w as (partition by task)),
    a as (select sample, case when n > 1 then reward * n / (n - 1) - s / (n - 1) else reward end as a from s),
    m as (select avg(a) as m, var_samp(a) as v from a)
    select sample, round(a, 6) as advantage, round((a - m) / sqrt(v + 1e-8), 6) as whitened from a, m
    """,
)
def _(spark, d):
    out = groups.whiten(groups.leave_one_out(rollouts(spark, d), ["task"], "reward"), "advantage")
    return out.select("sample", F.round("advantage", 6).alias("advantage"), F.round("whitened", 6).alias("whitened"))


@query(
    "g7_reverse_cumulative",
    "select vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 5) as total from embeddings",
)
def _(spark, d):
    # The reverse running sums of a vector add up to the sum of place * value.
    values = F.transform("embedding", lambda x: x.cast("double"))
    total = metrics.array_sum(groups.reverse_cumulative(values))
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 5).alias("total"))


@query(
    "g8_drop_constant_groups",
    f"with {RO} select task, sample from ro where task in (select task from ro group by 1 having max(reward) - min(reward) >= 1e-8)",
)
def _(spark, d):
    return groups.drop_constant_groups(rollouts(spark, d), ["task"], "reward").select("task", "sample")


@query(
    "g9_drop_zero_std_groups",
    f"with {RO} select task, sample from ro where task in (select task from ro group by 1 having max(correct::int) > min(correct::int) or count(*) = 1)",
)
def _(spark, d):
    rows = rollouts(spark, d).withColumn("r", F.col("correct").cast("int"))
    return groups.drop_zero_std_groups(rows, ["task"], "r").select("task", "sample")


@query(
    "g10_reject_solved_tasks",
    f"""
    with {RO}, t as (select task from ro group by 1 having bool_or(correct) and not bool_and(correct)),
    p as (select task, row_number() over (order by {q.shuffled('tasks', 'task')}, task) as k from t)
    select task, sample from ro where task in (select task from p where k <= 40)
    """,
)
def _(spark, d):
    return groups.reject_solved_tasks(rollouts(spark, d), "task", F.col("correct"), 40).select("task", "sample")


@query(
    "g11_prefer_groups",
    f"""
    with {RO}, g as (select task, avg(correct::int) as acc, max(n_tokens) as l from ro group by 1),
    p as (select task, row_number() over (order by (acc > 0.8 or acc < 0.2 or l >= 39)::int, task) as k, count(*) over () as n from g)
    select task, sample from ro where task in (select task from p where k <= n // 2)
    """,
)
def _(spark, d):
    rows = rollouts(spark, d).withColumn("s", F.col("correct").cast("int"))
    return groups.prefer_groups(rows, "task", "s", "n_tokens", 0.2, 0.8, 40, 2).select("task", "sample")


@query(
    "g12_preference_pairs",
    f"""
    with {RO}, s as (select task, sample, n_tokens / 40.0::double + 10 * correct::int as s, n_tokens > 3 as ok, correct from ro),
    r as (select *, row_number() over (partition by task order by s desc, sample) as k, row_number() over (partition by task order by s, sample desc) as w,
                 bool_or(ok) over (partition by task) as has_ok, count(*) filter (correct) over (partition by task) as solved from s)
    select b.task, b.sample as chosen, x.sample as rejected from r b join r x on b.task = x.task and x.w = 1
    where b.k <= 2 and b.ok and b.sample <> x.sample and b.has_ok and b.solved - 1 < 4
    """,
)
def _(spark, d):
    out = groups.preference_pairs(
        rollouts(spark, d), "task", "sample", F.col("n_tokens") / F.lit(40.0), F.col("correct").cast("int"), F.col("n_tokens") > 3, 2, 0.5, 8
    )
    return out.select("task", "chosen", "rejected")


@query(
    "g13_pairwise_preference",
    f"""
    with {RO}, p as (select task, step // 2 as pair, step % 2 as place, sample, reward from ro),
    w as (select *, row_number() over (partition by task, pair order by reward desc, place) as k from p)
    select sample, k = 1 as chosen from w
    """,
)
def _(spark, d):
    pairs = steps(spark, d).withColumn("pair", F.concat_ws("-", "task", F.floor(F.col("step") / 2))).withColumn("place", F.pmod("step", F.lit(2)))
    return groups.pairwise_preference(pairs, "pair", "place", "reward").select("sample", "chosen")


@query(
    "g14_shifted_reference",
    """
    with c as (select conv_id, turn, md5(text) as a, lag(md5(text)) over (partition by conv_id order by turn) as p, last_value(md5(text)) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as l from conversations)
    select conv_id, turn, coalesce(p, l) as reference from c
    """,
)
def _(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("answer"))
    return groups.shifted_reference(turns, "conv_id", "turn", "answer").select("conv_id", "turn", "reference")


@query(
    "g15_importance_weights",
    f"""
    with {TOK}, w as (select seq, least(exp(greatest(least(x, 20), -20)), 1.05) as w from tok), m as (select avg(w) as m from w),
    s as (select seq, least(exp(greatest(least(sum(x), 20), -20)), 1.05) as w from tok group by 1), sm as (select avg(w) as m from s)
    select t.seq, round(sum(w.w / m.m), 5) as token_weight, round(max(t.w / sm.m), 5) as sequence_weight from s t join w using (seq), m, sm group by 1
    """,
)
def _(spark, d):
    token = groups.importance_weights(tokens(spark, d), "seq", "x", "token", 1.05, True)
    sequence = groups.importance_weights(tokens(spark, d), "seq", "x", "sequence", 1.05, True)
    a = token.groupBy("seq").agg(F.round(F.sum("weight"), 5).alias("token_weight"))
    b = sequence.groupBy("seq").agg(F.round(F.max("weight"), 5).alias("sequence_weight"))
    return a.join(b, "seq")


@query(
    "g16_rejection_mask",
    f"""
    with {TOK}, s as (select seq, exp(sum(x)) as sw, exp(avg(x)) as gw from tok group by 1)
    select seq, count(*) filter (exp(x) between 1 / 1.03::double and 1.03::double) as n_token, count(*) filter (sw between 1 / 1.03::double and 1.03::double) as n_sequence,
      count(*) filter (gw between 0.99::double and 1.03::double) as n_geometric from tok join s using (seq) group by 1
    """,
)
def _(spark, d):
    def kept(level, name, lower=None):
        mask = groups.rejection_mask(tokens(spark, d), "seq", "x", level, 1.03, lower)
        return mask.groupBy("seq").agg(F.count_if("keep").alias(name))

    return kept("token", "n_token").join(kept("sequence", "n_sequence"), "seq").join(kept("geometric", "n_geometric", 0.99), "seq")


@query(
    "g17_broadcast_last_step",
    f"""
    with {RO}, l as (select *, count(*) over (partition by task) as n, last_value(reward) over (partition by task order by step rows between unbounded preceding and unbounded following) as r from ro)
    select sample, round(r / n, 6) as advantage from l
    """,
)
def _(spark, d):
    s = groups.with_group_stats(steps(spark, d), ["task"], n_steps=F.count(F.lit(1)))
    last = s.filter(F.col("step") == F.col("n_steps") - 1).withColumn("advantage", F.col("reward"))
    out = groups.broadcast_last_step(s, ["task"], last, divide=True)
    return out.select("sample", F.round("advantage", 6).alias("advantage"))


@query(
    "g18_outcome_rewards",
    f"with {RO} select task, sample, correct::int::double as reward from ro qualify row_number() over (partition by task order by step desc) = 1",
)
def _(spark, d):
    return groups.outcome_rewards(steps(spark, d), ["task"], "step", "correct").select("task", "sample", "reward")


@query("g19_trajectory_rewards", f"with {RO} select task, sum(reward) as reward from ro group by 1")
def _(spark, d):
    return groups.trajectory_rewards(rollouts(spark, d), ["task"], "reward")


@query(
    "g20_discounted_returns",
    f"""
    with {RO} select a.task, a.step, round(sum(b.reward * pow(0.9371::double, b.step - a.step)), 6) as ret from ro a join ro b on a.task = b.task and b.step >= a.step group by 1, 2
    """,
)
def _(spark, d):
    out = groups.discounted_returns(steps(spark, d), ["task"], "step", "reward", 0.9371)
    return out.select("task", "step", F.round("return", 6).alias("ret"))


@query(
    "g21_shaped_rewards",
    f"with {RO} select sample, reward + 0.5 * coalesce(reward - lag(reward) over (partition by task order by step), 0) as shaped from ro",
)
def _(spark, d):
    return groups.shaped_rewards(steps(spark, d), ["task"], "step", "reward", 0.5).select("sample", "shaped")


@query("g22_episode_correct", f"with {RO} select task, sum(reward) > 0 as is_correct from ro group by 1")
def _(spark, d):
    return groups.episode_correct(rollouts(spark, d), "task", "reward")


@query("g23_name_reward_metrics", f"with {RO} select task, source, round(avg(reward), 6) as mean_reward from ro group by 1, 2")
def _(spark, d):
    return rounded(groups.name_reward_metrics(rollouts(spark, d), "task", "source", "reward"), "task", "source")


@query("g24_soft_mean_baseline", f"with {RO} select source, round(ln(avg(exp(0.5 * reward))) / 0.5, 6) as baseline from ro group by 1")
def _(spark, d):
    return rounded(groups.soft_mean_baseline(rollouts(spark, d), ["source"], "reward", 0.5), "source")


@query(
    "x22_min_max_normalise",
    f"""
    with {RO}, s as (select *, min(reward) over w as lo, max(reward) over w as hi from ro window w as (partition by task))
    select sample, round(case when lo = hi then case when lo = 0 then 0 else least(1.0, lo) end else (reward - lo) / (hi - lo + 1e-5) end, 6) as normalised from s
    """,
)
def _(spark, d):
    out = groups.min_max_normalise(rollouts(spark, d), ["task"], "reward")
    return out.select("sample", F.round("normalised", 6).alias("normalised"))


@query(
    "x23_cumulative_prefix",
    "select conv_id, max(turn) < 3 as is_cumulative from conversations group by 1",
)
def _(spark, d):
    turn = F.col("turn").cast("int")
    grown = F.when(turn == 3, F.array(F.lit(9))).otherwise(F.sequence(F.lit(0), turn))
    made = table(spark, d, "conversations").select("conv_id", "turn", grown.alias("s"))
    return groups.cumulative_prefix(made, ["conv_id"], "turn", "s")


# --- metrics ------------------------------------------------------------------------------------


@query(
    "a1_length_statistics",
    "select lang, round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as std, min(n_chars) as min, max(n_chars) as max, count(*) as size from documents group by 1",
)
def _(spark, d):
    return rounded(table(spark, d, "documents").groupBy("lang").agg(*metrics.length_statistics("n_chars")), "lang", "min", "max", "size")


@query(
    "a2_dataset_card",
    f"""
    with p as (select event_id, user_id from events qualify row_number() over (order by {q.shuffled('sample', 'event_id')}, event_id) <= 5000 or (select count(*) from events) <= 5000)
    select round(avg(user_id), 6) as mean, round(stddev_pop(user_id), 6) as std, min(user_id) as min, max(user_id) as max, count(*) as size, (select count(*) from events) as dataset_size from p
    """,
)
def _(spark, d):
    card = metrics.dataset_card(table(spark, d, "events"), "user_id", ["event_id"], 5000)
    return rounded(card, "min", "max", "size", "dataset_size")


@query(
    "a3_pass_at_k",
    f"with {RO}, p as (select task, count(*) filter (correct) as c, count(*) as n from ro group by 1) select count(*) as n_problems, round(sum(c) / sum(n), 6) as pass_at_1, round(avg((c > 0)::int), 6) as pass_at_k from p",
)
def _(spark, d):
    problem = F.md5(F.to_json(F.struct("task")))
    return rounded(metrics.pass_at_k(rollouts(spark, d), [], problem, F.col("correct")), "n_problems")


@query(
    "a4_pass_per_source",
    f"with {RO}, p as (select source, task, count(*) filter (correct) as c, count(*) as n from ro group by 1, 2) select source, count(*) as n_problems, round(sum(c) / sum(n), 6) as pass_at_1, round(avg((c > 0)::int), 6) as pass_at_n from p group by 1",
)
def _(spark, d):
    return rounded(metrics.pass_at_k(rollouts(spark, d), ["source"], F.col("task"), F.col("correct"), "pass_at_n"), "source", "n_problems")


@query(
    "a5_evaluation_summary",
    f"with {RO} select count(*) as total, count(*) filter (correct) as correct, round(avg(correct::int), 6) as accuracy, round(avg(reward), 6) as mean_reward from ro",
)
def _(spark, d):
    return rounded(metrics.evaluation_summary(rollouts(spark, d), F.col("correct"), "reward"), "total", "correct")


@query("a5_termination_counts", f"with {RO} select vote, count(*) as n from ro group by 1")
def _(spark, d):
    return metrics.termination_counts(rollouts(spark, d), "vote")


@query(
    "a6_mean_of_means",
    f"with {RO}, m as (select source, task, avg(reward) as m from ro group by 1, 2) select source, round(avg(m), 6) as score from m group by 1",
)
def _(spark, d):
    return rounded(metrics.mean_of_means(rollouts(spark, d), ["source"], ["task"], "reward"), "source")


@query(
    "a7_mean_std_at_n",
    f"with {RO}, m as (select source, task, avg(reward) as m, stddev_pop(reward) as s, count(*) as n from ro group by 1, 2) select source, round(avg(m), 6) as mean_at_n, round(avg(s) filter (n > 1), 6) as std_at_n from m group by 1",
)
def _(spark, d):
    return rounded(metrics.mean_std_at_n(rollouts(spark, d), "source", "task", "reward"), "source")


@query(
    "a8_best_worst_at_n",
    f"""
    with {RO}, r as (select 'all' as source, task, reward, row_number() over (partition by task order by reward) as i, count(*) over (partition by task) as n from ro),
    s as (select *, unnest([2, 4, 8]) as k from r), f as (select * from s where k <= n),
    p as (select source, task, k, sum(reward * (pow(i / n, k) - pow((i - 1) / n, k))) as b, sum(reward * reward * (pow(i / n, k) - pow((i - 1) / n, k))) as b2,
      sum(reward * (pow(1 - (i - 1) / n, k) - pow(1 - i / n, k))) as w, sum(reward * reward * (pow(1 - (i - 1) / n, k) - pow(1 - i / n, k))) as w2 from f group by 1, 2, 3)
    select source, k as n, round(avg(b), 5) as best_at_n_exact, round(avg(sqrt(greatest(b2 - b * b, 0))), 5) as best_std_exact,
      round(avg(w), 5) as worst_at_n_exact, round(avg(sqrt(greatest(w2 - w * w, 0))), 5) as worst_std_exact from p group by 1, 2
    """,
)
def _(spark, d):
    rows = rollouts(spark, d).withColumn("source", F.lit("all"))
    return rounded(metrics.best_worst_at_n(rows, "source", "task", "reward", [2, 4, 8]), "source", "n", digits=5)


@query(
    "a9_majority_value",
    f"""
    with {RO}, v as (select task, vote, count(*) as n, min(sample) as f, arg_min(reward, sample) as r from ro group by 1, 2)
    select task, r as majority from v qualify row_number() over (partition by task order by n desc, f) = 1
    """,
)
def _(spark, d):
    return metrics.majority_value(rollouts(spark, d), ["task"], "vote", "reward", "sample")


@query(
    "a9_expected_majority",
    f"""
    with {RO}, v as (select task, vote, count(*) as n, avg(reward) as m, avg(reward * reward) as s from ro group by 1, 2),
    p as (select task, n / sum(n) over (partition by task)::double as p, m, s, row_number() over (partition by task order by vote) as i from v),
    w as (select task, max(p) filter (i = 1) as p1, coalesce(max(p) filter (i = 2), 0) as p2, coalesce(max(p) filter (i = 3), 0) as p3,
                 max(m) filter (i = 1) as m1, coalesce(max(m) filter (i = 2), 0) as m2, coalesce(max(m) filter (i = 3), 0) as m3,
                 max(s) filter (i = 1) as s1, coalesce(max(s) filter (i = 2), 0) as s2, coalesce(max(s) filter (i = 3), 0) as s3 from p group by 1),
    c as (select a, b, 5 - a - b as c, greatest(a, b, 5 - a - b) as top from (select unnest(range(6)) as a), (select unnest(range(6)) as b) where a + b <= 5),
    e as (select task, 120 / (factorial(a::int) * factorial(b::int) * factorial(c::int))::double * p1 ** a * p2 ** b * p3 ** c as chance,
                 ((a = top)::int * m1 + (b = top)::int * m2 + (c = top)::int * m3) / ((a = top)::int + (b = top)::int + (c = top)::int)::double as m,
                 ((a = top)::int * s1 + (b = top)::int * s2 + (c = top)::int * s3) / ((a = top)::int + (b = top)::int + (c = top)::int)::double as s from w, c)
    select task, round(sum(chance * m), 6) as mean, round(sqrt(greatest(sum(chance * s) - sum(chance * m) ** 2, 0)), 4) as std from e group by 1
    """,
)
def _(spark, d):
    found = metrics.expected_majority(steps(spark, d), ["task"], "vote", "reward", 5)
    return found.select("task", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


@query("a9_bootstrap_majority")
def _(spark, d):
    return metrics.bootstrap_majority(steps(spark, d), ["task"], "vote", "reward", "step", 4, 50)


@query(
    "a10_rollout_metrics",
    f"""
    with {RO} select {sql_rounded({'score_mean': 'avg(reward) filter (n_tokens > 0)', 'score_max': 'max(reward) filter (n_tokens > 0)', 'score_min': 'min(reward) filter (n_tokens > 0)',
      'response_length_mean': 'avg(n_tokens)', 'response_clip_ratio': 'avg((n_tokens = 39)::int)', 'living_length_mean': 'avg(n_tokens) filter (n_tokens > 0)',
      'living_clip_ratio': 'avg((n_tokens = 39)::int) filter (n_tokens > 0)', 'aborted_ratio': 'avg((n_tokens = 0)::int)', 'prompt_length_mean': 'avg(step)'})} from ro
    """,
)
def _(spark, d):
    rows = steps(spark, d).select(
        F.col("reward").alias("score"), "reward", F.col("n_tokens").alias("response_length"), F.col("step").alias("prompt_length")
    )
    out = metrics.rollout_sequence_metrics(rows, 39, 10)
    names = ["score_mean", "score_max", "score_min", "response_length_mean", "response_clip_ratio", "living_length_mean",
             "living_clip_ratio", "aborted_ratio", "prompt_length_mean"]
    return rounded(out.select(*names))


@query(
    "a10_token_metrics",
    f"""with {TOK} select {sql_rounded({'advantage_mean': 'avg(x)', 'return_max': 'max(t)', 'value_min': 'min(r)',
        'explained_variance': '1 - var_samp(t - r) / (var_samp(t) + 1e-5)'})} from tok""",
)
def _(spark, d):
    rows = tokens(spark, d).select(F.col("x").alias("advantage"), F.col("t").alias("return"), F.col("r").alias("value"))
    return rounded(metrics.rollout_token_metrics(rows).select("advantage_mean", "return_max", "value_min", "explained_variance"))


@query(
    "a11_throughput",
    f"""with {RO} select sum(step + n_tokens)::bigint as total_tokens, 12.5::double as gen_seconds, round(12500.0 / sum(n_tokens), 6) as gen_ms_per_token,
        20.0::double as step_seconds, round(sum(step + n_tokens) / 80.0, 6) as tokens_per_second_per_device from ro""",
)
def _(spark, d):
    out = metrics.throughput(steps(spark, d), "step", "n_tokens", {"gen": 12.5, "step": 20.0}, 4)
    return rounded(out, "total_tokens", "gen_seconds", "step_seconds")


@query(
    "a12_group_mean_std",
    f"with {RO} select task, round(case when count(*) <= 1 then 0 else avg(reward) end, 6) as mean, round(case when count(*) <= 1 then 1 else sqrt(greatest(var_samp(reward), 1e-6)) end, 6) as std, count(*) as n from ro group by 1",
)
def _(spark, d):
    return rounded(metrics.group_mean_std(rollouts(spark, d), "task", "reward"), "task", "n")


@query(
    "a13_solve_counts",
    f"with {RO}, t as (select task, bool_or(correct) as a, bool_and(correct) as b from ro group by 1) select count(*) filter (not a) as solve_none, count(*) filter (b) as solve_all, count(*) filter (a and not b) as solve_partial from t",
)
def _(spark, d):
    return groups.solve_counts(groups.solve_classes(rollouts(spark, d), "task", F.col("correct")))


@query(
    "a14_weight_summary",
    f"""
    with {TOK}, w as (select seq, exp(x) as w, least(greatest(exp(x), 1 / 1.05::double), 1.05::double) as h from tok), s as (select seq, avg(w) as s from w group by 1)
    select {sql_rounded({'mean': 'avg(w)', 'max': 'max(w)', 'min': 'min(w)', 'fraction_high': 'avg((w > 1.05::double)::int)', 'fraction_low': 'avg((w < 1 / 1.05::double)::int)',
      'std': 'sqrt(avg(h * h) - avg(h) * avg(h))', 'effective_sample_size': '1 / (avg(h * h) / ((avg(h) + 1e-8) * (avg(h) + 1e-8)))',
      'seq_mean': '(select avg(s) from s)', 'seq_std': '(select stddev_samp(s) from s)', 'seq_max': '(select max(s) from s)', 'seq_min': '(select min(s) from s)',
      'seq_max_deviation': '(select max(abs(s - 1)) from s)', 'seq_fraction_high': '(select avg((s > 1.05::double)::int) from s)',
      'seq_fraction_low': '(select avg((s < 1 / 1.05::double)::int) from s)'}, 5)} from w
    """,
)
def _(spark, d):
    return rounded(metrics.weight_summary(tokens(spark, d), "seq", "x", "token", 1.05), digits=5)


@query(
    "a14_sequence_weight_summary",
    f"""
    with {TOK}, s as (select seq, sum(x) as x, exp(sum(x)) as w, count(*) as n from tok group by 1)
    select {sql_rounded({'mean': 'sum(w * n) / sum(n)', 'max': 'max(w)', 'min': 'min(w)', 'fraction_high': 'avg((x > ln(1.05::double))::int)',
      'fraction_low': 'avg((x < ln(1 / 1.05::double))::int)', 'seq_mean': 'avg(w)', 'seq_std': 'stddev_samp(w)'}, 5)} from s
    """,
)
def _(spark, d):
    out = metrics.weight_summary(tokens(spark, d), "seq", "x", "sequence", 1.05)
    return rounded(out.select("mean", "max", "min", "fraction_high", "fraction_low", "seq_mean", "seq_std"), digits=5)


@query(
    "a15_off_policy_metrics",
    f"""
    with {TOK}, s as (select seq, avg(t) as mt, avg(r) as mr, sum(t - r) as x from tok group by 1)
    select {sql_rounded({'training_ppl': '(select avg(exp(-mt)) from s)', 'training_log_ppl': '(select avg(-mt) from s)', 'kl': 'avg(r - t)', 'k3_kl': 'avg(exp(t - r) - (t - r) - 1)',
      'rollout_ppl': '(select avg(exp(-mr)) from s)', 'rollout_log_ppl': '(select avg(-mr) from s)', 'log_ppl_diff': '(select avg(mr - mt) from s)',
      'log_ppl_abs_diff': '(select avg(abs(mr - mt)) from s)', 'log_ppl_diff_max': '(select max(mr - mt) from s)', 'log_ppl_diff_min': '(select min(mr - mt) from s)',
      'ppl_ratio': '(select avg(exp(mr - mt)) from s)', 'chi2_token': 'avg(pow(exp(t - r), 2)) - 1', 'chi2_seq': '(select avg(exp(2 * x)) - 1 from s)'}, 5)} from tok
    """,
)
def _(spark, d):
    return rounded(metrics.off_policy_metrics(tokens(spark, d), "seq", "t", "r"), digits=5)


@query(
    "a16_category_accuracy",
    f"with {RO} select source, round(avg(correct::int), 6) as accuracy, count(*) as n from ro group by rollup (source)",
)
def _(spark, d):
    return rounded(metrics.category_accuracy(rollouts(spark, d), "source", F.col("correct")), "source", "n")


@query(
    "a17_pairwise_accuracy",
    f"""
    with {RO}, p as (select a.task, a.reward - b.reward as s, a.correct::int - b.correct::int as l from ro a join ro b on a.task = b.task and a.sample < b.sample),
    g as (select task, sum(((s > 0) = (l > 0))::int * abs(l)) / nullif(sum(abs(l)), 0) as acc from p group by 1)
    select round(avg(coalesce(acc, 0.5)), 6) as accuracy from (select distinct task from ro) left join g using (task)
    """,
)
def _(spark, d):
    rows = rollouts(spark, d).withColumn("label", F.col("correct").cast("int"))
    return rounded(metrics.pairwise_accuracy(rows, "task", "sample", "reward", "label"))


@query("a18_rouge_bleu")
def _(spark, d):
    return rounded(metrics.rouge_bleu(turn_pairs(spark, d), "prediction", "gold"), "n")


@query(
    "a19_chunk_counts",
    """
    with c as (select source, d.doc_id as doc, lang <> 'es' as t, quality is not null as v, quality from documents d left join labels using (doc_id)),
    x as (select source, doc, bool_or(t) as t, count(*) filter (v) as v, count(*) filter (not v) as i, count(*) filter (v and t) as tr from c group by 1, 2)
    select source, count(*) as n_docs, count(*) filter (t) as n_docs_train, sum(v)::bigint as n_valid, sum(i)::bigint as n_invalid, sum(tr)::bigint as n_train, ceil(sum(tr) * 0.3::double)::bigint as n_sampled from x group by 1
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    chunks = docs.select("source", F.col("doc_id").alias("doc"), (F.col("lang") != "es").alias("is_train"), F.col("quality").isNotNull().alias("is_valid"))
    return metrics.chunk_counts(chunks, "source", F.lit(0.3))


@query(
    "a20_metric_reduction",
    """select m as name, round(case when contains(m, 'max') then max(value) when contains(m, 'min') then min(value) else avg(value) end, 6) as value
       from (select event_type || '/' || unnest(['max', 'min', 'mean']) as m, value from events) group by 1""",
)
def _(spark, d):
    kinds = F.explode(F.array(F.lit("max"), F.lit("min"), F.lit("mean"))).alias("k")
    rows = table(spark, d, "events").select("event_type", "value", kinds).select(F.concat_ws("/", "event_type", "k").alias("name"), "value")
    return rounded(metrics.metric_reduction(rows, "name", "value"), "name")


@query(
    "a21_preference_balance",
    """with c as (select greatest(count(*) filter (quality = 1), 1) as a, count(*) as n from labels), b as (select a, greatest(n - a, 1) as u from c)
       select a as n_desirable, u as n_undesirable, round(u / a, 2) as desirable_low, round(u / a * 1.33::double, 2) as desirable_high,
         round(a / u / 1.33::double, 2) as undesirable_low, round(a / u, 2) as undesirable_high from b""",
)
def _(spark, d):
    return metrics.preference_balance(table(spark, d, "labels"), F.col("quality") == 1)


@query(
    "a23_option_accuracy",
    """
    with p as (select p_brand, lower(string_split(p_name, ' ')[1]) as p, lower(string_split(p_type, ' ')[1]) as g from part)
    select p_brand, round(avg((contains(g, p) or contains(p, g) or g = 'economy')::int), 6) as accuracy, count(*) as n from p group by rollup (p_brand)
    """,
)
def _(spark, d):
    prediction = F.when(F.col("p_type") == "ECONOMY", F.lit("eco. something")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").withColumn("prediction", prediction)
    return rounded(metrics.category_accuracy(rows, "p_brand", metrics.option_match("prediction", "p_type")), "p_brand", "n")


@query(
    "a24_containment_scores",
    """
    with h as (select p_type, p_brand, (contains(p_name, 'ring')::int + contains(p_name, 'small')::int)::bigint as h from part)
    select p_type, p_brand, sum(h)::bigint as score, count(*) as n from h group by rollup (p_type, p_brand) having p_type is not null
    """,
)
def _(spark, d):
    golds = F.array(F.lit("RING"), F.lit(" small "))
    return metrics.containment_scores(table(spark, d, "part"), "p_type", "p_brand", "p_name", golds)


@query(
    "a25_environment_metrics",
    f"""
    with {RO}, t as (select task, source, sum(step)::double as ob, sum(n_tokens) as ac, count(*) as n, max(reward) as r from ro group by 1, 2),
    e as (select task, min(r) as lo, max(r) as hi from t group by 1)
    select {sql_rounded({'reward_mean': 'avg(r)', 'ob_tokens_per_turn': 'sum(ob) / sum(n)', 'ac_tokens_per_trajectory': 'avg(ac)', 'turns_per_trajectory': 'avg(n)',
      'frac_all_good': '(select avg((lo = hi and lo >= 0.5)::int) from e)', 'frac_all_bad': '(select avg((lo = hi and lo < 0.5)::int) from e)', 'frac_mixed': '(select avg((lo <> hi)::int) from e)'})} from t
    """,
)
def _(spark, d):
    rows = steps(spark, d).withColumnsRenamed({"step": "prompt_tokens", "n_tokens": "response_tokens"})
    out = metrics.environment_metrics(rows, "task", "source")
    return rounded(out.select("reward_mean", "ob_tokens_per_turn", "ac_tokens_per_trajectory", "turns_per_trajectory", "frac_all_good", "frac_all_bad", "frac_mixed"))


@query(
    "a25_step_info_means",
    "select 'k' as name, round(avg(regexp_extract(props, '(\\d+)', 1)::double), 6) as mean from events union all select 'value', round(avg(value), 6) from events",
)
def _(spark, d):
    info = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("type"), F.col("event_type")))
    return rounded(metrics.step_info_means(table(spark, d, "events").select(info.alias("info")), "info"), "name")


@query(
    "a26_logprob_metrics",
    f"with {TOK} select {sql_rounded({'kl_v1': 'avg(t - r)', 'kl_v2': '0.5 * avg((t - r) * (t - r))', 'entropy': '-avg(t)', 'perplexity': 'exp(-avg(t))'})} from tok",
)
def _(spark, d):
    return rounded(metrics.logprob_metrics(tokens(spark, d), "t", "r"))


@query(
    "a27_neighbour_lengths",
    f"""
    with {PAIRS_SQL}, l as (select len({q.words('prediction')}) as n from pairs union all select len({q.words('gold')}) from pairs)
    select count(*) as n, max(n) as longest, count(*) filter (n > 128) as n_cut,
      (select string_agg(n::varchar, ',' order by n) from (select n from l order by n desc limit 10)) as top from l
    """,
)
def _(spark, d):
    rows = turn_pairs(spark, d).select(F.array("prediction", "gold", F.lit("unused")).alias("nb"))
    out = metrics.neighbour_lengths(rows, "nb", words, 2)
    return out.select("n", F.col("longest").cast("bigint").alias("longest"), "n_cut", F.array_join(F.transform("top", lambda t: t.cast("string")), ",").alias("top"))
