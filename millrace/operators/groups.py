"""Group-relative tables: episodes to steps, rewards, advantages, group filters, preference pairs.

A group may hold any share of the rows. Group statistics are therefore aggregates (partial sums per task,
then one row per group) joined back to the rows, not windows that gather a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnOrName, col, let
from .ordering import running_totals, with_position, with_shuffled_position
from .sampling import top_per_group

SAFETY_BOUND = 20.0  # Fixed value: log ratios are clamped to +-20 before exp.
RETURN_BLOCK = 1024


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Rows with aggregates of their group. Null keys form a group like any other value."""
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    other = grouped.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *stats)
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = df.join(other, same)
    return joined.drop(*[f"__k_{k}" for k in keys])


# --- flattening ---------------------------------------------------------------------------------


def flatten_episodes(episodes: DataFrame, keep: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Episode -> trajectory -> step rows with ids, step count and last-step flag; empty ones are dropped.

    ``trajectories`` is array<struct<name, steps: array<struct>>>.
    """
    t = episodes.select(*keep, F.posexplode("trajectories").alias("trajectory", "t"))
    s = t.select(
        *keep,
        "trajectory",
        F.col("t.name").alias("name"),
        F.size("t.steps").alias("n_steps"),
        F.posexplode("t.steps").alias("step", "s"),
    )
    return s.withColumn("trajectory_id", F.concat_ws("_", F.col(keep[0]).cast("string"), "name", "trajectory")).withColumn(
        "is_last", F.col("step") == F.col("n_steps") - 1
    )


def group_steps(steps: DataFrame, order: str, key: Column, step_id: str) -> DataFrame:
    """Steps to trajectories by a key; a step without one is a trajectory of its own."""
    own = F.coalesce(F.concat(F.lit("k:"), key.cast("string")), F.concat(F.lit("s:"), F.col(step_id).cast("string")))
    return steps.groupBy(own.alias("trajectory")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(step_id)))).alias("steps")
    )


def extends(previous: ColumnOrName, current: ColumnOrName) -> Column:
    """True when the array ``current`` begins with all of ``previous``."""
    return F.slice(col(current), F.lit(1), F.size(col(previous))) == col(previous)


def merge_steps(steps: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Steps whose prompt goes on from the whole previous sequence become one training sequence.

    Rows have prompt_ids, response_ids, logprobs and advantage; steps are numbered without gaps. Output per segment: input, target,
    logprobs, advantages, mask, shifted so that each place predicts the next token.
    """
    bad = F.size("response_ids") != F.size("logprobs")
    nulls = F.exists("logprobs", lambda x: x.isNull())
    checked = steps.withColumn(
        "logprobs",
        F.when(bad | nulls, F.raise_error(F.lit("logprobs do not match the response")).cast("array<double>")).otherwise(
            F.col("logprobs")
        ),
    )
    # The running sequence after a step is always its own prompt and response, so the step before is enough.
    whole = F.concat("prompt_ids", "response_ids")
    before = checked.select(*keys, (F.col(order) + 1).alias(order), whole.alias("__prev"))
    opened = checked.join(before, [*keys, order], "left").withColumn(
        "__new", F.when(F.col("__prev").isNull() | ~extends("__prev", "prompt_ids"), 1).otherwise(0)
    )
    placed = with_position(opened, order, "__p", sums=["__new"], within=keys)
    segments = placed.withColumn("segment", F.col("__new_before") + F.col("__new") - 1)
    skip = F.when(F.col("__new") == 1, 0).otherwise(F.size("__prev"))
    delta = F.slice(F.col("prompt_ids"), skip + 1, F.size("prompt_ids") - skip)
    n_prompt, n_response = F.size(delta), F.size("response_ids")

    def filled(prompt_value, response_values):
        return F.concat(F.array_repeat(F.lit(prompt_value), n_prompt), response_values)

    pieces = segments.withColumns(
        {
            "__tokens": F.concat(delta, F.col("response_ids")),
            "__logprobs": filled(0.0, F.col("logprobs")),
            "__advantages": filled(0.0, F.array_repeat(F.col("advantage").cast("double"), n_response)),
            "__mask": filled(0.0, F.array_repeat(F.lit(1.0), n_response)),
        }
    )
    fields = ["tokens", "logprobs", "advantages", "mask"]
    grouped = pieces.groupBy(*keys, "segment").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(f"__{f}").alias(f) for f in fields]))).alias("p")
    )

    def joined(f):
        return F.flatten(F.transform("p", lambda p: p[f]))

    whole = grouped.select(*keys, "segment", *[joined(f).alias(f) for f in fields])
    rest = F.size("tokens") - 1
    return whole.select(
        *keys,
        "segment",
        F.slice("tokens", F.lit(1), rest).alias("input"),
        F.slice("tokens", F.lit(2), rest).alias("target"),
        *[F.slice(f, F.lit(2), rest).alias(f) for f in fields[1:]],
    )


def group_key(level: str, task: str, episode: str, name: str, step: str) -> Column:
    """Key of the group a step's advantage is relative to: ``episode``, ``trajectory`` or ``step``."""
    parts = {"episode": [episode], "trajectory": [task, name], "step": [task, name, step]}[level]
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


# --- rewards ------------------------------------------------------------------------------------


def outcome_rewards(steps: DataFrame, keys: Sequence[str], step: str, correct: str) -> DataFrame:
    """Last step of each trajectory with reward 1 when the episode is correct, else 0."""
    last = top_per_group(steps, keys, [F.desc(step)], 1, "__r").drop("__r")
    return last.withColumn("reward", F.col(correct).cast("double"))


def trajectory_rewards(steps: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    return steps.groupBy(*keys).agg(F.sum(reward).alias("reward"))


def discounted_returns(steps: DataFrame, keys: Sequence[str], step: str, reward: str, gamma: float) -> DataFrame:
    """G = r + gamma * (next G), per trajectory, from its end.

    Long trajectories are cut into blocks of 1024 steps: a block needs only the return at the start of
    the next one, and those come from a short fold over block totals.
    """
    block = F.floor(F.col(step) / RETURN_BLOCK)
    packed = F.sort_array(F.collect_list(F.struct(F.col(step).alias("k"), F.col(reward).cast("double").alias("r"))))
    blocks = steps.withColumn("__b", block).groupBy(*keys, "__b").agg(packed.alias("__p"))
    start = F.struct(F.lit(0.0).alias("g"))

    def total(rows):
        return F.aggregate(F.reverse(rows), start, lambda a, x: F.struct((x["r"] + gamma * a["g"]).alias("g")))["g"]

    sized = blocks.withColumns({"__t": total(F.col("__p")), "__n": F.size("__p")})
    tails = sized.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "__t", "__n"))).alias("__bs"))

    # Return at the end of each block, folded from the last block to the first.
    init = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<struct<b:bigint,tail:double>>").alias("out"))

    def fold(a, x):
        return F.struct(
            (x["__t"] + F.pow(F.lit(gamma), x["__n"]) * a["g"]).alias("g"),
            F.concat(a["out"], F.array(F.struct(x["__b"].alias("b"), a["g"].alias("tail")))).alias("out"),
        )

    folded = F.aggregate(F.reverse("__bs"), init, fold)["out"]
    ends = tails.select(*keys, F.explode(folded).alias("__e")).select(*keys, F.col("__e.b").alias("__b"), F.col("__e.tail").alias("__tail"))
    joined = blocks.join(ends, [*keys, "__b"])

    def step_returns(b):
        seed = F.struct(b["__tail"].alias("g"), F.array().cast("array<struct<k:bigint,g:double>>").alias("out"))
        return F.aggregate(
            F.reverse(b["__p"]),
            seed,
            lambda a, x: F.struct(
                (x["r"] + gamma * a["g"]).alias("g"),
                F.concat(
                    a["out"], F.array(F.struct(x["k"].cast("bigint").alias("k"), (x["r"] + gamma * a["g"]).alias("g")))
                ).alias("out"),
            ),
        )["out"]

    returns = joined.select(*keys, F.explode(let(F.struct("__p", "__tail"), step_returns)).alias("__e"))
    return returns.select(*keys, F.col("__e.k").alias(step), F.col("__e.g").alias("return"))


def shaped_rewards(steps: DataFrame, keys: Sequence[str], step: str, reward: str, bonus: float = 1.0) -> DataFrame:
    """Reward plus ``bonus`` times its change since the previous step; steps are numbered without gaps."""
    before = steps.select(*keys, (F.col(step) + 1).alias(step), F.col(reward).alias("__before"))
    joined = steps.join(before, [*keys, step], "left")
    change = F.when(F.col("__before").isNotNull(), F.col(reward) - F.col("__before")).otherwise(0.0)
    return joined.withColumn("shaped", F.col(reward) + F.lit(float(bonus)) * change).drop("__before")


def episode_correct(trajectories: DataFrame, episode: str, reward: str) -> DataFrame:
    return trajectories.groupBy(episode).agg((F.sum(reward) > 0).alias("is_correct"))


def name_reward_metrics(trajectories: DataFrame, episode: str, name: str, reward: str) -> DataFrame:
    """Mean reward per trajectory name of each episode."""
    return trajectories.groupBy(episode, name).agg(F.avg(reward).alias("mean_reward"))


# --- advantages ---------------------------------------------------------------------------------


def group_advantage(df: DataFrame, keys: Sequence[str], reward: str, by_std: bool = True) -> DataFrame:
    """Reward minus the group mean, over the population deviation when it is above 1e-8; a lone row keeps its reward."""
    stats = with_group_stats(df, keys, __mean=F.avg(reward), __std=F.stddev_pop(reward), __n=F.count(F.lit(1)))
    centred = F.col(reward) - F.col("__mean")
    scaled = F.when(F.lit(by_std) & (F.col("__std") > 1e-8), centred / F.col("__std")).otherwise(centred)
    return stats.withColumn("advantage", F.when(F.col("__n") == 1, F.col(reward)).otherwise(scaled)).drop("__mean", "__std", "__n")


def plain_advantage(df: DataFrame, reward: str) -> DataFrame:
    return df.withColumn("advantage", F.col(reward).cast("double"))


def leave_one_out(df: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    """r * n/(n-1) - sum/(n-1): reward against the mean of the others."""
    stats = with_group_stats(df, keys, __sum=F.sum(reward), __n=F.count(F.lit(1)))
    n = F.col("__n")
    value = F.when(n > 1, F.col(reward) * n / (n - 1) - F.col("__sum") / (n - 1)).otherwise(F.col(reward))
    return stats.withColumn("advantage", value).drop("__sum", "__n")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sums_from_end(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else np.cumsum(np.asarray(x, dtype="float64")[::-1])[::-1])


def reverse_cumulative(values: ColumnOrName) -> Column:
    """Sum of each array element and all after it."""
    return _sums_from_end(col(values).cast("array<double>"))


def whiten(df: DataFrame, value: str) -> DataFrame:
    """(value - mean) / sqrt(sample variance + 1e-8) over the whole table."""
    moments = df.agg(F.struct(F.avg(value).alias("m"), F.var_samp(value).alias("v"))).scalar()
    return df.withColumn("__m", moments).withColumn(
        "whitened", (F.col(value) - F.col("__m.m")) / F.sqrt(F.col("__m.v") + 1e-8)
    ).drop("__m")


def soft_mean_baseline(df: DataFrame, keys: Sequence[str], reward: str, beta: float) -> DataFrame:
    """(1/b) log mean exp(b r) per batch, computed from the largest b r down."""
    scaled = df.withColumn("__x", F.col(reward) * beta)
    top = with_group_stats(scaled, keys, __top=F.max("__x"))
    return top.groupBy(*keys).agg(
        ((F.max("__top") + F.log(F.avg(F.exp(F.col("__x") - F.col("__top"))))) / beta).alias("baseline")
    )


def broadcast_last_step(steps: DataFrame, keys: Sequence[str], last: DataFrame, divide: bool = False, n_steps: str = "n_steps"):
    """Advantage of a trajectory's last step on all of its steps, over the step count if asked."""
    value = last.select(*keys, F.col("advantage").alias("__adv"))
    joined = steps.join(value, list(keys))
    advantage = F.col("__adv") / F.col(n_steps) if divide else F.col("__adv")
    return joined.withColumn("advantage", advantage).drop("__adv")


# --- group filters ------------------------------------------------------------------------------


def drop_constant_groups(df: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    """Rows of groups whose rewards differ; when no group qualifies, the first group by key."""
    groups = df.groupBy(*keys).agg((F.max(reward) - F.min(reward)).alias("__spread"))
    varied = groups.filter(F.col("__spread") >= 1e-8).select(*keys)
    n_varied = varied.agg(F.count(F.lit(1))).scalar()
    first = groups.select(*keys).orderBy(*keys).limit(1).filter(n_varied == 0)
    return df.join(varied.unionByName(first), list(keys), "left_semi")


def drop_zero_std_groups(df: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    """Rows of groups with some deviation, and of groups of one."""
    groups = df.groupBy(*keys).agg(F.max(reward).alias("__hi"), F.min(reward).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    return df.join(groups.filter("__hi > __lo or __n = 1").select(*keys), list(keys), "left_semi")


def solve_classes(df: DataFrame, task: str, correct: Column) -> DataFrame:
    """Per task: whether any and whether all samples are correct."""
    return df.groupBy(task).agg(F.bool_or(correct).alias("any_correct"), F.bool_and(correct).alias("all_correct"))


def solve_counts(classes: DataFrame) -> DataFrame:
    return classes.agg(
        F.count_if(~F.col("any_correct")).alias("solve_none"),
        F.count_if(F.col("all_correct")).alias("solve_all"),
        F.count_if(F.col("any_correct") & ~F.col("all_correct")).alias("solve_partial"),
    )


def reject_solved_tasks(df: DataFrame, task: str, correct: Column, n_tasks: int | None, seed: int = 42) -> DataFrame:
    """Drop tasks all right or all wrong, then draw ``n_tasks`` of the rest."""
    kept = solve_classes(df, task, correct).filter("any_correct and not all_correct").select(task)
    if n_tasks is not None:
        kept = with_shuffled_position(kept, seed, "tasks", task, position="__p").filter(F.col("__p") < n_tasks).drop("__p")
    return df.join(kept, task, "left_semi")


def prefer_groups(df: DataFrame, group: str, score: str, length: str, low: float, high: float, max_length: int, factor: float):
    """Rows of the first 1/factor groups: those inside the accuracy bounds and not cut off come first."""
    stats = df.groupBy(group).agg(F.avg(score).alias("acc"), F.max(length).alias("len"))
    fails = (F.col("acc") > high) | (F.col("acc") < low) | (F.col("len") >= max_length - 1)
    marked = stats.select(
        group,
        fails.cast("int").alias("__fails"),
        F.shiftright(F.col(group).cast("bigint"), 40).alias("__hi"),
        F.shiftright(F.col(group).cast("bigint"), 20).alias("__lo"),
    )
    placed = running_totals(marked, ["__fails", "__hi", "__lo"], [group], position="__p")
    n_keep = F.floor(marked.agg(F.count(F.lit(1))).scalar() / factor)
    return df.join(placed.filter(F.col("__p") < n_keep).select(group), group, "left_semi")


# --- preferences --------------------------------------------------------------------------------


def preference_pairs(
    df: DataFrame, group: str, sample: str, process: Column, outcome: Column, usable: Column, n_best: int,
    easy_threshold: float | None = None, n_samples: int = 0,
) -> DataFrame:
    """(group, chosen, rejected): the best n samples against the worst, score = process + 10 * outcome.

    Ties go to the earlier sample on top and to the later one at the bottom. Only usable samples are
    chosen; groups that solve more than the threshold share are left out.
    """
    scored = df.select(
        group, sample, (process + 10 * outcome).alias("__s"), usable.alias("__ok"), (outcome > 0).alias("__good")
    )
    stats = scored.groupBy(group).agg(
        F.min_by(F.struct(F.col(sample).alias("id"), F.col("__s").alias("s")), F.struct(F.col("__s"), -F.col(sample))).alias("__worst"),
        F.bool_or("__ok").alias("__any"),
        F.count_if("__good").alias("__solved"),
    ).filter("__any")
    if easy_threshold is not None:
        stats = stats.filter(F.col("__solved") - 1 < int(n_samples * easy_threshold))
    best = top_per_group(scored, [group], [F.desc("__s"), F.asc(sample)], n_best, "__rank")
    pairs = best.join(stats, group).filter(F.col("__ok") & (F.col(sample) != F.col("__worst.id")))
    return pairs.select(group, F.col(sample).alias("chosen"), F.col("__worst.id").alias("rejected"))


def pairwise_preference(df: DataFrame, pair: str, place: str, score: str) -> DataFrame:
    """Whether each row of a pair is the chosen one: the higher score, the first one on a tie."""
    first = F.max_by(place, F.struct(F.col(score), -F.col(place)))
    winners = df.groupBy(pair).agg(first.alias("__win"))
    return df.join(winners, pair).withColumn("chosen", F.col(place) == F.col("__win")).drop("__win")


def shifted_reference(df: DataFrame, batch: str, place: str, answer: str) -> DataFrame:
    """Each row with the answer of the row before it in the batch, the first with that of the last.

    ``place`` numbers the rows of a batch from 0 without gaps.
    """
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"))
    moved = df.join(sizes, batch).select(
        batch, F.pmod(F.col(place) + 1, F.col("__n")).alias(place), F.col(answer).alias("reference")
    )
    return df.join(moved, [batch, place])


# --- importance weights -------------------------------------------------------------------------


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def importance_weights(
    tokens: DataFrame, sequence: str, log_ratio: str, level: str = "token", threshold: float = 2.0, normalise: bool = False
) -> DataFrame:
    """Truncated weight per valid token: exp of its log ratio, or of the sum over its sequence.

    ``raw_weight`` is the weight before truncation. With ``normalise`` weights have batch mean 1.
    """
    if level == "token":
        rows = tokens.withColumn("__x", F.col(log_ratio))
    elif level == "sequence":
        rows = with_group_stats(tokens, [sequence], __x=F.sum(log_ratio))
    else:
        raise ValueError(f"unknown level {level!r}")
    raw = F.exp(clamp(F.col("__x"), -SAFETY_BOUND, SAFETY_BOUND))
    out = rows.withColumn("raw_weight", raw).withColumn("weight", clamp(F.col("raw_weight"), high=threshold)).drop("__x")
    if not normalise:
        return out
    if level == "token":
        mean = out.agg(F.avg("weight")).scalar()
    else:
        mean = out.groupBy(sequence).agg(F.avg("weight").alias("w")).agg(F.avg("w")).scalar()
    return out.withColumn("__mean", mean).withColumn(
        "weight", F.when(F.col("__mean") > 1e-8, F.col("weight") / F.col("__mean")).otherwise(F.col("weight"))
    ).drop("__mean")


def rejection_mask(
    tokens: DataFrame, sequence: str, log_ratio: str, level: str = "token", upper: float = 2.0, lower: float | None = None
) -> DataFrame:
    """``keep`` per valid token: its weight (token, sequence product or geometric mean) is inside the band."""
    lower = 1.0 / upper if lower is None else lower
    if level == "token":
        rows = tokens.withColumn("__x", F.col(log_ratio))
    else:
        total = {"sequence": F.sum(log_ratio), "geometric": F.avg(log_ratio)}[level]
        rows = with_group_stats(tokens, [sequence], __x=total)
    weight = F.exp(clamp(F.col("__x"), -SAFETY_BOUND, SAFETY_BOUND))
    return rows.withColumn("weight", weight).withColumn("keep", F.col("weight").between(lower, upper)).drop("__x")


def min_max_normalise(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Scores to [0, 1) inside a group; a constant group gives its value, at most 1."""
    stats = with_group_stats(df, keys, __lo=F.min(score), __hi=F.max(score))
    lo, hi = F.col("__lo"), F.col("__hi")
    constant = F.when(lo == 0, 0.0).otherwise(F.least(F.lit(1.0), lo))
    value = F.when(lo == hi, constant).otherwise((F.col(score) - lo) / (hi - lo + 1e-5))
    return stats.withColumn("normalised", value).drop("__lo", "__hi")


def cumulative_prefix(steps: DataFrame, keys: Sequence[str], step: str, sequence: str) -> DataFrame:
    """Per trajectory: whether every step's sequence begins with the one before it."""
    before = steps.select(*keys, (F.col(step) + 1).alias(step), F.col(sequence).alias("__prev"))
    joined = steps.join(before, [*keys, step], "left")
    fine = F.col("__prev").isNull() | extends("__prev", sequence)
    return joined.groupBy(*keys).agg(F.bool_and(fine).alias("is_cumulative"))
