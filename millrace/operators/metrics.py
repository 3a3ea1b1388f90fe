"""Evaluation and training metrics over recorded rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnOrName, col, let, ratio
from ..functions.seeded import seeded_long
from ..functions.text import words
from .groups import SAFETY_BOUND, clamp
from .ordering import value_offsets, value_running_sum, with_position
from .sampling import sample_rows


def length_statistics(length: ColumnOrName) -> list[Column]:
    c = col(length)
    return [
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count(c).alias("size"),
    ]


def dataset_card(df: DataFrame, length: str, ids: Sequence[str], n_sample: int = 100_000, seed: int = 42) -> DataFrame:
    """Row count of the table, and length statistics over a sample of at most ``n_sample`` rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    # Tables under the sample size are described whole.
    sample = sample_rows(df.select(*ids, length), n_sample, ids, seed).filter("copy = 0")
    return sample.agg(*length_statistics(length)).withColumn("dataset_size", total)


def pass_at_k(df: DataFrame, keys: Sequence[str], problem: Column, correct: Column, k_name: str = "pass_at_k") -> DataFrame:
    """pass@1 over rows and pass@k over problems (any success), per ``keys``."""
    problems = df.groupBy(*keys, problem.alias("__p")).agg(
        F.sum(correct.cast("bigint")).alias("__c"), F.count(F.lit(1)).alias("__n")
    )
    return problems.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_problems"),
        ratio(F.sum("__c"), F.sum("__n")).alias("pass_at_1"),
        F.avg((F.col("__c") > 0).cast("double")).alias(k_name),
    )


def evaluation_summary(df: DataFrame, correct: Column, reward: ColumnOrName) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(correct).alias("correct"),
        F.avg(correct.cast("double")).alias("accuracy"),
        F.avg(col(reward)).alias("mean_reward"),
    )


def termination_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def mean_of_means(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: ColumnOrName, name: str = "score"):
    """Mean per inner group, then the mean of those per outer group."""
    means = df.groupBy(*outer, *inner).agg(F.avg(col(value)).alias("__m"))
    return means.groupBy(*outer).agg(F.avg("__m").alias(name))


def mean_std_at_n(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Mean and population deviation over the samples of a prompt, averaged over prompts."""
    prompts = df.groupBy(source, prompt).agg(
        F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count(F.lit(1)).alias("__n")
    )
    return prompts.groupBy(source).agg(
        F.avg("__m").alias("mean_at_n"), F.avg(F.when(F.col("__n") > 1, F.col("__s"))).alias("std_at_n")
    )


def best_worst_at_n(df: DataFrame, source: str, prompt: str, value: str, sizes: Sequence[int]) -> DataFrame:
    """(source, n, best_mean, best_std, worst_mean, worst_std), averaged over prompts.

    The exact limit of drawing n of a prompt's N samples with replacement: the largest draw is at most
    the i-th smallest value with chance (i/N)**n. Equal values count as one row with their number, so
    a prompt with many samples of few values stays small. Prompts with fewer than n samples are left
    out of size n.
    """
    offsets = value_offsets(df, value, [source, prompt])
    totals = df.groupBy(source, prompt).agg(F.count(F.lit(1)).alias("__total"))
    placed = offsets.join(totals, [source, prompt]).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    placed = placed.filter(F.col("size") <= F.col("__total"))
    below, upto = F.col("n_before") / F.col("__total"), (F.col("n_before") + F.col("n")) / F.col("__total")
    best = F.pow(upto, F.col("size")) - F.pow(below, F.col("size"))
    worst = F.pow(1 - below, F.col("size")) - F.pow(1 - upto, F.col("size"))
    v = F.col(value)
    prompts = placed.groupBy(source, prompt, "size").agg(
        F.sum(best * v).alias("__b"), F.sum(best * v * v).alias("__b2"),
        F.sum(worst * v).alias("__w"), F.sum(worst * v * v).alias("__w2"),
    )

    def deviation(mean, square):
        return F.sqrt(F.greatest(F.col(square) - F.col(mean) * F.col(mean), F.lit(0.0)))

    return prompts.groupBy(source, F.col("size").alias("n")).agg(
        F.avg("__b").alias("best_at_n_exact"),
        F.avg(deviation("__b", "__b2")).alias("best_std_exact"),
        F.avg("__w").alias("worst_at_n_exact"),
        F.avg(deviation("__w", "__w2")).alias("worst_std_exact"),
    )


def majority_value(df: DataFrame, keys: Sequence[str], vote: str, value: str, order: str) -> DataFrame:
    """Value of the first sample of the most common vote; the vote seen first wins ties."""
    votes = df.groupBy(*keys, vote).agg(
        F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"), F.min_by(value, order).alias("__v")
    )
    return votes.groupBy(*keys).agg(F.max_by("__v", F.struct(F.col("__n"), -F.col("__first"))).alias("majority"))


def _majority_shares(counts: Sequence[int], n: int) -> np.ndarray:
    """Chance of each vote to be the majority of ``n`` draws with replacement; votes of equal counts win alike often.

    Over each count m of the winner: the others' draws, none with more than m, as a product of exponential series, with the number of
    ties kept beside the degree.
    """
    shares = np.asarray(counts, dtype=float) / sum(counts)
    factorials = np.cumprod(np.append(1.0, np.arange(1, n + 1)))
    won = np.zeros(len(shares))
    for m in range(1, n + 1):
        most = (n - m) // m  # others that can tie
        for v, p in enumerate(shares):
            series = np.zeros((most + 1, n - m + 1))  # [ties, draws]
            series[0, 0] = 1.0
            for o, q in enumerate(shares):
                if o != v:
                    grown = np.zeros_like(series)
                    for c in range(min(m, n - m + 1)):
                        grown[:, c:] += series[:, : series.shape[1] - c] * q**c / factorials[c]
                    if m <= n - m:
                        grown[1:, m:] += series[:-1, : series.shape[1] - m] * q**m / factorials[m]
                    series = grown
            won[v] += factorials[n] * p**m / factorials[m] * (series[:, n - m] / (1 + np.arange(most + 1))).sum()
    return won


def expected_majority(df: DataFrame, keys: Sequence[str], vote: str, value: str, n: int) -> DataFrame:
    """(keys, mean, std): the exact limit of ``bootstrap_majority`` for ``n`` draws.

    A winning vote's first draw is any of its samples alike often, so the value's mean and square follow from the shares of the
    votes and the means over their samples.
    """
    each = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.avg(F.pow(F.col(value), 2)).alias("s"))
    votes = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "m", "s"))).alias("__v"))  # one entry a vote

    @F.pandas_udf("struct<mean: double, std: double>")
    def limit(lists: pd.Series) -> pd.DataFrame:
        out = []
        for entries in lists:
            won = _majority_shares([e["n"] for e in entries], n)
            mean, square = (float(won @ np.array([e[k] for e in entries])) for k in ("m", "s"))
            out.append((mean, max(square - mean * mean, 0.0) ** 0.5))
        return pd.DataFrame(out, columns=["mean", "std"])

    return votes.select(*keys, limit("__v").alias("__l")).select(*keys, "__l.mean", "__l.std")


def bootstrap_majority(df: DataFrame, keys: Sequence[str], vote: str, value: str, order: str, n: int, draws: int = 1000, seed: int = 42):
    """Mean and deviation of the majority value over seeded draws of n samples with replacement.

    ``order`` numbers the samples of a prompt from 0 without gaps.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    # Groups are a small table of few tasks that the draws make large, so they are dealt over all cores first.
    dealt = sizes.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
    picks = dealt.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    picked = picks.withColumn(order, F.pmod(seeded_long(seed, "majority", *keys, "draw", "turn"), F.col("__size")))
    # Spark takes the picks for no larger than the sizes, and would send all of them through the driver as a broadcast.
    picked = picked.drop("__size").hint("merge")
    sampled = picked.join(df.select(*keys, F.col(order).cast("bigint").alias(order), vote, value), [*keys, order])
    per_draw = majority_value(sampled, [*keys, "draw"], vote, value, "turn")
    return per_draw.groupBy(*keys).agg(F.avg("majority").alias("mean"), F.stddev_pop("majority").alias("std"))


def _spread(name: str, c: Column) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def array_sum(c: ColumnOrName) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda a, x: a + x.cast("double"))


def rollout_sequence_metrics(df: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """One row from one row per response: score, reward, prompt_length, response_length.

    Score and reward leave aborted responses (length 0) out.
    """
    alive = F.col("response_length") > 0
    lengths = F.col("response_length")
    aggs = []
    for name in ("score", "reward"):
        aggs += _spread(name, F.when(alive, F.col(name)))
    aggs += _spread("response_length", lengths) + [F.avg((lengths == max_response).cast("double")).alias("response_clip_ratio")]
    living = F.when(alive, lengths)
    aggs += _spread("living_length", living) + [F.avg((living == max_response).cast("double")).alias("living_clip_ratio")]
    aggs += [F.avg((~alive).cast("double")).alias("aborted_ratio")]
    aggs += _spread("prompt_length", F.col("prompt_length"))
    aggs += [F.avg((F.col("prompt_length") == max_prompt).cast("double")).alias("prompt_clip_ratio")]
    return df.agg(*aggs)


def rollout_token_metrics(tokens: DataFrame) -> DataFrame:
    """One row from one row per valid response token: advantage, return, value."""
    gap = F.col("return") - F.col("value")
    aggs = [c for name in ("advantage", "return", "value") for c in _spread(name, F.col(name))]
    explained = 1.0 - F.var_samp(gap) / (F.var_samp("return") + 1e-5)
    return tokens.agg(*aggs, explained.alias("explained_variance"))


def throughput(df: DataFrame, prompt_tokens: str, response_tokens: str, seconds: dict[str, float], devices: int) -> DataFrame:
    """Seconds and milliseconds per token of each stage, tokens per second and device of the ``step`` stage.

    The ``gen`` stage counts response tokens only.
    """
    sums = df.agg(F.sum(prompt_tokens).alias("__p"), F.sum(response_tokens).alias("__r"))
    total = F.col("__p") + F.col("__r")
    out = [total.alias("total_tokens")]
    for stage, spent in seconds.items():
        out.append(F.lit(float(spent)).alias(f"{stage}_seconds"))
        if stage != "step":
            counted = F.col("__r") if stage == "gen" else total
            out.append((F.lit(float(spent)) * 1000 / counted).alias(f"{stage}_ms_per_token"))
    if "step" in seconds:
        out.append((total / F.lit(float(seconds["step"] * devices))).alias("tokens_per_second_per_device"))
    return sums.select(*out)


def group_mean_std(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """Mean, floored sample deviation and count per group; a group of one has mean 0 and deviation 1."""
    n = F.count(F.lit(1))
    deviation = F.sqrt(F.greatest(F.var_samp(score), F.lit(eps)))
    return df.groupBy(group).agg(
        F.when(n <= 1, 0.0).otherwise(F.avg(score)).alias("mean"),
        F.when(n <= 1, 1.0).otherwise(deviation).alias("std"),
        n.alias("n"),
    )


def weight_summary(tokens: DataFrame, sequence: str, log_ratio: str, level: str = "token", upper: float = 2.0, lower: float | None = None):
    """One-row summary of importance weights over valid tokens, before truncation.

    Deviation and effective sample size use weights clamped to the band; sequence statistics use the
    mean weight of each sequence.
    """
    lower = 1.0 / upper if lower is None else lower
    per = tokens.groupBy(sequence).agg(F.sum(log_ratio).alias("__sum"), F.avg(log_ratio).alias("__avg"), F.count(F.lit(1)).alias("__n"))
    if level == "token":
        x = F.col(log_ratio)
        w = F.exp(clamp(x, -SAFETY_BOUND, SAFETY_BOUND))
        high, low = F.avg((w > upper).cast("double")), F.avg((w < lower).cast("double"))
        extremes = [F.max(w).alias("max"), F.min(w).alias("min")]
        rows = tokens.withColumn("__w", w)
        weight_of_row = F.lit(1)
    else:
        x = F.col("__sum") if level == "sequence" else F.col("__avg")
        w = F.exp(clamp(x, -SAFETY_BOUND, SAFETY_BOUND))
        high = F.avg((x > F.log(F.lit(float(upper)))).cast("double"))
        low = F.avg((x < F.log(F.lit(float(lower)))).cast("double"))
        extremes = [F.exp(clamp(F.max(x), high=SAFETY_BOUND)).alias("max"), F.exp(F.min(x)).alias("min")]
        rows = per.withColumn("__w", w)
        # Every token of a sequence has its weight, so a sequence counts once per token in token means.
        weight_of_row = F.col("__n")
    k = weight_of_row
    held = clamp(F.col("__w"), lower, upper)

    def mean(c):
        return F.sum(c * k) / F.sum(k)

    token_part = rows.agg(
        mean(F.col("__w")).alias("mean"),
        *extremes,
        high.alias("fraction_high"),
        low.alias("fraction_low"),
        mean(held).alias("__m"),
        mean(held * held).alias("__m2"),
        F.sum(k).alias("__k"),
    )
    if level == "token":
        sequences = rows.groupBy(sequence).agg(F.avg("__w").alias("__s"))
    else:
        sequences = rows.select(F.col("__w").alias("__s"))
    s = F.col("__s")
    seq_part = sequences.agg(
        F.struct(
            F.avg(s).alias("seq_mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("seq_std"), F.max(s).alias("seq_max"),
            F.min(s).alias("seq_min"), F.max(F.abs(s - 1.0)).alias("seq_max_deviation"),
            F.avg((s > upper).cast("double")).alias("seq_fraction_high"), F.avg((s < lower).cast("double")).alias("seq_fraction_low"),
        )
    ).scalar()
    m, m2 = F.col("__m"), F.col("__m2")
    return (
        token_part.withColumn("std", F.when(F.col("__k") > 1, F.sqrt(F.greatest(m2 - m * m, F.lit(0.0)))).otherwise(0.0))
        .withColumn("effective_sample_size", 1.0 / (m2 / ((m + 1e-8) * (m + 1e-8))))
        .withColumn("__seq", seq_part)
        .select("*", "__seq.*")
        .drop("__m", "__m2", "__k", "__seq")
    )


def off_policy_metrics(tokens: DataFrame, sequence: str, train: str, rollout: str) -> DataFrame:
    """Perplexities, divergences and chi-square of the trained against the rollout policy, over valid tokens."""
    t, r = F.col(train), F.col(rollout)
    x = t - r
    rho2 = F.pow(F.exp(clamp(x, -SAFETY_BOUND, SAFETY_BOUND)), 2)
    per = tokens.groupBy(sequence).agg(
        F.avg(t).alias("t"), F.avg(r).alias("r"), F.sum(x).alias("x"), F.count(F.lit(1)).alias("n"),
        F.sum(r - t).alias("kl"), F.sum(F.exp(x) - x - 1).alias("k3"), F.sum(rho2).alias("rho2"),
    )
    gap = F.col("r") - F.col("t")
    n = F.sum("n")
    return per.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"),
        F.avg(-F.col("t")).alias("training_log_ppl"),
        (F.sum("kl") / n).alias("kl"),
        (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"),
        F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"),
        F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("rho2") / n - 1.0).alias("chi2_token"),
        (F.avg(F.exp(2.0 * clamp(F.col("x"), -SAFETY_BOUND, SAFETY_BOUND))) - 1.0).alias("chi2_seq"),
    )


def category_accuracy(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy and count per category, and over all rows (category null): sum(acc * n) / sum(n)."""
    return df.rollup(category).agg(F.avg(correct.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def option_match(prediction: ColumnOrName, gold: ColumnOrName) -> Column:
    """First word of one side inside the first word of the other, without case and full stops."""

    def option(c):
        return F.get(F.split(F.lower(col(c)), " "), F.lit(0))

    p, g = option(prediction), option(gold)
    return g.contains(F.replace(p, F.lit("."), F.lit(""))) | p.contains(g)


def containment_scores(df: DataFrame, group: str, category: str, prediction: ColumnOrName, golds: ColumnOrName) -> DataFrame:
    """Golds found inside the prediction, summed per category and per group of categories (category null)."""
    answer = F.lower(F.trim(F.replace(col(prediction), F.lit("\n"), F.lit(" "))))
    hits = let(answer, lambda a: F.size(F.filter(col(golds), lambda g: a.contains(F.lower(F.trim(g))))))
    scored = df.withColumn("__hits", hits.cast("bigint"))
    per = scored.groupBy(group, category).agg(F.sum("__hits").alias("score"), F.count(F.lit(1)).alias("n"))
    totals = per.groupBy(group).agg(F.sum("score").alias("score"), F.sum("n").alias("n")).withColumn(category, F.lit(None).cast("string"))
    return per.unionByName(totals)


def pairwise_accuracy(df: DataFrame, group: str, order: str, score: str, label: str) -> DataFrame:
    """Share of pairs in a group that score and label rank alike, weighted by the label gap.

    Labels are 0 or 1, so only pairs of unlike labels weigh anything and the sum is a rank count: no
    pair is built. Equal scores agree when the earlier row of the pair does not have the higher label.
    A group without label gap counts 0.5. One row: the mean over groups.
    """
    counts = df.groupBy(group, score).agg(
        F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg")
    )
    ranked = counts.join(_negatives_below(df, group, score, label), [group, score])
    ties = _tied_pairs(df, group, order, score, label)
    sums = ranked.groupBy(group).agg(
        F.sum(F.col("pos") * F.col("neg_below")).alias("__right"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n")
    )
    joined = sums.join(ties, group, "left")
    pairs = F.col("__p") * F.col("__n")
    share = (F.col("__right") + F.coalesce(F.col("__tied"), F.lit(0))) / pairs
    return joined.agg(F.avg(F.when(pairs == 0, 0.5).otherwise(share)).alias("accuracy"))


def _negatives_below(df, group, score, label):
    """Rows of label 0 with a smaller score, for each score of a group."""
    counts = df.groupBy(group, score).agg(F.count_if(F.col(label) <= 0).alias("neg"))
    placed = value_running_sum(counts, score, "neg", [group])
    return placed.select(group, score, F.col("neg_before").alias("neg_below"))


def _tied_pairs(df, group, order, score, label):
    """Pairs of equal score and unlike label whose earlier row has label 0.

    A tied pair predicts "not higher" for its earlier row, which is right when that row has label 0.
    """
    marked = df.withColumn("__neg", (F.col(label) <= 0).cast("bigint"))
    placed = with_position(marked, order, "__pos", sums=["__neg"], within=[group, score])
    return placed.filter(F.col(label) > 0).groupBy(group).agg(F.sum("__neg_before").alias("__tied"))


def metric_reduction(df: DataFrame, name: str, value: str) -> DataFrame:
    """One value per metric name: the largest for names with "max", the smallest for "min", else the mean."""
    stats = df.groupBy(name).agg(F.avg(value).alias("__avg"), F.max(value).alias("__max"), F.min(value).alias("__min"))
    chosen = F.when(F.col(name).contains("max"), F.col("__max")).when(F.col(name).contains("min"), F.col("__min"))
    return stats.select(name, chosen.otherwise(F.col("__avg")).alias("value"))


def preference_balance(df: DataFrame, desirable: Column, desirable_weight: float = 1.0, undesirable_weight: float = 1.0):
    """Counts of both labels, and the weight ranges that bring their ratio between 1 and 1.33."""
    found = df.agg(F.greatest(F.count_if(desirable), F.lit(1)).alias("n_desirable"), F.count(F.lit(1)).alias("__n"))
    rest = F.greatest(F.col("__n") - F.col("n_desirable"), F.lit(1))
    counts = found.withColumn("n_undesirable", rest).drop("__n")
    d, u = F.col("n_desirable"), F.col("n_undesirable")
    return counts.select(
        "*",
        F.round(u * undesirable_weight / d, 2).alias("desirable_low"),
        F.round(u * undesirable_weight / d * 1.33, 2).alias("desirable_high"),
        F.round(d * desirable_weight / u / 1.33, 2).alias("undesirable_low"),
        F.round(d * desirable_weight / u, 2).alias("undesirable_high"),
    )


def chunk_counts(chunks: DataFrame, dataset: str, ratio_column: ColumnOrName) -> DataFrame:
    """Per dataset: documents, train documents, valid and invalid chunks, train chunks and the sampled number.

    Rows have doc, is_train, is_valid; the sampled number is the rounded-up share of train chunks.
    """
    docs = chunks.groupBy(dataset, "doc").agg(
        F.bool_or("is_train").alias("__t"),
        F.count_if("is_valid").alias("__valid"),
        F.count_if(~F.col("is_valid")).alias("__invalid"),
        F.count_if(F.col("is_valid") & F.col("is_train")).alias("__train"),
        F.max(col(ratio_column)).alias("__r"),
    )
    return docs.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("__t").alias("n_docs_train"),
        F.sum("__valid").alias("n_valid"),
        F.sum("__invalid").alias("n_invalid"),
        F.sum("__train").alias("n_train"),
        F.ceil(F.sum("__train") * F.max("__r")).alias("n_sampled"),
    )


def environment_metrics(steps: DataFrame, episode: str, trajectory: str, good: float = 0.5) -> DataFrame:
    """One row from step rows (prompt_tokens, response_tokens) with their trajectory's ``reward``."""
    t = steps.groupBy(episode, trajectory).agg(
        F.sum("prompt_tokens").alias("ob"), F.sum("response_tokens").alias("ac"), F.count(F.lit(1)).alias("turns"),
        F.max("reward").alias("reward"),
    )
    e = t.groupBy(episode).agg(
        F.sum("ob").alias("ob"), F.sum("ac").alias("ac"), F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"),
        F.sum("reward").alias("reward"), F.min("reward").alias("lo"), F.max("reward").alias("hi"),
    )
    same = F.col("lo") == F.col("hi")
    n, turns = F.sum("n"), F.sum("turns")
    return e.agg(
        (F.sum("reward") / n).alias("reward_mean"),
        (F.sum("ob") / turns).alias("ob_tokens_per_turn"),
        (F.sum("ac") / turns).alias("ac_tokens_per_turn"),
        (F.sum("ob") / n).alias("ob_tokens_per_trajectory"),
        (F.sum("ac") / n).alias("ac_tokens_per_trajectory"),
        n.alias("n_trajectories"),
        turns.alias("n_turns"),
        (turns / n).alias("turns_per_trajectory"),
        F.sum("ob").alias("total_ob_tokens"),
        F.sum("ac").alias("total_ac_tokens"),
        F.avg((same & (F.col("lo") >= good)).cast("double")).alias("frac_all_good"),
        F.avg((same & (F.col("lo") < good)).cast("double")).alias("frac_all_bad"),
        F.avg((~same).cast("double")).alias("frac_mixed"),
    )


def step_info_means(steps: DataFrame, info: str) -> DataFrame:
    """Mean of each numeric entry of a map column; entries that are not numbers are skipped."""
    entries = steps.select(F.explode(info).alias("name", "value")).withColumn("value", F.col("value").try_cast("double"))
    return entries.filter("value is not null").groupBy("name").agg(F.avg("value").alias("mean"))


def logprob_metrics(tokens: DataFrame, sampling: str, training: str) -> DataFrame:
    """Divergence of sampling from training log-probabilities, entropy and perplexity, over action tokens."""
    gap = F.col(sampling) - F.col(training)
    return tokens.agg(
        F.avg(gap).alias("kl_v1"),
        (0.5 * F.avg(gap * gap)).alias("kl_v2"),
        (-F.avg(sampling)).alias("entropy"),
        F.exp(-F.avg(sampling)).alias("perplexity"),
    )


def neighbour_lengths(df: DataFrame, neighbours: str, tokens, k: int, cut: int = 128) -> DataFrame:
    """One row: count, maximum, number over the cut, and the ten longest, of the first k neighbours' lengths."""
    lengths = df.select(F.explode(F.slice(neighbours, 1, k)).alias("__t")).select(F.size(tokens(F.col("__t"))).alias("n"))
    longest = lengths.orderBy(F.desc("n")).limit(10).agg(F.sort_array(F.collect_list("n"))).scalar()
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest"), F.count_if(F.col("n") > cut).alias("n_cut")).withColumn("top", longest)


def rouge_bleu(df: DataFrame, prediction: str, gold: str) -> DataFrame:
    """Corpus means x100 of rouge-1, rouge-2, rouge-L F scores and sentence BLEU-4 over word tokens."""
    names = ["rouge_1", "rouge_2", "rouge_l", "bleu_4"]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def scores(hypotheses: pd.Series, references: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_text_scores(list(h), list(r)) for h, r in zip(hypotheses, references)], columns=names)

    filled = df.filter((F.size(words(prediction)) > 0) & (F.size(words(gold)) > 0))
    rated = filled.select(scores(words(prediction), words(gold)).alias("s"))
    return rated.agg(*[(F.avg(f"s.{n}") * 100).alias(n) for n in names], F.count(F.lit(1)).alias("n"))


def _text_scores(hyp: list[str], ref: list[str]) -> tuple[float, float, float, float]:
    def grams(tokens, n):
        return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))

    def f_score(same, a, b):
        return 2.0 * same / (a + b) if same else 0.0

    def rouge_n(n):
        # Distinct n-grams, as the public rouge package counts them.
        a, b = set(grams(hyp, n)), set(grams(ref, n))
        return f_score(len(a & b), len(a), len(b))

    row = [0] * (len(ref) + 1)
    for h in hyp:
        last = 0
        for j, r in enumerate(ref, 1):
            kept, row[j] = row[j], (last + 1 if h == r else max(row[j], row[j - 1]))
            last = kept
    longest = f_score(row[-1], len(hyp), len(ref))

    logs, bleu, missing = [], 0.0, 0
    if hyp and ref:
        for n in range(1, 5):
            a, b = grams(hyp, n), grams(ref, n)
            same, total = (a & b).total(), max(1, a.total())
            # The k-th order without a match counts 1 / 2**k matches.
            missing += not same
            logs.append(math.log((same if same else 0.5**missing) / total))
        brevity = min(1.0, math.exp(1 - len(ref) / len(hyp)))
        bleu = brevity * math.exp(sum(logs) / 4) if grams(hyp, 1).keys() & grams(ref, 1).keys() else 0.0
    return rouge_n(1), rouge_n(2), longest, bleu
