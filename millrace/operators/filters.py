"""Row filters: each takes a table and returns the kept rows, or is a boolean column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col
from ..functions.rewards import has_tool_error
from .ordering import row_total, with_value_position


def in_list(column: ColumnOrName, allowed: Sequence) -> Column:
    return col(column).isin(list(allowed))


def exclude_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is not in the id table; Spark picks the join by size."""
    return df.join(ids.select(on), on, "left_anti")


def quality_gate(
    subset: ColumnOrName,
    subsets: Sequence[str],
    style: ColumnOrName,
    wanted_style: str,
    passes: ColumnOrName,
    similarity: ColumnOrName,
    code: ColumnOrName,
    max_passes: int = 9,
    max_similarity: float = 0.9,
    word: str = "def",
    min_words: int = 8,
) -> Column:
    return (
        in_list(subset, subsets)
        & (col(style) == wanted_style)
        & (col(passes) < max_passes)
        & (col(similarity) < max_similarity)
        & (F.regexp_count(col(code), F.lit(word)) >= min_words)
    )


def more_than(items: ColumnOrName, n: int) -> Column:
    return F.size(col(items)) > n


def date_window(when: ColumnOrName, windows: dict[str, tuple[str, str]]) -> Column:
    """Name of the half-open [from, to) window a date falls in, null outside all."""
    name = F.lit(None).cast("string")
    for window, (start, stop) in windows.items():
        inside = (col(when) >= F.lit(start).cast("timestamp")) & (col(when) < F.lit(stop).cast("timestamp"))
        name = F.coalesce(name, F.when(inside, window))
    return name


def not_longer(n_tokens: Column, limit: int) -> Column:
    """Token count within the limit; a count that could not be taken is too long."""
    return F.coalesce(n_tokens <= limit, F.lit(False))


def lowest_half(df: DataFrame, score: str, key: str) -> DataFrame:
    """Half as many rows as the table has, those of lowest score; rows without a score never qualify."""
    n_keep = F.floor(row_total(df) / 2)
    ranked = with_value_position(df.filter(F.col(score).isNotNull()), score, key, "__rank")
    return ranked.filter(F.col("__rank") < n_keep).drop("__rank")


def score_report(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Mean and population deviation of all scores, and of those from or under the threshold."""
    s = F.col(score)
    high, low = F.when(s >= threshold, s), F.when(s < threshold, s)
    return df.filter(s.isNotNull()).agg(
        F.count(s).alias("n"),
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
        F.count(high).alias("n_high"),
        F.avg(high).alias("mean_high"),
        F.stddev_pop(high).alias("std_high"),
        F.count(low).alias("n_low"),
        F.avg(low).alias("mean_low"),
        F.stddev_pop(low).alias("std_low"),
    )


def difficulty_gate(difficulty: ColumnOrName, low: int = 2, high: int = 5, hard_from: int = 10) -> Column:
    return col(difficulty).between(low, high) | (col(difficulty) >= hard_from)


def step_error(step: Column) -> Column:
    return F.coalesce(step["step_error"], F.lit(False)) | has_tool_error(step["observation"])


def mask_reason(termination: ColumnOrName, steps: ColumnOrName, max_errors: float = 0.5) -> Column:
    """Why an episode is left out of training, null when it is kept; ``steps`` is its step array."""
    bad = F.size(F.filter(col(steps), step_error))
    return mask_reason_from_counts(termination, F.size(col(steps)), bad, max_errors)


def mask_reason_from_counts(
    termination: ColumnOrName, n_steps: ColumnOrName, n_errors: ColumnOrName, max_errors: float = 0.5
) -> Column:
    ended = F.coalesce(col(termination), F.lit(""))
    no_answer = F.when(ended == "", "no_final_answer").otherwise(ended)
    share = col(n_errors) / F.nullif(col(n_steps), F.lit(0))
    return F.when(ended != "answer", no_answer).when(share > max_errors, "tool_errors_too_many")


def usable_sample(is_valid: ColumnOrName, is_truncated: ColumnOrName, mask_truncated: bool = True) -> Column:
    return col(is_valid) & ~(col(is_truncated) & F.lit(mask_truncated))
