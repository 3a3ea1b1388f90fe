"""Rule rewards over recorded responses, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, col
from .text import repetition_penalty

# Response shapes. ``\z`` is the end of the text.
THINK_ANSWER = r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z"
REACT = r"(?sm)\A<think>.*?</think>\s*Action:.*?Action Input:.*?$"
THINK_ACTION = r"(?s)^<think>.*?</think>\s*(<tool_call>.*?</tool_call>|<answer>.*?</answer>)\s*\z"
TOOL_ERRORS = [
    "[Json Parse Error]",
    "[Python Interpreter Error]",
    "Python execution error:",
    "PythonInterpreter tool not available",
    "PythonInterpreter tool is not callable",
]


def format_reward(c: ColumnOrName, shape: str = THINK_ANSWER) -> Column:
    """1 when the whole response has the shape, else 0."""
    return F.coalesce(col(c).rlike(shape).cast("double"), F.lit(0.0))


def has_tool_error(observation: ColumnOrName) -> Column:
    found = F.lit(False)
    for marker in TOOL_ERRORS:
        found = found | col(observation).contains(marker)
    return F.coalesce(found, F.lit(False))


def cosine_length_reward(
    correct: ColumnOrName,
    length: ColumnOrName,
    min_len_wrong: float = -0.5,
    max_len_wrong: float = 0.0,
    min_len_correct: float = 1.0,
    max_len_correct: float = 0.5,
    max_len: int = 1000,
) -> Column:
    """Cosine slope over the length: right answers lose and wrong ones gain as they get longer."""
    at_zero = F.when(col(correct), F.lit(min_len_correct)).otherwise(F.lit(min_len_wrong))
    at_max = F.when(col(correct), F.lit(max_len_correct)).otherwise(F.lit(max_len_wrong))
    return at_zero - (at_zero - at_max) * (1 - F.cos(col(length) * math.pi / max_len)) / 2


def soft_overlong(length: ColumnOrName, max_length: int, cache_length: int) -> Column:
    """0 up to max - cache tokens, then falling by 1 per cache length."""
    if cache_length >= max_length:
        raise ValueError("cache_length must be below max_length")
    exceed = col(length) - (max_length - cache_length)
    return F.least(-exceed / F.lit(float(cache_length)), F.lit(0.0))


def extract_action(c: ColumnOrName) -> Column:
    """Struct (type, content): a tool call, a final answer, or plain reasoning."""
    response = col(c)

    def between(opening, closing):
        after = F.get(F.split(response, opening), F.lit(1))
        return F.trim(F.get(F.split(after, closing), F.lit(0)))

    def both(opening, closing):
        return response.contains(opening) & response.contains(closing)

    tool, answer = both("<tool_call>", "</tool_call>"), both("<answer>", "</answer>")
    return F.struct(
        F.when(tool, "tool_call").when(answer, "final_answer").otherwise("reasoning").alias("type"),
        F.when(tool, between("<tool_call>", "</tool_call>"))
        .when(answer, between("<answer>", "</answer>"))
        .otherwise(response)
        .alias("content"),
    )


def vote_average(votes: ColumnOrName) -> Column:
    """Mean of the votes that are numbers, null when none is."""
    numbers = F.filter(F.transform(col(votes), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(numbers) > 0, total / F.size(numbers))


__all__ = [
    "cosine_length_reward",
    "extract_action",
    "format_reward",
    "has_tool_error",
    "repetition_penalty",
    "soft_overlong",
    "vote_average",
]
