"""Chat templates as data, compiled to column expressions: the prompt text, its loss spans, and the way back."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ColumnOrName, col
from .text import strip


@dataclass(frozen=True)
class ChatTemplate:
    """How a family of models writes a conversation.

    ``turns`` maps a role to the marks before and behind its content. ``begin`` opens the text, ``default_system`` is the system
    text of conversations that bring none, ``generation`` asks for the next answer, and contents of ``stripped`` roles lose
    white space at their ends. No start mark may be the beginning of another role's unless the longer one says more, and contents must
    not hold marks if the text is to be read back.
    """

    turns: Mapping[str, tuple[str, str]]
    begin: str = ""
    default_system: str | None = None
    generation: str = ""
    stripped: tuple[str, ...] = ()


# Marks of the template families.
_IM = ("<|im_start|>{}\n", "<|im_end|>\n")
_HEADER = ("<|start_header_id|>{}<|end_header_id|>\n\n", "<|eot_id|>")
TEMPLATES: dict[str, ChatTemplate] = {
    "im": ChatTemplate(
        turns={
            **{role: (_IM[0].format(role), _IM[1]) for role in ("system", "user", "assistant")},
            "tool": (_IM[0].format("user") + "<tool_response>\n", "\n</tool_response>" + _IM[1]),
        },
        default_system="You are a helpful assistant.",
        generation=_IM[0].format("assistant"),
        stripped=("assistant",),
    ),
    "header": ChatTemplate(
        turns={
            **{role: (_HEADER[0].format(role), _HEADER[1]) for role in ("system", "user", "assistant")},
            "tool": (_HEADER[0].format("user") + _HEADER[0].format("tool_response"), _HEADER[1] * 2),
        },
        begin="<|begin_of_text|>",
        generation=_HEADER[0].format("assistant"),
    ),
    "bar": ChatTemplate(
        turns={
            "system": ("", ""),
            "user": ("<｜User｜>", ""),
            "assistant": ("<｜Assistant｜>", "<｜end▁of▁sentence｜>"),
            "tool": ("<｜User｜><｜tool▁response▁begin｜>\n", "\n<｜tool_response_end｜>"),
        },
        begin="<｜begin▁of▁sentence｜>",
        generation="<｜Assistant｜><think>\n",
        stripped=("assistant",),
    ),
}


def template(name: str, **changes) -> ChatTemplate:
    """A family's template, with changes such as another ``default_system``."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}, one of {sorted(TEMPLATES)}")
    return replace(TEMPLATES[name], **changes)


def _by_role(role: Column, values: Mapping[str, str]) -> Column:
    chosen = F.raise_error(F.concat(F.lit("unsupported role "), F.coalesce(role, F.lit("null")))).cast("string")
    for name, value in values.items():
        chosen = F.when(role == name, F.lit(value)).otherwise(chosen)
    return chosen


def _content(t: ChatTemplate, m: Column) -> Column:
    content = F.coalesce(m["content"], F.lit(""))
    return F.when(m["role"].isin(list(t.stripped)), strip(content)).otherwise(content) if t.stripped else content


def template_turns(t: ChatTemplate, messages: ColumnOrName) -> Column:
    """Array of (role, start, content, end) texts; the system default is a turn of its own."""
    messages = col(messages)
    if t.default_system is not None:
        default = F.array(F.struct(F.lit("system").alias("role"), F.lit(t.default_system).alias("content")))
        plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        given = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
        messages = F.when(given, plain).otherwise(F.concat(default, plain))
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            _by_role(m["role"], {r: s for r, (s, _) in t.turns.items()}).alias("start"),
            _content(t, m).alias("content"),
            _by_role(m["role"], {r: e for r, (_, e) in t.turns.items()}).alias("end"),
        ),
    )


def render_template(t: ChatTemplate, messages: ColumnOrName, generation: bool = False) -> Column:
    """The conversation as text; an unknown role is an error."""
    turns = F.transform(template_turns(t, messages), lambda x: F.concat(x["start"], x["content"], x["end"]))
    return F.concat(F.lit(t.begin), F.array_join(turns, ""), F.lit(t.generation if generation else ""))


def parse_template(t: ChatTemplate, text: ColumnOrName) -> Column:
    """Array of (role, content) read back from a rendered text; a text that begins otherwise gives null."""
    marks = sorted(((s, r) for r, (s, _) in t.turns.items() if s), key=lambda x: -len(x[0]))
    text = col(text)
    body = F.when(text.startswith(t.begin), F.substring(text, len(t.begin) + 1, 1 << 30))
    parts = F.split(body, "(?=" + "|".join(re.escape(s) for s, _ in marks) + ")")
    # a longer mark may hold a shorter one further on: what follows its first part belongs to it
    bare = next((r for r, (s, _) in t.turns.items() if not s), None)

    def turn(part: Column) -> Column:
        found = None
        for s, r in marks:
            e = t.turns[r][1]
            rest = F.substring(part, len(s) + 1, 1 << 30)
            content = F.when(rest.endswith(e), F.left(rest, F.length(rest) - len(e))).otherwise(rest) if e else rest
            one = F.struct(F.lit(r).alias("role"), content.alias("content"))
            found = F.when(part.startswith(s), one) if found is None else found.when(part.startswith(s), one)
        return found if bare is None else found.otherwise(F.struct(F.lit(bare).alias("role"), part.alias("content")))

    return F.transform(F.filter(parts, lambda p: p != ""), turn)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _starts(sizes: pd.Series) -> pd.Series:
    """For each list of sizes, the sum of those before each place."""
    return sizes.map(lambda x: None if x is None else np.cumsum(np.append(0, x))[:-1])


def loss_spans(t: ChatTemplate, messages: ColumnOrName, role: str = "assistant") -> Column:
    """Array of (start, end): code points of the rendered text that a model is to learn, each answer with its end mark."""
    turns = template_turns(t, messages)
    sizes = F.transform(turns, lambda x: (F.length(x["start"]) + F.length(x["content"]) + F.length(x["end"])).cast("bigint"))

    def span(turn: Column, start: Column) -> Column:
        first = start + F.length(turn["start"]) + len(t.begin)
        last = first + F.length(turn["content"]) + F.length(turn["end"])
        return F.struct(turn["role"].alias("role"), first.cast("bigint").alias("start"), last.cast("bigint").alias("end"))

    mine = F.filter(F.zip_with(turns, _starts(sizes), span), lambda x: x["role"] == role)
    return F.transform(mine, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
