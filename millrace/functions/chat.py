"""Conversation columns: building, checking, rendering and masking message arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MESSAGE_ROLES
from .columns import ColumnOrName, col, let
from .text import split_keeping_delimiters

# Role names of other conversation formats.
ROLE_ALIASES = {
    "human": "user",
    "gpt": "assistant",
    "bot": "assistant",
    "function_call": "tool_call",
    "function-call": "tool_call",
    "function_response": "tool_response",
    "function-response": "tool_response",
    "observation": "tool_response",
    "observations": "tool_response",
}


def message(role: ColumnOrName, content: ColumnOrName, loss: Column | None = None) -> Column:
    loss = F.lit(None) if loss is None else loss
    return F.struct(
        (F.lit(role) if isinstance(role, str) else role).alias("role"),
        col(content).alias("content"),
        loss.cast("double").alias("loss"),
    )


def query_response_messages(
    query: ColumnOrName,
    response: ColumnOrName,
    system: ColumnOrName | None = None,
    history: ColumnOrName | None = None,
) -> Column:
    """Messages of a query and response, after an optional system text and history pairs.

    ``history`` is an array of [query, response] arrays. Null contents give no message.
    """
    pairs = F.array(F.array(col(query), col(response)))
    if history is not None:
        pairs = F.concat(F.coalesce(col(history), F.array().cast("array<array<string>>")), pairs)
    turns = F.flatten(
        F.transform(pairs, lambda p: F.array(message("user", F.get(p, F.lit(0))), message("assistant", F.get(p, F.lit(1)))))
    )
    if system is not None:
        turns = F.concat(F.array(message("system", system)), turns)
    return F.filter(turns, lambda m: m["content"].isNotNull())


def instruction_query(instruction: ColumnOrName, extra: ColumnOrName) -> Column:
    """Instruction and input on two lines, or the one that has text."""
    first, second = (F.when(col(c) != "", col(c)) for c in (instruction, extra))
    return F.concat_ws("\n", first, second)


def standard_role(role: Column) -> Column:
    mapped = role
    for alias, name in ROLE_ALIASES.items():
        mapped = F.when(role == alias, name).otherwise(mapped)
    return mapped


def standard_messages(
    messages: ColumnOrName,
    role_key: str = "role",
    content_key: str = "content",
    system: ColumnOrName | None = None,
) -> Column:
    """Rename keys and roles; a system text is put first unless the messages begin with one."""
    turns = F.transform(col(messages), lambda m: message(standard_role(m[role_key]), m[content_key]))
    if system is None:
        return turns
    hoist = (F.get(turns, F.lit(0))["role"] != "system") & col(system).isNotNull()
    return F.when(hoist, F.concat(F.array(message("system", system)), turns)).otherwise(turns)


def paired_messages(
    pairs: ColumnOrName, user_key: str, assistant_key: str, system: ColumnOrName | None = None
) -> Column:
    """Messages from an array of one-struct turns that hold both sides."""
    turns = F.flatten(
        F.transform(col(pairs), lambda p: F.array(message("user", p[user_key]), message("assistant", p[assistant_key])))
    )
    if system is None:
        return turns
    return F.when(col(system).isNotNull(), F.concat(F.array(message("system", system)), turns)).otherwise(turns)


def history_of(messages: ColumnOrName) -> Column:
    """Struct (history, query, response, system): the inverse of ``query_response_messages``."""
    messages = col(messages)
    system = F.when(F.get(messages, F.lit(0))["role"] == "system", F.get(messages, F.lit(0))["content"])
    start = F.when(system.isNotNull(), 1).otherwise(0)
    turns = F.slice(messages, start + 1, F.greatest(F.size(messages) - start, F.lit(0)))

    def paired(bound):
        n_pairs = F.ceil(F.size(bound) / 2).cast("int")
        return F.when(
            n_pairs > 0,
            F.transform(
                F.sequence(F.lit(0), n_pairs - 1),
                lambda i: F.array(F.get(bound, i * 2)["content"], F.get(bound, i * 2 + 1)["content"]),
            ),
        ).otherwise(F.array().cast("array<array<string>>"))

    def split_last(pairs):
        last = F.try_element_at(pairs, F.lit(-1))
        return F.struct(
            F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))).alias("history"),
            F.get(last, F.lit(0)).alias("query"),
            F.get(last, F.lit(1)).alias("response"),
            system.alias("system"),
        )

    return let(let(turns, paired), split_last)


def messages_problem(messages: ColumnOrName) -> Column:
    """Reason why a message array is unusable, null when it is fine."""
    messages = col(messages)
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no messages")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(MESSAGE_ROLES), F.lit(False))), "unknown role")
        .when(F.exists(messages, lambda m: m["content"].isNull()), "null content")
    )


def rejected_problem(messages: ColumnOrName, rejected: ColumnOrName) -> Column:
    last = F.try_element_at(col(messages), F.lit(-1))["content"]
    return F.when(col(rejected).isNull(), "null rejected response").when(
        col(rejected) == last, "rejected response equals the answer"
    )


def render_chat(messages: ColumnOrName, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Prompt text of a conversation; it is closed by an empty assistant turn when it has none last."""
    messages = col(messages)
    hoisted = F.get(messages, F.lit(0))["role"] == "system"
    body = F.size(messages) - F.when(hoisted, 1).otherwise(0)
    open_ended = (body > 0) & (F.try_element_at(messages, F.lit(-1))["role"] != "assistant")
    lines = F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end)))
    closing = F.array(F.lit(f"{start}assistant\n{end}"))
    return F.array_join(F.when(open_ended, F.concat(lines, closing)).otherwise(lines), "\n")


def flatten_parts(parts: ColumnOrName, image_tag: str = "<image>") -> Column:
    """Typed content parts to text: text parts joined, image parts as a tag."""
    return F.array_join(
        F.transform(col(parts), lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "image", image_tag)),
        "",
    )


def loss_mask(messages: ColumnOrName, n_tokens: Sequence | Column, strategy: str = "all") -> Column:
    """Array of 0/1 per token, turn by turn.

    ``n_tokens`` is the array of token counts per message. Strategies: ``all`` assistant turns, the
    ``last`` assistant turn, or ``after_first``: everything after the first assistant turn begins, user
    and tool turns masked. A message's own ``loss`` overrides the rule.
    """
    messages = col(messages)
    roles = F.transform(messages, lambda m: m["role"])

    def masked(bound):
        first, last, counts = bound["first"], bound["last"], bound["counts"]
        rule = {
            "all": lambda m, i: m["role"] == "assistant",
            "last": lambda m, i: (m["role"] == "assistant") & (i + 1 == last),
            "after_first": lambda m, i: ~m["role"].isin("user", "tool", "tool_response")
            & (first > 0)
            & (i + 1 >= first),
        }[strategy]
        return F.transform(
            messages,
            lambda m, i: F.array_repeat(
                F.coalesce((m["loss"] > 0).cast("int"), rule(m, i).cast("int")), F.get(counts, i).cast("int")
            ),
        )

    bound = F.struct(
        F.array_position(roles, F.lit("assistant")).alias("first"),
        _last_position(roles, "assistant").alias("last"),
        col(n_tokens).alias("counts"),
    )
    return F.flatten(let(bound, masked))


def _last_position(roles: Column, role: str) -> Column:
    """1-based, one past the end when the role is absent."""
    return F.size(roles) + 1 - F.array_position(F.reverse(roles), F.lit(role))


def loss_weights(messages: ColumnOrName, strategy: str = "default") -> Column:
    """Weight per message: ``default`` assistant turns, ``last_round``, or ``all`` turns."""
    messages = col(messages)
    roles = F.transform(messages, lambda m: m["role"])
    if strategy not in ("all", "default", "last_round"):
        raise ValueError(f"unknown strategy {strategy!r}")

    def weight(m, i, last_user):
        assistant = m["role"] == "assistant"
        # A message's own weight counts for assistant turns only.
        own = F.when(assistant, m["loss"])
        if strategy == "all":
            return F.coalesce(own, F.lit(1.0))
        if strategy == "last_round":
            assistant = assistant & (i + 1 > last_user)
        return F.coalesce(own, assistant.cast("double"))

    last_user = F.when(F.array_contains(roles, "user"), _last_position(roles, "user")).otherwise(0)
    return let(last_user, lambda last: F.transform(messages, lambda m, i: weight(m, i, last)))


def delimiter_weights(response: ColumnOrName, weights: dict[str, tuple[float, ...]]) -> Column:
    """Array of (content, weight): the response cut at the delimiters of the map.

    A delimiter with two weights gives one to itself and one to the text after it; with one weight, the
    delimiter is a pattern and a match takes that weight. Text under no delimiter weighs 1.
    """
    pairs = {k: v for k, v in weights.items() if len(v) == 2}

    def part(content, weight):
        return F.struct(content.alias("content"), weight.cast("double").alias("weight"))

    if pairs:
        first = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, float(v[0]))])
        second = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, float(v[1]))])
        cut = split_keeping_delimiters(response, list(pairs))
        nested = F.transform(
            cut,
            lambda p: F.when(p["key"] == "", F.array(part(p["content"], F.lit(1.0)))).otherwise(
                F.array(part(p["key"], first[p["key"]]), part(p["content"], second[p["key"]]))
            ),
        )
        return F.flatten(nested)
    pattern = "(?s)" + "|".join(f"(?:{k})" for k in weights)
    matches = F.regexp_extract_all(col(response), F.lit(f"({pattern})"), F.lit(1))
    between = F.split(col(response), pattern, -1)

    def weigh(text):
        chosen = F.lit(1.0)
        for key, value in reversed(list(weights.items())):
            chosen = F.when(text.rlike(f"(?s)^(?:{key})"), float(value[0])).otherwise(chosen)
        return chosen

    cut = let(
        matches,
        lambda m: F.flatten(
            F.transform(between, lambda b, i: F.array(part(b, F.lit(1.0)), part(F.get(m, i), weigh(F.get(m, i)))))
        ),
    )
    return F.filter(cut, lambda p: p["content"] != "")
