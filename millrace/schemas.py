"""Declared schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("loss", T.DoubleType()),
    ]
)
MESSAGES = T.ArrayType(MESSAGE)
IMAGES = T.ArrayType(
    T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
)
OBJECTS = T.StructType(
    [
        T.StructField("ref", T.ArrayType(T.StringType())),
        T.StructField("bbox", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("bbox_type", T.StringType()),
        T.StructField("image_id", T.ArrayType(T.LongType())),
    ]
)

# The standard column names of a fine-tuning row.
_BASE_KEYS = ["messages", "images", "videos", "audios", "tools", "objects"]
STANDARD_KEYS = (
    _BASE_KEYS
    + [f"{prefix}_{key}" for prefix in ("rejected", "positive", "negative") for key in _BASE_KEYS]
    + ["rejected_response", "label", "channel", "margin"]
)

# Message roles accepted by validation.
MESSAGE_ROLES = ["system", "user", "tool_call", "tool_response", "tool", "assistant"]

RL_ROW = T.StructType(
    [
        T.StructField("data_source", T.StringType()),
        T.StructField("prompt", T.ArrayType(T.StructType(MESSAGE.fields[:2]))),
        T.StructField("ability", T.StringType()),
        T.StructField(
            "reward_model",
            T.StructType([T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType())]),
        ),
        T.StructField(
            "extra_info",
            T.StructType(
                [
                    T.StructField("split", T.StringType()),
                    T.StructField("index", T.LongType()),
                    T.StructField("answer", T.StringType()),
                    T.StructField("question", T.StringType()),
                ]
            ),
        ),
    ]
)

TOKEN_CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seq_id", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
    ]
)

EVAL_TASK = T.StructType(
    [
        T.StructField("question", T.StringType(), False),
        T.StructField("answer", T.StringType(), False),
        T.StructField("images", T.ArrayType(T.StringType())),
    ]
)

TRACE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("context_type", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("updated_at", T.DoubleType()),
    ]
)
