"""User-supplied functions: rewards, metrics, row functions, tokenizers, and score routing."""

from __future__ import annotations

import importlib.util
import inspect
import pickle
import types
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import answers, rewards
from .columns import ColumnOrName, col

# States a task of ``accumulate_metric`` keeps before it sends them on.
OPEN_STATES = 100_000

# Column functions by name; each takes columns and returns a double column.
REWARDS: dict[str, Callable[..., Column]] = {
    "format": rewards.format_reward,
    "react_format": lambda c: rewards.format_reward(c, rewards.REACT),
    "cosine": rewards.cosine_length_reward,
    "repetition": rewards.repetition_penalty,
    "soft_overlong": rewards.soft_overlong,
    "final_number": answers.final_number_score,
    "search_match": answers.tag_penalised_score,
    "countdown": answers.countdown_score,
}


def register_reward(name: str, fn: Callable[..., Column]) -> None:
    if name in REWARDS:
        raise ValueError(f"reward {name!r} is registered already")
    REWARDS[name] = fn


def reward(name: str, *columns: ColumnOrName, **options) -> Column:
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name!r}, one of {sorted(REWARDS)}")
    return REWARDS[name](*columns, **options)


def batch_reward(fn: Callable[..., list[float]], **options) -> Callable[..., Column]:
    """A function (completions, solutions, **options) -> floats as a column function, by Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def scored(completions: pd.Series, solutions: pd.Series) -> pd.Series:
        return pd.Series(fn(list(completions), list(solutions), **options), dtype="float64")

    return scored


def load_reward(path: str, name: str, spark: SparkSession | None = None, **options) -> Callable[..., Column]:
    """A row function ``name`` of a Python file, keyword options bound, as a column function.

    The function takes (data_source, solution, ground_truth) and returns a number. With a session the file is read by it, from any
    file system it knows.
    """
    if spark is not None:
        module = types.ModuleType("user_reward")
        exec(compile(spark.read.text(path, wholetext=True).first()[0], path, "exec"), module.__dict__)
    else:
        spec = importlib.util.spec_from_file_location("user_reward", path)
        if spec is None or spec.loader is None:
            raise FileNotFoundError(path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    fn = getattr(module, name, None)
    if fn is None:
        raise AttributeError(f"{path} has no function {name!r}")
    unknown = set(options) - set(inspect.signature(fn).parameters)
    if unknown and not any(p.kind is p.VAR_KEYWORD for p in inspect.signature(fn).parameters.values()):
        raise TypeError(f"{name} takes no option {sorted(unknown)}")

    @F.pandas_udf(T.DoubleType())
    def scored(sources: pd.Series, solutions: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([float(fn(*row, **options)) for row in zip(sources, solutions, truths)], dtype="float64")

    return scored


REWARD_OUTPUT = T.StructType(
    [
        T.StructField("reward", T.DoubleType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def task_reward(fn: Callable[[dict, str], tuple[float, bool, dict]]) -> Callable[..., Column]:
    """A function (task, action) -> (reward, is_correct, metadata) as a struct column function.

    The task is a struct column.
    """

    @F.pandas_udf(REWARD_OUTPUT)
    def scored(tasks: pd.DataFrame, actions: pd.Series) -> pd.DataFrame:
        rows = []
        for task, action in zip(tasks.to_dict("records"), actions):
            value, correct, metadata = fn(task, action)
            rows.append((float(value), bool(correct), {str(k): str(v) for k, v in metadata.items()}))
        return pd.DataFrame(rows, columns=REWARD_OUTPUT.fieldNames())

    return scored


def accumulate_metric(
    df: DataFrame,
    keys: list[str],
    value: str,
    start: Callable[[], object],
    update: Callable[[object, pd.Series], object],
    merge: Callable[[object, object], object],
    compute: Callable[[object], float],
) -> DataFrame:
    """(keys.., value): an accumulator of the user's own over each group.

    Every task folds its Arrow batches into one state per group and sends on the states; those of a group are
    merged and computed. A group of any size needs one state a task, and at most OPEN_STATES are open at once.
    """
    kinds = T.StructType([*[df.schema[k] for k in keys], T.StructField("state", T.BinaryType())])

    def partial(batches):
        states = {}

        def sent():
            return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=kinds.fieldNames())

        for pdf in batches:
            for name, rows in pdf.groupby(keys, dropna=False, sort=False):
                name = tuple(None if pd.isna(part) else part for part in name)
                states[name] = update(states[name] if name in states else start(), rows[value])
            if len(states) > OPEN_STATES:
                yield sent()
                states = {}
        yield sent()

    @F.pandas_udf(T.DoubleType())
    def merged(states: pd.Series) -> float:
        return float(compute(reduce(merge, map(pickle.loads, states))))

    return df.select(*keys, value).mapInPandas(partial, kinds).groupBy(*keys).agg(merged("state").alias("value"))


def mean_metric(df: DataFrame, keys: list[str], value: str, empty: float = 0.0) -> DataFrame:
    """Mean of the values that are there, ``empty`` for a group without one."""
    return accumulate_metric(
        df, keys, value,
        start=lambda: (0.0, 0),
        update=lambda s, v: (s[0] + float(v.sum()), s[1] + int(v.count())),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        compute=lambda s: s[0] / s[1] if s[1] else empty,
    )


def map_rows(df: DataFrame, fn: Callable[[dict], dict | Iterable[dict] | None], schema: str | T.StructType) -> DataFrame:
    """Row function that gives no row, one row or several rows, by Arrow batches."""
    parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = parsed.fieldNames()

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                made = fn(row)
                if made is None:
                    continue
                out.extend([made] if isinstance(made, dict) else made)
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names)

    return df.mapInPandas(run, parsed)


def tokenizer_column(build: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """Column function from a tokenizer that is built once per worker, not per batch.

    A batch is Arrow on both sides, ids of four bytes: as Python objects they would take ten times that.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = build()
        for texts in batches:
            ids = [np.array([] if t is None else list(encode(t)), dtype=np.int32) for t in (x.as_py() for x in texts)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, values, mask=texts.is_null())

    return tokens


def route_scores(source: ColumnOrName, routes: Mapping[str, Column]) -> Column:
    """Score column by data source; a source without a route is an error."""
    unknown = F.raise_error(F.concat(F.lit("no score for data source "), col(source))).cast("double")
    score = None
    for name, value in routes.items():
        condition = col(source) == name
        score = F.when(condition, value) if score is None else score.when(condition, value)
    return unknown if score is None else score.otherwise(unknown)
