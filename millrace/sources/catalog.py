"""Registered datasets as tables of the Spark catalog, one per (name, split)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .writers import rl_wrapper

_SEPARATOR = "__"


def _table(name: str, split: str) -> str:
    for part in (name, split):
        if not re.fullmatch(r"[A-Za-z0-9_]+", part) or _SEPARATOR in part:
            raise ValueError(f"not a dataset or split name: {part!r}")
    return f"{name.lower()}{_SEPARATOR}{split.lower()}"


class Catalog:
    """Register, load, list and remove datasets of one database."""

    def __init__(self, spark: SparkSession, database: str = "datasets", location: str | None = None):
        self.spark, self.database = spark, database
        place = "" if location is None else " LOCATION '" + location.replace("'", "\\'") + "'"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")

    def _full(self, name: str, split: str) -> str:
        return f"{self.database}.{_table(name, split)}"

    def register(self, df: DataFrame, name: str, split: str, rl_copy: bool = True) -> None:
        df.write.mode("overwrite").saveAsTable(self._full(name, split))
        if rl_copy:
            rl_wrapper(df).write.mode("overwrite").saveAsTable(self._full(name, f"{split}_rl"))

    def load(self, name: str, split: str) -> DataFrame | None:
        return self.spark.table(self._full(name, split)) if self.exists(name, split) else None

    def exists(self, name: str, split: str | None = None) -> bool:
        if split is None:
            return bool(self.splits(name))
        return self.spark.catalog.tableExists(self._full(name, split))

    def _tables(self) -> list[list[str]]:
        tables = self.spark.catalog.listTables(self.database)
        return [t.name.split(_SEPARATOR) for t in tables if _SEPARATOR in t.name and not t.isTemporary]

    def names(self) -> list[str]:
        return sorted({t[0] for t in self._tables()})

    def splits(self, name: str) -> list[str]:
        return sorted(t[1] for t in self._tables() if t[0] == name.lower() and not t[1].endswith("_rl"))

    def remove(self, name: str, split: str | None = None) -> bool:
        found = [t for t in self._tables() if t[0] == name.lower()]
        if split is not None:
            found = [t for t in found if t[1] in (split.lower(), f"{split.lower()}_rl")]
        for t in found:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{_SEPARATOR.join(t)}")
        return bool(found)
