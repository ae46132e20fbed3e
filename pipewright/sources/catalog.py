"""Tables by name: frames bound here first, then the session's catalog."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError

FORMATS = ("parquet", "orc", "csv", "json")


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        self.promised: dict[str, tuple[str, Callable[[], DataFrame]]] = {}

    def bind(self, name: str, df: DataFrame) -> None:
        """Bind a frame, and show it to plain SQL as a temporary view."""
        self.promised.pop(name.lower(), None)
        self.frames[name.lower()] = df
        df.createOrReplaceTempView("`" + name.replace("`", "``") + "`")

    def load(self, name: str, path: str, format: str = "parquet", **options) -> DataFrame:
        df = self.spark.read.format(format).options(**options).load(path)
        self.bind(name, df)
        return df

    def promise(self, name: str, make: Callable[[], DataFrame]) -> None:
        """Bind a frame when it is first asked for: a table no query names is never opened."""
        self.frames.pop(name.lower(), None)
        self.promised[name.lower()] = (name, make)

    def load_dir(self, folder: str, names, format: str = "parquet") -> None:
        """Promise ``folder/name.format`` for each name."""
        for name in names:
            self.promise(name, lambda path=f"{folder}/{name}.{format}": self.spark.read.format(format).load(path))

    def prepare(self, sql: str) -> None:
        """Bind what was promised under a name that stands in some SQL."""
        for name, _ in list(self.promised.values()):
            if re.search(rf"\b{re.escape(name)}\b", sql, re.IGNORECASE):
                self.table(name)

    def table(self, name: str) -> DataFrame:
        if name.lower() in self.promised:
            own, make = self.promised.pop(name.lower())
            self.bind(own, make())
        found = self.frames.get(name.lower())
        if found is not None:
            return found
        try:
            return self.spark.table("`" + name.replace("`", "``") + "`")
        except AnalysisException as e:
            hint = "A pipeline that starts with a verb reads the frame bound as 'data'" if name == "data" else None
            raise PlanError(f"there is no table {name!r}", hint=hint) from e

    def columns(self, name: str) -> list[str] | None:
        try:
            return self.table(name).columns
        except PlanError:
            return None
