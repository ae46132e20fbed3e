"""Aggregates of summarise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, UnsupportedAggregate
from ..plans import ast as A

AGGREGATES = {
    "n": lambda c: F.count(F.lit(1)),
    "count": F.count,
    "mean": F.avg,
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "mode": lambda c: F.mode(c, True),
    "n_distinct": F.countDistinct,  # beyond the common language
}
SQL_NAMES = {"n": "count", "mean": "avg"}


def aggregate(call: A.Call, resolve) -> tuple[Column, str]:
    """The Column of an aggregate call and its name where the text gives none."""
    name = call.name.lower()
    build = AGGREGATES.get(name)
    if build is None:
        raise UnsupportedAggregate(f"unknown aggregate {call.name!r}", hint=f"Aggregates: {', '.join(AGGREGATES)}")
    if name == "n":
        return build(None), "count(*)"
    if len(call.args) != 1:
        raise ArgumentError(f"{call.name} takes one column")
    column = call.args[0].text
    return build(resolve(column)), f"{SQL_NAMES.get(name, name)}({column})"
