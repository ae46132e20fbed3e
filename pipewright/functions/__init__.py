"""The function registry: names of the language to Spark columns."""

from .aggregates import AGGREGATES, aggregate
from .registry import FUNCTIONS, Function, bind, register
from . import scalar, windows  # noqa: F401  (they fill the registry)

__all__ = ["AGGREGATES", "FUNCTIONS", "Function", "aggregate", "bind", "register"]
