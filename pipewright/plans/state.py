"""What the planner carries from verb to verb, and expressions as Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions import registry
from ..functions.scalar import divide
from . import ast as A


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


@dataclass(frozen=True)
class State:
    """A frame that may still hold columns an earlier select left out, so that later verbs can name them.

    ``visible`` are the columns of the pipeline's result so far, in order. Catalyst prunes the others.
    """

    df: DataFrame
    visible: tuple[str, ...]
    groups: tuple[str, ...] = ()
    table: Callable[[str], DataFrame] | None = None

    @property
    def hidden(self) -> list[str]:
        seen = {v.lower() for v in self.visible}
        return [c for c in self.df.columns if c.lower() not in seen]

    def to(self, df: DataFrame, visible=None, **other) -> State:
        return replace(self, df=df, visible=tuple(self.visible if visible is None else visible), **other)

    def result(self) -> DataFrame:
        return self.df if list(self.visible) == self.df.columns else self.df.select(*(column(c) for c in self.visible))


ARRIVAL = "__arrival"


class Scope:
    """Where an expression is evaluated: its columns and the window's partition."""

    def __init__(self, df: DataFrame, partition: tuple[str, ...] = (), resolve: Callable[[str], Column] | None = None):
        self.df, self.partition = df, [column(g) for g in partition]
        self.resolve = resolve or column
        self.arrival = column(ARRIVAL)

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def build(self, node: A.Node) -> Column:
        if isinstance(node, A.Name):
            return self.resolve(node.text)
        if isinstance(node, A.Number):
            return F.lit(node.value)
        if isinstance(node, (A.Text, A.Flag)):
            return F.lit(node.value)
        if isinstance(node, A.Missing):
            return F.lit(None)
        if isinstance(node, A.Unary):
            x = self.build(node.operand)
            return -x if node.op == "-" else ~x
        if isinstance(node, A.Binary):
            return OPERATORS[node.op](self.build(node.left), self.build(node.right))
        if isinstance(node, A.Call):
            f, args = registry.bind(node)
            formals = (*f.formals, *[""] * (len(args) - len(f.formals)))
            return f.build(self, *(x if x is None or n in f.raw else self.build(x) for n, x in zip(formals, args, strict=True)))
        raise PlanError(f"{type(node).__name__} can't stand here")


OPERATORS = {
    "|": lambda a, b: a | b,
    "&": lambda a, b: a & b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
}


def windows_in(node: A.Node) -> tuple[bool, bool]:
    """Whether an expression holds a window function, and one that needs rows to stand as they came."""
    calls = [x for x in node.walk() if isinstance(x, A.Call) and x.name.lower() in registry.FUNCTIONS]
    found = [x for x in calls if registry.lookup(x.name).window]
    unordered = [x for x in found if registry.lookup(x.name).window == "position" and _order(x) is None]
    return bool(found), bool(unordered)


def _order(call: A.Call) -> A.Node | None:
    f, args = registry.bind(call)
    return next((a for n, a in zip(f.formals, args, strict=True) if n in ("order", "order_by")), None)


def with_arrival(df: DataFrame, needed: bool) -> DataFrame:
    """Number rows as they come, before a shuffle can move them."""
    return df.withColumn(ARRIVAL, F.monotonically_increasing_id()) if needed else df
