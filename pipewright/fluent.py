"""The verbs as methods: ``tbl(df).filter("x > 1").group_by("g").summarise(n="n()").df``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .errors import PlanError
from .operators import HANDLERS
from .plans import ast as A
from .plans.parser import Parser
from .plans.state import State


def _expression(text) -> A.Node:
    if isinstance(text, A.Node):
        return text
    parser = Parser(str(text))
    node = parser.expression()
    if parser.now.kind != "end":
        raise parser.fail("end of input")
    return node


class Table:
    """A frame with verbs. Expressions are text of the pipeline language."""

    def __init__(self, state: State):
        self.state = state

    def _then(self, verb: A.Verb) -> Table:
        return Table(HANDLERS[type(verb)](self.state, verb))

    @property
    def df(self) -> DataFrame:
        return self.state.result()

    def select(self, *columns, **named) -> Table:
        return self._then(A.Select((*(A.Item(_expression(c)) for c in columns), *(A.Item(_expression(e), n) for n, e in named.items()))))

    def filter(self, condition) -> Table:
        return self._then(A.Filter(_expression(condition)))

    def mutate(self, **named) -> Table:
        return self._then(A.Mutate(tuple(A.Item(_expression(e), n) for n, e in named.items())))

    def rename(self, **new_old: str) -> Table:
        return self._then(A.Rename(tuple(new_old.items())))

    def arrange(self, *keys: str) -> Table:
        return self._then(A.Arrange(tuple(A.Key(k.lstrip("-"), k.startswith("-")) for k in keys)))

    def group_by(self, *names: str) -> Table:
        return self._then(A.GroupBy(names))

    def summarise(self, **named) -> Table:
        items = []
        for n, text in named.items():
            call = _expression(text)
            if not isinstance(call, A.Call):
                raise PlanError(f"summarise: {text!r} is not an aggregate")
            items.append(A.Item(call, n))
        return self._then(A.Summarise(tuple(items)))

    summarize = summarise

    def _join(self, kind: str, other: DataFrame | Table, by) -> Table:
        frame = other.df if isinstance(other, Table) else other
        keys = (by,) if isinstance(by, str) and by.replace(".", "_").isidentifier() else tuple(by) if isinstance(by, (list, tuple)) else ()
        verb = A.Join(kind, "", keys, None if keys else _expression(by))
        return Table(HANDLERS[A.Join](self._with(lambda _: frame), verb))

    def _set(self, kind: str, other: DataFrame | Table) -> Table:
        frame = other.df if isinstance(other, Table) else other
        return Table(HANDLERS[A.SetOp](self._with(lambda _: frame), A.SetOp(kind, "")))

    def _with(self, table: Callable[[str], DataFrame]) -> State:
        return self.state.to(self.state.df, table=table)

    def head(self, n: int) -> DataFrame:
        """The first n rows: not a verb, since nothing can follow it in a distributed order."""
        return self.df.limit(n)

    def inner_join(self, other, by) -> Table:
        return self._join("inner", other, by)

    def left_join(self, other, by) -> Table:
        return self._join("left", other, by)

    def right_join(self, other, by) -> Table:
        return self._join("right", other, by)

    def full_join(self, other, by) -> Table:
        return self._join("full", other, by)

    def semi_join(self, other, by) -> Table:
        return self._join("semi", other, by)

    def anti_join(self, other, by) -> Table:
        return self._join("anti", other, by)

    def union(self, other) -> Table:
        return self._set("union", other)

    def intersect(self, other) -> Table:
        return self._set("intersect", other)

    def setdiff(self, other) -> Table:
        return self._set("setdiff", other)


def tbl(df: DataFrame) -> Table:
    return Table(State(df, tuple(df.columns)))
