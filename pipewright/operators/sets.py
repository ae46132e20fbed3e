"""union, intersect, setdiff: by position, without duplicates."""

from __future__ import annotations

from ..errors import PlanError
from ..plans import ast as A
from ..plans.state import State


def set_op(state: State, verb: A.SetOp) -> State:
    left, right = state.result(), state.table(verb.table)
    if len(left.columns) != len(right.columns):
        raise PlanError(f"{verb.kind}: {len(left.columns)} columns on the left, {len(right.columns)} on the right")
    for a, b in zip(left.schema, right.schema, strict=True):
        numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        x, y = a.dataType.simpleString(), b.dataType.simpleString()
        if x != y and not ({x, y} <= numbers or all(t.startswith("decimal") or t in numbers for t in (x, y))):
            raise PlanError(f"{verb.kind}: {a.name} is {x} and {b.name} is {y}", hint="Cast one of them")
    right = right.toDF(*left.columns)
    df = left.union(right).distinct() if verb.kind == "union" else left.intersect(right) if verb.kind == "intersect" else left.subtract(right)
    return state.to(df, left.columns, groups=tuple(g for g in state.groups if g in left.columns))
