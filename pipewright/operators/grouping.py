"""group_by and summarise."""

from __future__ import annotations

from ..errors import PlanError
from ..functions import aggregate
from ..plans import ast as A
from ..plans.state import State, column


def group_by(state: State, verb: A.GroupBy) -> State:
    """Groups are a property of the pipeline, not of the rows; the last group_by counts."""
    known = {c.lower(): c for c in state.df.columns}
    for n in verb.names:
        if n.lower() not in known:
            raise PlanError(f"group_by: there is no column {n!r}")
    return state.to(state.df, groups=tuple(known[n.lower()] for n in verb.names))


def summarise(state: State, verb: A.Summarise) -> State:
    """One row for each group, or one in all; the result is not grouped."""
    out = []
    for item in verb.items:
        built, label = aggregate(item.expr, column)
        out.append((built.alias(item.alias or label), item.alias or label))
    keys = [column(g) for g in state.groups]
    if not out:
        if not keys:
            raise PlanError("summarise without groups needs an aggregate")
        df = state.df.select(*keys).distinct()
    else:
        df = (state.df.groupBy(*keys) if keys else state.df).agg(*(b for b, _ in out))
    return state.to(df, [*state.groups, *(n for _, n in out)], groups=())
