"""The six joins. Spark picks the strategy: broadcast by size, sort-merge, AQE for skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..plans import ast as A
from ..plans.state import Scope, State, column, windows_in

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(state: State, verb: A.Join) -> State:
    """Equal keys give one key column, from whichever side has the row. Other names that both sides have get .x and .y.

    Null keys match nothing. The right side's columns get names of their own first, so a table can be
    joined with itself. A condition sees the left side's names first; in a comparison its right operand
    sees the right side's first. Columns that a select left out can still be named, but for those whose
    name the right side has.
    """
    right = state.table(verb.table)
    inner = {c.lower(): f"__r{i}" for i, c in enumerate(right.columns)}
    other = right.select(*(column(c).alias(inner[c.lower()]) for c in right.columns))
    left_names = {c.lower(): c for c in state.df.columns}
    left, keys = state.df, []
    if isinstance(verb.condition, A.Name) and verb.condition.text.lower() in left_names and verb.condition.text.lower() in inner:
        keys = [verb.condition.text]
    elif verb.condition is None:
        keys = list(verb.keys)
    for k in keys:
        if k.lower() not in left_names or k.lower() not in inner:
            raise PlanError(f"join: both sides need a column {k!r}")
    if keys:
        on = reduce(lambda a, b: a & b, (column(left_names[k.lower()]) == column(inner[k.lower()]) for k in keys))
    else:
        on = _condition(verb.condition, left_names, inner, left)
    df = left.join(other, on, HOW[verb.kind])
    if verb.kind in ("semi", "anti"):
        return state.to(df)
    key = {k.lower() for k in keys}
    shown, hidden = [c for c in state.visible], [c for c in state.hidden if c.lower() not in inner]
    shown = [next(left_names[k] for k in key if k == c.lower()) if c.lower() in key else c for c in shown]
    added = [k for k in (left_names[x.lower()] for x in keys) if k not in shown]
    both = {c.lower() for c in shown} & set(inner) - key
    out: list[Column] = []
    names: list[str] = []
    for c in [*added, *shown]:
        if c.lower() in key:
            r = column(inner[c.lower()])
            value = {"right": r, "full": F.coalesce(column(c), r)}.get(verb.kind, column(c))
        else:
            value = column(c)
        names.append(c + ".x" if c.lower() in both else c)
        out.append(value.alias(names[-1]))
    for c in right.columns:
        if c.lower() not in key:
            names.append(c + ".y" if c.lower() in both else c)
            out.append(column(inner[c.lower()]).alias(names[-1]))
    if len({n.lower() for n in names}) < len(names):
        raise PlanError("join: two columns of the result would have one name")
    hidden = [c for c in hidden if c.lower() not in {n.lower() for n in names}]
    return state.to(df.select(*out, *(column(c) for c in hidden)), names, groups=tuple(g + ".x" if g.lower() in both else g for g in state.groups))


def _condition(node: A.Node, left: dict[str, str], right: dict[str, str], df) -> Column:
    if windows_in(node)[0]:
        raise PlanError("join: a condition can't hold a window function")

    def resolver(first: dict, second: dict):
        def resolve(name: str) -> Column:
            found = first.get(name.lower()) or second.get(name.lower())
            if found is None:
                raise PlanError(f"join: neither side has a column {name!r}")
            return column(found)

        return resolve

    def build(x: A.Node) -> Column:
        if isinstance(x, A.Binary) and x.op in ("&", "|"):
            a, b = build(x.left), build(x.right)
            return a & b if x.op == "&" else a | b
        if isinstance(x, A.Binary) and x.op in ("==", "!=", "<", "<=", ">", ">="):
            from ..plans.state import OPERATORS

            return OPERATORS[x.op](Scope(df, resolve=resolver(left, right)).build(x.left), Scope(df, resolve=resolver(right, left) if _ambiguous(x, left, right) else resolver(left, right)).build(x.right))
        return Scope(df, resolve=resolver(left, right)).build(x)

    return build(node)


def _ambiguous(x: A.Binary, left: dict[str, str], right: dict[str, str]) -> bool:
    """Whether a comparison's right operand names a column that both sides have."""
    return any(isinstance(n, A.Name) and n.text.lower() in left and n.text.lower() in right for n in x.right.walk())
