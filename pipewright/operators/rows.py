"""select, filter, mutate, rename, arrange."""

from __future__ import annotations

from ..errors import PlanError
from ..plans import ast as A
from ..plans.state import ARRIVAL, Scope, State, column, windows_in, with_arrival


def _label(node: A.Node) -> str:
    """The name of a selected expression without one."""
    if isinstance(node, A.Name):
        return node.text
    from ..emit import spark_expression

    return spark_expression(node)


def _has(names, name: str) -> str | None:
    return next((n for n in names if n.lower() == name.lower()), None)


def select(state: State, verb: A.Select) -> State:
    """Later verbs may still name what a select leaves out, as WHERE may name what SELECT doesn't."""
    if not verb.items:
        return state
    dropped = [i.expr.operand.text for i in verb.items if isinstance(i.expr, A.Unary) and i.expr.op == "-" and isinstance(i.expr.operand, A.Name) and i.alias is None]
    if dropped:
        if len(dropped) < len(verb.items):
            raise PlanError("select either names columns or leaves some out")
        return state.to(state.df, [c for c in state.visible if not _has(dropped, c)])
    df = with_arrival(state.df, any(windows_in(i.expr)[1] for i in verb.items))
    scope = Scope(df)
    new = {}
    for item in verb.items:
        name = item.alias or _label(item.expr)
        if _has(new, name):
            raise PlanError(f"select names {name!r} twice")
        new[name] = scope.build(item.expr).alias(name)
    kept = [c for c in state.df.columns if not _has(new, c)]
    plain = all(isinstance(i.expr, A.Name) and i.alias in (None, i.expr.text) for i in verb.items)
    if plain and all(_has(df.columns, n) for n in new):
        return state.to(state.df, [_has(df.columns, n) for n in new])
    return state.to(df.select(*new.values(), *(column(c) for c in kept)), list(new))


def filter_(state: State, verb: A.Filter) -> State:
    """A window function in the condition is computed within the groups first."""
    any_, unordered = windows_in(verb.condition)
    if not any_:
        return state.to(state.df.filter(Scope(state.df).build(verb.condition)))
    df = with_arrival(state.df, unordered)
    df = df.withColumn("__keep", Scope(df, state.groups).build(verb.condition)).filter("__keep").drop("__keep", ARRIVAL)
    return state.to(df)


def mutate(state: State, verb: A.Mutate) -> State:
    """Assignments in turn: each may use those before it; an existing column is replaced where it stands.

    Assignments that don't name each other go into one projection, so a long mutate stays a flat plan.
    """
    df, visible = state.df, list(state.visible)
    layer: dict[str, A.Node] = {}

    def flush():
        nonlocal df
        if layer:
            needs = any(windows_in(x)[1] for x in layer.values())
            df = with_arrival(df, needs)
            scope = Scope(df, state.groups)
            df = df.withColumns({n: scope.build(x) for n, x in layer.items()}).drop(ARRIVAL)
            layer.clear()

    for item in verb.items:
        used = {x.text.lower() for x in item.expr.walk() if isinstance(x, A.Name)}
        names = {n.lower() for n in layer}
        groups = {g.lower() for g in state.groups}
        if used & names or item.alias.lower() in names or (names & groups and windows_in(item.expr)[0]):
            flush()
        target = _has(df.columns, item.alias) or item.alias
        layer[target] = item.expr
        if not _has(visible, target):
            visible.append(target)
    flush()
    return state.to(df, visible)


def rename(state: State, verb: A.Rename) -> State:
    old = {}
    for new, name in verb.pairs:
        found = _has(state.visible, name)
        if found is None:
            raise PlanError(f"rename: there is no column {name!r}")
        old[found] = new
    visible = [old.get(c, c) for c in state.visible]
    if len({v.lower() for v in visible}) < len(visible):
        raise PlanError("rename: two columns would have one name")
    hidden = [c for c in state.hidden if c not in old and not _has(visible, c)]
    shown = [c for c in state.df.columns if _has(state.visible, c)]
    df = state.df.select(*(column(c).alias(old.get(c, c)) for c in shown), *(column(c) for c in hidden))
    return state.to(df, visible, groups=tuple(old.get(g, g) for g in state.groups))


def arrange(state: State, verb: A.Arrange) -> State:
    if not verb.keys:
        return state
    return state.to(state.df.orderBy(*(column(k.name).desc_nulls_last() if k.descending else column(k.name).asc_nulls_last() for k in verb.keys)))
