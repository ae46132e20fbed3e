"""Functions by name, and the matching of arguments to their formals.

Names are case-insensitive. As in R, all named arguments are bound first; the others then fill the
formals that are left, in order. A formal may have a default; arguments beyond the formals are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from ..errors import ArgumentError, UnsupportedFunction
from ..plans import ast as A

REQUIRED = object()


@dataclass(frozen=True)
class Function:
    name: str
    formals: tuple[str, ...]
    defaults: dict[str, A.Node | None]
    build: Callable  # (scope, *columns or nodes) -> Column
    variadic: bool = False
    window: str = ""  # "": none; "rank": ties if unordered; "position": any order if unordered
    raw: tuple[str, ...] = ()  # formals handed over as syntax, not as columns


FUNCTIONS: dict[str, Function] = {}


def register(*names: str, formals: Sequence[str] = (), variadic: bool = False, window: str = "", raw: Sequence[str] = (), **defaults):
    """Add a function under some names. ``build`` gets the scope and a Column (or None) for each formal."""

    def add(build: Callable) -> Callable:
        for name in names:
            FUNCTIONS[name.lower()] = Function(name, tuple(formals), defaults, build, variadic, window, tuple(raw))
        return build

    return add


def lookup(name: str) -> Function:
    found = FUNCTIONS.get(name.lower())
    if found is None:
        raise UnsupportedFunction(f"unknown function {name!r}")
    return found


def bind(call: A.Call) -> tuple[Function, list[A.Node | None]]:
    """The function of a call and an argument for each of its formals (for a variadic one: the arguments)."""
    f = lookup(call.name)
    named = {x.name.lower(): x.value for x in call.args if isinstance(x, A.Named)}
    if len(named) < sum(isinstance(x, A.Named) for x in call.args):
        raise ArgumentError(f"{call.name}: duplicate argument")
    free = [x for x in call.args if not isinstance(x, A.Named)]
    if f.variadic:
        for n in named:
            if n not in f.formals:
                raise ArgumentError(f"{call.name}: unsupported named argument {n!r}")
        if not free:
            raise ArgumentError(f"{call.name}: at least one argument is needed")
        return f, [*(named.get(n, f.defaults.get(n)) for n in f.formals), *free]
    out: list[A.Node | None] = []
    for n in f.formals:
        if n.lower() in named:
            out.append(named.pop(n.lower()))
        elif free:
            out.append(free.pop(0))
        elif n in f.defaults:
            out.append(f.defaults[n])
        else:
            raise ArgumentError(f"{call.name}: argument {n!r} is missing")
    if named:
        raise ArgumentError(f"{call.name}: unsupported named argument {next(iter(named))!r}")
    if free:
        raise ArgumentError(f"{call.name}: {len(free)} too many arguments")
    return f, out
