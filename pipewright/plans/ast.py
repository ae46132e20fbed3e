"""The syntax tree. All nodes are immutable, so parsed text can be cached."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


class Node:
    def walk(self) -> Iterator[Node]:
        yield self
        for f in fields(self):  # type: ignore[arg-type]
            value = getattr(self, f.name)
            for x in value if isinstance(value, tuple) else (value,):
                if isinstance(x, Node):
                    yield from x.walk()


# ------------------------------------------------------------------ expressions
@dataclass(frozen=True)
class Name(Node):
    text: str


@dataclass(frozen=True)
class Number(Node):
    text: str

    @property
    def value(self) -> int | float:
        x = float(self.text)
        return int(x) if x.is_integer() and abs(x) < 2**63 and "." not in self.text.rstrip("0").rstrip(".") else x


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Flag(Node):
    value: bool


@dataclass(frozen=True)
class Missing(Node):
    pass


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Named(Node):
    """A named argument of a call."""

    name: str
    value: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()


# ------------------------------------------------------------------ verbs
@dataclass(frozen=True)
class Item(Node):
    """``alias = expr`` or just ``expr``."""

    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Key(Node):
    name: str
    descending: bool = False


class Verb(Node):
    pass


@dataclass(frozen=True)
class Select(Verb):
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Filter(Verb):
    condition: Node


@dataclass(frozen=True)
class Mutate(Verb):
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Rename(Verb):
    pairs: tuple[tuple[str, str], ...]  # (new, old)


@dataclass(frozen=True)
class Arrange(Verb):
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class GroupBy(Verb):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Summarise(Verb):
    items: tuple[Item, ...]  # each a Call of an aggregate


@dataclass(frozen=True)
class Join(Verb):
    kind: str  # inner left right full semi anti
    table: str
    keys: tuple[str, ...] = ()
    condition: Node | None = None


@dataclass(frozen=True)
class SetOp(Verb):
    kind: str  # union intersect setdiff
    table: str


@dataclass(frozen=True)
class Pipeline(Node):
    source: str | None
    verbs: tuple[Verb, ...] = ()
    target: str | None = None


VERB_NAMES = {Select: "select", Filter: "filter", Mutate: "mutate", Rename: "rename", Arrange: "arrange", GroupBy: "group_by", Summarise: "summarise"}


def verb_name(verb: Verb) -> str:
    if isinstance(verb, Join):
        return f"{verb.kind}_join"
    return verb.kind if isinstance(verb, SetOp) else VERB_NAMES[type(verb)]
