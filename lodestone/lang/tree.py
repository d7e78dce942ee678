"""Nodes of the syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """Any expression or statement."""


@dataclass
class Lit(Node):
    """A constant; ``kind``: int, float, string, bool, null, timestamp, interval, binary, pid."""

    value: object
    kind: str
    unit: str | None = None


@dataclass
class Name(Node):
    """A dotted name; ``prefix`` is that of a qualified name."""

    parts: list[str]
    prefix: str | None = None


@dataclass
class Param(Node):
    key: int | str
    kind: str | None = None
    order: str | None = None
    nulls: str | None = None


@dataclass
class Self(Node):
    """``@`` or one of ``@self @ctx @event @auto @old``."""

    which: str = "self"


@dataclass
class Object(Node):
    name: str


@dataclass
class Unary(Node):
    op: str
    x: Node


@dataclass
class Binary(Node):
    """``quantifier``: ALL, ANY or SOME before the right side."""

    op: str
    a: Node
    b: Node
    quantifier: str | None = None


@dataclass
class In(Node):
    x: Node
    where: Node
    negated: bool = False


@dataclass
class Between(Node):
    x: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass
class Is(Node):
    """``what``: NULL, TRUE or FALSE."""

    x: Node
    what: str
    negated: bool = False


@dataclass
class IsA(Node):
    x: Node
    classes: list[tuple[str, list[Node]]]
    negated: bool = False


@dataclass
class Similar(Node):
    x: Node
    pattern: Node
    negated: bool = False


@dataclass
class Regex(Node):
    body: str
    flags: str = ""


@dataclass
class Capture(Node):
    """``/n``: a group of the regular expression that the row matched."""

    n: int


@dataclass
class Call(Node):
    name: str
    args: list[Node]
    distinct: bool = False
    star: bool = False


@dataclass
class Trim(Node):
    side: str
    what: Node | None
    x: Node


@dataclass
class Extract(Node):
    part: str
    x: Node


@dataclass
class Cast(Node):
    x: Node
    kind: str


@dataclass
class Case(Node):
    subject: Node | None
    whens: list[tuple[Node, Node]]
    other: Node | None


@dataclass
class Exists(Node):
    what: Node


@dataclass
class Sub(Node):
    """A query in parentheses."""

    query: Node


@dataclass
class Coll(Node):
    items: list[Node]


@dataclass
class Struct(Node):
    fields: list[tuple[str, Node]]
    pin: bool = False
    temp: int | None = None


@dataclass
class MapOf(Node):
    pairs: list[tuple[Node, Node]]


@dataclass
class ArrayOf(Node):
    items: list[Node]


@dataclass
class Range(Node):
    low: Node | None
    high: Node | None


@dataclass
class Stored(Node):
    """``$(expression)`` or ``${statements}``, as a value."""

    text: str
    body: object
    statement: bool = False


@dataclass
class Element(Node):
    """``x[i]``, ``x[i,j]`` or ``x[:FIRST]``."""

    x: Node
    index: list[Node]
    special: str | None = None


@dataclass
class Step(Node):
    """A step of a path: properties (``*`` for all), a filter or an element, a repetition [low, high]; ``last``: the filter is for the last node."""

    props: list[str]
    where: Node | None = None
    element: Node | str | None = None
    low: int = 1
    high: int | None = 1
    last: bool = False


@dataclass
class PathOf(Node):
    """A path from the value of an expression."""

    x: Node
    steps: list[Step]


# -- sources ----------------------------------------------------------------------------------------------------


@dataclass
class ClassRef(Node):
    """``cls(args)``; ``None`` as an argument stands for ``*``."""

    name: str
    args: list[Node | None] = field(default_factory=list)


@dataclass
class Source(Node):
    """``what``: a ClassRef list (intersection), ``*``, Sub, Object, or an expression; ``ids``: explicit set of identities."""

    what: object
    alias: str | None = None
    ids: list[Node] | None = None
    path: list[Step] = field(default_factory=list)


@dataclass
class Join(Node):
    kind: str
    a: Node
    b: Node
    on: Node | None = None
    using: list[str] | None = None


@dataclass
class Order(Node):
    x: Node
    desc: bool = False
    nulls: str | None = None


@dataclass
class Item(Node):
    x: Node
    alias: str | None = None


@dataclass
class Match(Node):
    props: list[str]
    words: list[Node]


@dataclass
class Select(Node):
    items: list[Item] | None
    source: Node | None = None
    where: Node | None = None
    match: list[Match] = field(default_factory=list)
    group: list[Order] = field(default_factory=list)
    having: Node | None = None
    order: list[Order] = field(default_factory=list)
    modes: set[str] = field(default_factory=set)


@dataclass
class SetOp(Node):
    op: str
    all: bool
    a: Node
    b: Node
    order: list[Order] = field(default_factory=list)


# -- statements ---------------------------------------------------------------------------------------------------


@dataclass
class With(Node):
    values: list[tuple[str, Node]]
    body: Node


@dataclass
class Insert(Node):
    into: list[tuple[str, str | None]] = field(default_factory=list)
    rows: list[Struct] = field(default_factory=list)
    query: Node | None = None
    options: list[str] = field(default_factory=list)
    part: bool = False
    copy_self: bool = False


@dataclass
class Change(Node):
    """``op``: =, an assignment operator, ADD, ADD BEFORE, DELETE, RENAME, MOVE BEFORE, MOVE AFTER or a function name."""

    op: str
    prop: str
    value: Node | None = None
    element: Node | str | None = None


@dataclass
class Update(Node):
    source: Source
    changes: list[Change]
    where: Node | None = None
    raw: bool = False


@dataclass
class Delete(Node):
    """``kind``: DELETE, PURGE or UNDELETE."""

    kind: str
    source: Source
    where: Node | None = None
    match: list[Match] = field(default_factory=list)


@dataclass
class Create(Node):
    kind: str
    name: str | None
    body: object = None
    extra: dict = field(default_factory=dict)
    props: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Drop(Node):
    kind: str
    name: str


@dataclass
class Transaction(Node):
    """``kind``: START, COMMIT or ROLLBACK."""

    kind: str
    all: bool = False
    read_only: bool = False


@dataclass
class Setting(Node):
    what: str
    name: str | None
    value: object


@dataclass
class Rule(Node):
    name: str
    conditions: list[tuple[str, list[Node]]]
    actions: list[tuple[str, list[Node]]]
