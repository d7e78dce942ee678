"""Queries built by calls; the result is the same tree as text gives."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.lang import tree as t
from lodestone.lang.parser import Parser, parse, parse_expression
from lodestone.lang.render import render


class Statement:
    """Variables are numbered from 0 in the order in which they are added."""

    def __init__(self, session):
        self.session = session
        self.vars: list[t.Node] = []
        self.items: list[t.Item] | None = None
        self.root: t.Node | None = None
        self.where: t.Node | None = None
        self.matches: list[t.Match] = []
        self.group: list[t.Order] = []
        self.having: t.Node | None = None
        self.order: list[t.Order] = []
        self.modes: set[str] = set()

    # -- sources

    def add_variable(self, what: str | Statement | None = None, alias: str | None = None, where: str | None = None, ids: list[int] | None = None, path: str | None = None) -> int:
        """A class (with parameters), ``None`` for the whole store, or another statement."""
        if what is None:
            s = t.Source("*", alias)
        elif isinstance(what, Statement):
            s = t.Source(t.Sub(what.tree()), alias)
        else:
            s = Parser(what).source()
            s.alias = alias or s.alias
        if ids is not None:
            s.ids = [t.Lit(i, "pid") for i in ids]
        if path:
            s.path = Parser(path).steps()
        self.vars.append(s)
        if where:
            self.add_condition(where)
        self.root = s if self.root is None else self.root
        return len(self.vars) - 1

    def join(self, a: int, b: int, on: str | None = None, kind: str = "SEMI", using: list[str] | None = None) -> int:
        """Joins two variables; as in the plain API, a semi-join unless told otherwise."""
        j = t.Join(kind.upper(), self.vars[a], self.vars[b], parse_expression(on) if on else None, using)
        self.vars.append(j)
        self.root = j
        return len(self.vars) - 1

    def join_all(self, variables: list[int], on: list[str], kind: str = "INNER") -> int:
        """A chain of joins."""
        at = variables[0]
        for v, c in zip(variables[1:], on, strict=True):
            at = self.join(at, v, c, kind)
        return at

    def set_op(self, a: Statement, b: Statement, op: str, every: bool = False) -> Statement:
        out = Statement(self.session)
        out.root = t.SetOp(op.upper(), every, a.tree(), b.tree())
        return out

    def set_path(self, variable: int, path: str) -> Statement:
        self.vars[variable].path = Parser(path).steps()
        return self

    def set_ids(self, variable: int, ids: list[int]) -> Statement:
        self.vars[variable].ids = [t.Lit(i, "pid") for i in ids]
        return self

    # -- clauses

    def add_output(self, expression: str, alias: str | None = None) -> Statement:
        self.items = [*(self.items or []), t.Item(parse_expression(expression), alias)]
        return self

    def add_condition(self, expression: str) -> Statement:
        c = parse_expression(expression)
        self.where = c if self.where is None else t.Binary("AND", self.where, c)
        return self

    def add_required(self, *props: str) -> Statement:
        """The properties have to be there."""
        for p in props:
            self.add_condition(f"EXISTS({p})")
        return self

    def add_text_condition(self, words: str, *props: str) -> Statement:
        self.matches.append(t.Match(list(props), [t.Lit(words, "string")]))
        return self

    def set_group(self, *keys: str, having: str | None = None) -> Statement:
        self.group = [t.Order(parse_expression(k)) for k in keys]
        self.having = parse_expression(having) if having else None
        return self

    def set_order(self, *keys: str) -> Statement:
        self.order = [o for k in keys for o in Parser(k).order_list()]
        return self

    def set_distinct(self, on: bool = True) -> Statement:
        self.modes = self.modes | {"DISTINCT"} if on else self.modes - {"DISTINCT"}
        return self

    # -- use

    def tree(self) -> t.Node:
        if isinstance(self.root, t.SetOp):
            self.root.order = self.order
            return self.root
        return t.Select(self.items, self.root, self.where, self.matches, self.group, self.having, self.order, self.modes)

    def to_text(self) -> str:
        return render(self.tree())

    @staticmethod
    def from_text(session, text: str) -> Statement:
        out, q = Statement(session), parse(text)[0]
        if isinstance(q, t.SetOp):
            out.root, out.order = q, q.order
            return out
        out.items, out.root, out.where, out.matches, out.group, out.having, out.order, out.modes = q.items, q.source, q.where, q.match, q.group, q.having, q.order, q.modes
        return out

    def execute(self, params: dict | None = None, n_process: int | None = None, n_skip: int | None = None) -> DataFrame:
        with self.session.bound(params or {}):
            return self.session.run(self.tree(), n_process, n_skip)

    def count(self, params: dict | None = None) -> int:
        return self.execute(params).count()

    def exist(self, params: dict | None = None) -> bool:
        return not self.execute(params).isEmpty()

    def analyze(self, params: dict | None = None) -> str:
        with self.session.bound(params or {}):
            return self.session.analyze(self.to_text(), params)

    def is_satisfied(self, row: dict, params: dict | None = None) -> bool:
        return self.where is None or self.session.is_satisfied(render(self.where), row, params)
