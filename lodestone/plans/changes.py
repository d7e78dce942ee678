"""UPDATE: the changes of a statement as new values of columns."""

from __future__ import annotations

from pyspark.sql import types as T

from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem
from lodestone.plans.resolve import Rel, Resolver, X


def assignments(r: Resolver, rel: Rel, changes: list[t.Change]) -> dict[str, str]:
    """Column -> SQL; a later change of a column sees what an earlier one made of it."""
    now: dict[str, X] = {}

    def current(prop: str) -> X:
        if prop in now:
            return now[prop]
        f = rel.column(prop)
        return X("NULL", T.NullType()) if f is None else X(f"{rel.alias}.`{f.name}`", f.dataType)

    for c in changes:
        f = rel.column(c.prop)
        prop = f.name if f is not None else c.prop
        x = current(prop)
        now[prop] = _change(r, c, x)
        if c.op == "RENAME":
            now[c.value.parts[-1]] = x
    return {k: v.sql for k, v in now.items()}


def _place(r: Resolver, x: X, element) -> str:
    """The 1-based place of an element."""
    if element == "FIRST" or element is None:
        return "1"
    if element == "LAST":
        return f"size({x.sql})"
    return f"({r.sql(element)} + 1)"


def _change(r: Resolver, c: t.Change, x: X) -> X:
    if c.op == "RENAME":
        return X(f"CAST(NULL AS {x.kind.simpleString()})" if not isinstance(x.kind, T.NullType) else "NULL", x.kind)
    if c.op == "DELETE":
        if c.element is None:
            return X(f"CAST(NULL AS {x.kind.simpleString()})", x.kind)
        at = _place(r, x, c.element)
        return X(f"concat(slice({x.sql}, 1, {at} - 1), slice({x.sql}, {at} + 1, size({x.sql})))", x.kind)
    if c.op in ("ADD", "ADD BEFORE"):
        v = r.typed(c.value)
        new = v.sql if v.array else f"array({v.sql})"
        if not x.array:  # a single value is a collection of one
            old = f"IF({x.sql} IS NULL, array(), array({x.sql}))" if not isinstance(x.kind, T.NullType) else None
            return X(new if old is None else f"concat({old}, {new})", T.ArrayType(x.kind))
        old = f"coalesce({x.sql}, array())"
        if c.element is None:
            return X(f"concat({old}, {new})", x.kind)
        at = _place(r, x, c.element)
        before = f"{at} - 1" if c.op == "ADD BEFORE" else at
        return X(f"concat(slice({old}, 1, {before}), {new}, slice({old}, {before} + 1, size({old})))", x.kind)
    if c.op.startswith("MOVE"):
        src, dst = _place(r, x, c.element), _place(r, x, c.value)
        rest = f"concat(slice({x.sql}, 1, {src} - 1), slice({x.sql}, {src} + 1, size({x.sql})))"
        to = f"({dst} - IF({dst} > {src}, 1, 0){' - 1' if c.op.endswith('BEFORE') else ''})"
        return X(f"concat(slice({rest}, 1, {to}), array(element_at({x.sql}, {src})), slice({rest}, {to} + 1, size({x.sql})))", x.kind)
    if c.element is not None:
        at = _place(r, x, c.element)
        value = r.sql(c.value)
        if c.op != "=":
            value = f"element_at({x.sql}, {at}) {c.op} {value}"
        return X(f"transform({x.sql}, (e, i) -> IF(i + 1 = {at}, {value}, e))", x.kind)
    if c.op == "=":
        v = r.value(c.value)
        if x.kind is not None and not isinstance(x.kind, T.NullType) and v.kind != x.kind and isinstance(x.kind, T.NumericType):
            return X(f"CAST({v.sql} AS {x.kind.simpleString()})", x.kind)
        return v
    a, b = x, r.typed(c.value)
    if c.op == "||":
        return X(f"concat({a.sql}, CAST({b.sql} AS STRING))", T.StringType())
    if c.op in ("+", "-", "*", "/", "%"):
        got = r._arithmetic(c.op, a, b)
        return X(f"CAST({got.sql} AS {x.kind.simpleString()})", x.kind) if isinstance(x.kind, T.NumericType) else got
    if c.op in ("&", "|", "^"):
        return X(f"({a.sql} {c.op} {b.sql})", x.kind)
    if c.op in ("<<", ">>", ">>>"):
        f = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[c.op]
        return X(f"{f}({a.sql}, {b.sql})", x.kind)
    raise SyntaxProblem(f"no change {c.op}")
