"""Syntax tree to text that parses to the same tree."""

from __future__ import annotations

from lodestone.lang import tree as t


def _s(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"


def _name(x: str | t.Name) -> str:
    """An identifier, quoted where it must be; also renders Name nodes."""
    if isinstance(x, t.Name):
        return (x.prefix + ":" if x.prefix else "") + ".".join(map(_name, x.parts))
    plain = x.isidentifier() and x.isascii()
    return x if plain else '"' + x.replace('"', '""') + '"'


def _list(xs) -> str:
    return ", ".join(map(render, xs))


def _value(v) -> str:
    return "*" if v is None else render(v)


def render(n: t.Node) -> str:
    return globals()["_" + type(n).__name__.lower()](n)


def _lit(n):
    if n.kind == "null":
        return "NULL"
    if n.kind == "bool":
        return "TRUE" if n.value else "FALSE"
    if n.kind == "string":
        return _s(n.value)
    if n.kind in ("timestamp", "interval"):
        return f"{n.kind.upper()} {_s(n.value)}"
    if n.kind == "binary":
        return f"X'{n.value.hex()}'"
    if n.kind == "pid":
        return f"@{n.value:X}" + (f"!{n.unit}" if n.unit else "")
    if n.kind == "temp":
        return f"@:{n.value}"
    return f"{n.value!r}{n.unit or ''}"


def _param(n):
    kind = "".join([n.kind or "", f",{n.order}" if n.order else "", f",NULLS {n.nulls}" if n.nulls else ""])
    return f":{n.key}" + (f"({kind})" if kind else "")


def _self(n):
    return "@" if n.which == "row" else "@" + n.which


def _object(n):
    return "#" + n.name


def _unary(n):
    return f"(NOT {render(n.x)})" if n.op == "NOT" else f"({n.op}{render(n.x)})"


def _binary(n):
    if n.quantifier:
        inner = render(n.b)
        return f"({render(n.a)} {n.op} {n.quantifier}{inner if inner.startswith('(') else f'({inner})'})"
    return f"({render(n.a)} {n.op} {render(n.b)})"


def _in(n):
    where = n.where
    return f"({render(n.x)} {'NOT ' if n.negated else ''}IN {render(where)})"


def _between(n):
    return f"({render(n.x)} {'NOT ' if n.negated else ''}BETWEEN {render(n.low)} AND {render(n.high)})"


def _is(n):
    return f"({render(n.x)} IS {'NOT ' if n.negated else ''}{n.what})"


def _isa(n):
    return f"({render(n.x)} IS {'NOT ' if n.negated else ''}A {' & '.join(_ref(c, a) for c, a in n.classes)})"


def _ref(name, args):
    return _name(name) + (f"({', '.join(map(_value, args))})" if args else "")


def _similar(n):
    return f"({render(n.x)} {'NOT ' if n.negated else ''}SIMILAR TO {render(n.pattern)})"


def _regex(n):
    return f"/{n.body}/{n.flags}"


def _capture(n):
    return f"/{n.n}"


def _call(n):
    if n.star:
        return f"{n.name}(*)"
    return f"{n.name}({'DISTINCT ' if n.distinct else ''}{', '.join(render(a)[1:-1] if isinstance(a, t.Sub) else render(a) for a in n.args)})"


def _trim(n):
    return f"TRIM({n.side} {'' if n.what is None else render(n.what) + ' '}FROM {render(n.x)})"


def _extract(n):
    return f"EXTRACT({n.part} FROM {render(n.x)})"


def _cast(n):
    return f"CAST({render(n.x)} AS {n.kind})"


def _case(n):
    parts = ["CASE"] + ([render(n.subject)] if n.subject is not None else [])
    parts += [f"WHEN {render(c)} THEN {render(v)}" for c, v in n.whens]
    parts += [f"ELSE {render(n.other)}"] if n.other is not None else []
    return " ".join([*parts, "END"])


def _exists(n):
    x = render(n.what)
    return f"EXISTS{x}" if isinstance(n.what, t.Sub) else f"EXISTS({x})"


def _sub(n):
    return f"({render(n.query)})"


def _coll(n):
    return "{" + _list(n.items) + "}"


def _struct(n):
    temp = f"@:{n.temp} " if n.temp is not None else ""
    return temp + ("@{" if n.pin else "{") + ", ".join(f"{_name(k)} = {render(v)}" for k, v in n.fields) + "}"


def _mapof(n):
    return "{" + ", ".join(f"{render(k)} -> {render(v)}" for k, v in n.pairs) + "}"


def _arrayof(n):
    return "[" + _list(n.items) + "]"


def _range(n):
    return f"@[{_value(n.low)}, {_value(n.high)}]"


def _stored(n):
    return ("${" if n.statement else "$(") + n.text + ("}" if n.statement else ")")


def _element(n):
    return f"{render(n.x)}[{':' + n.special if n.special else _list(n.index)}]"


def _step(n):
    out = "." + ("*" if n.props == ["*"] else _name(n.props[0]) if len(n.props) == 1 else "{" + ", ".join(map(_name, n.props)) + "}")
    rep = {(1, 1): "", (0, 1): "{?}", (1, None): "{+}", (0, None): "{*}"}.get((n.low, n.high))
    rep = rep if rep is not None else f"{{{n.low}}}" if n.low == n.high else f"{{{n.low}, {'*' if n.high is None else n.high}}}"
    if n.element is not None:
        return out + f"[{':' + n.element if isinstance(n.element, str) else render(n.element)}]" + rep
    if n.where is not None:
        return out + (f"{rep}[{render(n.where)}]" if n.last else f"[{render(n.where)}]{rep}")
    return out + rep


def _pathof(n):
    return render(n.x) + "".join(map(render, n.steps))


def _classref(n):
    return _ref(n.name, n.args)


def _source(n):
    what = n.what
    out = "*" if what == "*" else " & ".join(map(render, what)) if isinstance(what, list) else render(what)
    if n.ids:
        out += " {" + _list(n.ids) + "}"
    return out + "".join(map(render, n.path)) + (f" AS {_name(n.alias)}" if n.alias else "")


def _join(n):
    b = render(n.b)
    if isinstance(n.b, t.Join):
        b = f"({b})"
    out = f"{render(n.a)} {n.kind} JOIN {b}"
    if n.using:
        return out + f" USING ({', '.join(map(_name, n.using))})"
    return out + (f" ON {render(n.on)}" if n.on is not None else "")


def _order(n):
    return render(n.x) + (" DESC" if n.desc else "") + (f" NULLS {n.nulls}" if n.nulls else "")


def _item(n):
    return render(n.x) + (f" AS {_name(n.alias)}" if n.alias else "")


def _match(n):
    return "MATCH " + (f"({', '.join(map(_name, n.props))}) " if n.props else "") + f"AGAINST ({_list(n.words)})"


def _select(n):
    out = "SELECT " + "".join(m + " " for m in ("ALL", "DISTINCT", "RAW", "FIRST") if m in n.modes)
    out += "*" if n.items is None and not n.group else "" if n.items is None else _list(n.items)
    out += f" FROM {render(n.source)}" if n.source is not None else ""
    out += f" WHERE {render(n.where)}" if n.where is not None else ""
    out += "".join(" " + render(m) for m in n.match)
    out += f" GROUP BY {_list(n.group)}" if n.group else ""
    out += f" HAVING {render(n.having)}" if n.having is not None else ""
    return out + (f" ORDER BY {_list(n.order)}" if n.order else "")


def _setop(n):
    return f"({render(n.a)}) {n.op} {'ALL ' if n.all else ''}({render(n.b)})" + (f" ORDER BY {_list(n.order)}" if n.order else "")


def _with(n):
    return f"WITH {', '.join(f'{k} = {render(v)}' for k, v in n.values)} {render(n.body)}"


def _insert(n):
    out = "INSERT " + ("PART " if n.part else "")
    out += "INTO " + ", ".join(_name(c) + (f" {m}" if m else "") for c, m in n.into) + " " if n.into else ""
    out += f"OPTIONS ({', '.join(n.options)}) " if n.options else ""
    out += "@self, " if n.copy_self else ""
    return out + (_list(n.rows) if n.rows else "") + (render(n.query) if n.query is not None else "")


def _change(n):
    at = "" if n.element is None else f"[{'BEFORE ' if n.op == 'ADD BEFORE' else ''}{':' + n.element if isinstance(n.element, str) else render(n.element)}]"
    if n.op in ("ADD", "ADD BEFORE"):
        return f"ADD {_name(n.prop)}{at} = {render(n.value)}"
    if n.op == "DELETE":
        return f"DELETE {_name(n.prop)}{at}"
    if n.op == "RENAME":
        return f"RENAME {_name(n.prop)} = {render(n.value)}"
    if n.op.startswith("MOVE"):
        return f"MOVE {_name(n.prop)}{at} {n.op[5:]} {render(n.value)}"
    return f"SET {_name(n.prop)}{at} {n.op if n.op == '=' else n.op + '='} {render(n.value)}"


def _update(n):
    return f"UPDATE {'RAW ' if n.raw else ''}{render(n.source)} {' '.join(map(render, n.changes))}" + (f" WHERE {render(n.where)}" if n.where is not None else "")


def _delete(n):
    if n.source.what == "*" and n.source.ids:
        return f"{n.kind} {{{_list(n.source.ids)}}}"
    return f"{n.kind} FROM {render(n.source)}" + (f" WHERE {render(n.where)}" if n.where is not None else "") + "".join(" " + render(m) for m in n.match)


def _drop(n):
    return f"DROP {n.kind} {_name(n.name)}"


def _transaction(n):
    if n.kind == "START":
        return "START TRANSACTION" + (" READ ONLY" if n.read_only else "")
    return n.kind + (" ALL" if n.all else "")
