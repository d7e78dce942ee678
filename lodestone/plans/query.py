"""Queries: syntax tree to one Spark SQL statement, which Catalyst plans as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem
from lodestone.operators import paths
from lodestone.plans.resolve import AGGREGATES, Rel, Resolver, Scope, quote, string
from lodestone.sources.catalog import LISTINGS, ClassDef, Table, Unknown, fresh

_SETS = {"UNION": "UNION", "EXCEPT": "EXCEPT", "INTERSECT": "INTERSECT"}


def walk(n):
    """A node and all nodes below it, but not those of nested queries."""
    if isinstance(n, t.Node):
        yield n
        if isinstance(n, (t.Sub, t.Select)):
            return
        for v in vars(n).values():
            yield from walk(v)
    elif isinstance(n, (list, tuple)):
        for v in n:
            yield from walk(v)


def has_aggregate(n) -> bool:
    return any(isinstance(x, t.Call) and x.name in AGGREGATES and (x.star or len(x.args) == 1) for x in walk(n))


def subst(n, params: dict):
    """A copy of a tree with parameters replaced."""
    if isinstance(n, t.Param) and (n.key in params or str(n.key) in params):
        return params.get(n.key, params.get(str(n.key)))
    if isinstance(n, t.Node):
        return type(n)(**{k: subst(v, params) for k, v in vars(n).items()})
    if isinstance(n, list):
        return [subst(v, params) for v in n]
    if isinstance(n, tuple):
        return tuple(subst(v, params) for v in n)
    return n


class Planner:
    def __init__(self, session):
        self.s = session

    # -- entry points

    def frame(self, q: t.Node, limit: int | None = None, skip: int | None = None) -> DataFrame:
        sql, _ = self.query(q)
        if limit is not None:
            sql += f" LIMIT {int(limit)}"
        if skip:
            sql += f" OFFSET {int(skip)}"
        out = self.s.spark.sql(sql)
        return self._with_units(q, out)

    def _with_units(self, q: t.Node, df: DataFrame) -> DataFrame:
        if not self.s.out_units:
            return df
        found = {c: u for c, u in self.s.out_units.items() if c in df.columns}
        for c, u in found.items():
            df = df.withMetadata(c, {"unit": u})
        return df

    def query(self, q: t.Node, outer: Scope | None = None, schema: bool = True) -> tuple[str, T.StructType | None]:
        """(SQL, schema); the schema is None where it is not wanted."""
        if isinstance(q, t.SetOp):
            sql = self._set(q, outer)
        elif isinstance(q, t.Select):
            sql = self._select(q, outer)
        else:
            raise SyntaxProblem(f"{type(q).__name__} is no query")
        return sql, self._schema(sql) if schema else None

    def _schema(self, sql: str) -> T.StructType:
        if ("schema", sql) not in self.s.memo:
            try:
                self.s.memo["schema", sql] = self.s.spark.sql(sql).schema
            except Exception as e:  # a nested query may name columns of the outer one
                if "UNRESOLVED_COLUMN" not in str(e) and "MISSING_ATTRIBUTES" not in str(e):
                    raise
                self.s.memo["schema", sql] = T.StructType([T.StructField("value", T.NullType())])
        return self.s.memo["schema", sql]

    # -- set operations

    def _set(self, q: t.SetOp, outer: Scope | None) -> str:
        """Rows that are identities (``*`` over tables with a key) are compared by key alone."""
        a, b = self.query(q.a, outer), self.query(q.b, outer)
        key = self._pin_key(q.a), self._pin_key(q.b)
        if key[0] and key[0] == key[1] and not q.all:
            k = quote(key[0])
            left, right = f"({a[0]}) AS a", f"({b[0]}) AS b"
            if q.op == "UNION":
                names = [f.name for f in a[1]]
                firsts = ", ".join(f"first(u.{quote(c)}) AS {quote(c)}" for c in names if c != key[0])
                cols = ", ".join(map(quote, names))
                sql = f"SELECT u.{k}{', ' + firsts if firsts else ''} FROM (SELECT {cols} FROM {left} UNION ALL SELECT {cols} FROM {right}) AS u GROUP BY u.{k}"
                sql = f"SELECT {cols} FROM ({sql})"
            else:
                sql = f"SELECT a.* FROM {left} {'LEFT SEMI' if q.op == 'INTERSECT' else 'LEFT ANTI'} JOIN {right} ON a.{k} = b.{k}"
        else:
            sql = f"({a[0]}) {_SETS[q.op]} {'ALL' if q.all else 'DISTINCT'} ({b[0]})"
            sql = f"SELECT * FROM ({sql})"
        if q.order:
            names = {f.name.lower(): f.name for f in a[1]}
            parts = []
            for o in q.order:
                if not isinstance(o.x, t.Name) or o.x.parts[-1].lower() not in names:
                    raise SyntaxProblem("a set operation is ordered by its columns")
                parts.append(self._order_sql(quote(names[o.x.parts[-1].lower()]), o))
            sql = f"SELECT * FROM ({sql}) ORDER BY {', '.join(parts)}"
        return sql

    def _pin_key(self, q: t.Node) -> str | None:
        if isinstance(q, t.SetOp):
            a = self._pin_key(q.a)
            return a if a and a == self._pin_key(q.b) else None
        if isinstance(q, t.Select) and q.items is None and not q.group and isinstance(q.source, t.Source) and isinstance(q.source.what, list) and not q.source.path:
            return self.s.catalog.root(q.source.what[0].name).key
        return None

    # -- selects

    def _select(self, q: t.Select, outer: Scope | None) -> str:
        """``RAW`` also shows rows that were deleted softly."""
        if "RAW" in q.modes and not self.s.show_deleted:
            self.s.show_deleted = True
            try:
                return self._select(q, outer)
            finally:
                self.s.show_deleted = False
        self.s.out_units = {}
        if q.source is None:
            scope = Scope(self.s, [], "", outer)
            if q.items is None:
                raise SyntaxProblem("SELECT * needs FROM")
        else:
            rels, from_sql, merged = self._from(q.source, outer)
            scope = Scope(self.s, rels, from_sql, outer, merged)
        grouped = bool(q.group) or q.having is not None or any(has_aggregate(i.x) for i in q.items or [])
        r = Resolver(self.s, scope, self.query)
        where = []
        if q.where is not None:
            where.append(r.condition(q.where))
        for m in q.match:
            where.append(r.match(m, scope.rels))
        scope.grouped = grouped
        if self.s.flags["strict_missing"] and (q.group or q.order):
            keys = [o for o in (q.group or q.order) if o.nulls is None]
            if keys and len(keys) == len(q.group or q.order):
                where.append("(" + " OR ".join(f"{r.sql(o.x)} IS NOT NULL" for o in keys) + ")")
        groups = [r.typed(o.x) for o in q.group]
        groups = [x.sql if not x.array else f"try_element_at({x.sql}, 1)" for x in groups]
        items = self._items(q, r, groups)
        names = {n.lower() for _, n in items if n}
        having = r.condition(self._aliased(q.having, q.items)) if q.having is not None else None
        order = []
        for o in q.order:
            if isinstance(o.x, t.Name) and len(o.x.parts) == 1 and o.x.parts[0].lower() in names:
                order.append(self._order_sql(quote(o.x.parts[0]), o))
            elif isinstance(o.x, t.Lit) and o.x.kind == "int":
                order.append(self._order_sql(str(o.x.value), o))
            else:
                x = r.typed(o.x)
                order.append(self._order_sql(x.sql if not x.array else f"try_element_at({x.sql}, 1)", o))
        source = f" FROM {scope.joined()}" if q.source is not None else ""
        cond = f" WHERE {' AND '.join(where)}" if where else ""
        if grouped and self.s.pending_parts:
            return self._with_parts(scope, items, source, cond, groups, having, order)
        head = "SELECT " + ("DISTINCT " if "DISTINCT" in q.modes else "") + ", ".join(f"{x} AS {quote(n)}" if n else x for x, n in items)
        tail = f" GROUP BY {', '.join(groups)}" if groups else ""
        tail += f" HAVING {having}" if having else ""
        tail += f" ORDER BY {', '.join(order)}" if order else ""
        if "FIRST" in q.modes:
            tail += " LIMIT 1"
        return head + source + cond + tail

    def _aliased(self, n, items):
        """HAVING may use the names of the select list."""
        by = {i.alias.lower(): i.x for i in items or [] if i.alias}
        if isinstance(n, t.Name) and len(n.parts) == 1 and n.parts[0].lower() in by:
            return by[n.parts[0].lower()]
        if isinstance(n, (t.Sub, t.Select)) or not isinstance(n, t.Node):
            return [self._aliased(x, items) for x in n] if isinstance(n, list) else n
        return type(n)(**{k: self._aliased(v, items) for k, v in vars(n).items()})

    def _order_sql(self, sql: str, o: t.Order) -> str:
        return f"{sql} {'DESC' if o.desc else 'ASC'} NULLS {o.nulls or 'LAST'}"

    def _items(self, q: t.Select, r: Resolver, groups: list[str]) -> list[tuple[str, str | None]]:
        if q.items is None:
            if q.group:
                return [(g, o.x.parts[-1] if isinstance(o.x, t.Name) else f"col_{i + 1}") for i, (g, o) in enumerate(zip(groups, q.group, strict=True))]
            return [(s, None) for s in self._star(r.scope)]
        out: list[tuple[str, str | None]] = []
        for i, item in enumerate(q.items):
            if isinstance(item.x, t.Self) and item.x.which == "row" and item.alias is None:
                out += [(s, None) for s in self._star(r.scope)]
                continue
            if isinstance(item.x, t.Struct) and item.x.pin:
                out += [(r.sql(v), k) for k, v in item.x.fields]
                continue
            x = r.value(item.x)
            name = item.alias
            if name is None:
                if isinstance(item.x, (t.Name,)):
                    name = item.x.parts[-1]
                    if name.lower() == "pinid":
                        name = "pin_id"
                else:
                    name = "value" if len(q.items) == 1 else f"col_{i + 1}"
            if x.unit:
                self.s.out_units[name] = x.unit
            out.append((x.sql, name))
        return out

    def _star(self, scope: Scope) -> list[str]:
        """All columns; those that USING merged come once, other repeated names get the source's name in front."""
        out, seen = [], set()
        for r in scope.rels:
            for f in r.schema:
                low = f.name.lower()
                if low in seen:
                    if low not in scope.merged:
                        out.append(f"{r.alias}.{quote(f.name)} AS {quote(f'{r.name or r.alias}_{f.name}')}")
                    continue
                seen.add(low)
                if low in scope.merged and len(scope.rels) > 1:
                    both = [f"{x.alias}.{quote(f.name)}" for x in scope.rels if x.column(f.name)]
                    out.append(f"coalesce({', '.join(both)}) AS {quote(f.name)}" if len(both) > 1 else both[0])
                else:
                    out.append(f"{r.alias}.{quote(f.name)}")
        return out

    def _with_parts(self, scope: Scope, items, source, cond, groups, having, order) -> str:
        """Histograms and positions (ARGMIN, ARGMAX) of groups, each by aggregations of its own that are joined by group."""
        wanted, self.s.pending_parts = self.s.pending_parts, []
        keys = [f"k{i}" for i in range(len(groups))]
        k_as = "".join(f"{g} AS {k}, " for g, k in zip(groups, keys, strict=True))
        plain = [(x, n) for x, n in items if "__part_" not in x]
        by = f" GROUP BY {', '.join(groups)}" if groups else ""
        late = having if having and "__part_" in having else None
        cols = ", ".join(f"{x} AS {quote(n)}" for x, n in plain) or "count(*) AS __n"
        base = f"(SELECT {k_as}{cols}{source}{cond}{by}{' HAVING ' + having if having and not late else ''}) AS b"
        for kind, i, x in wanted:
            sql = self._histogram(x, source, cond, groups, keys, k_as) if kind == "HISTOGRAM" else self._position(kind, x, scope, source, cond, keys, k_as)
            on = " AND ".join(f"b.{k} <=> h{i}.{k}" for k in keys) or "TRUE"
            base += f" LEFT JOIN ({sql}) AS h{i} ON {on}"

        def placed(x: str) -> str:
            for _, i, _ in wanted:
                x = x.replace(f"first(__part_{i})", f"h{i}.h")
            return x

        out = [f"{placed(x)} AS {quote(n)}" if "__part_" in x else f"b.{quote(n)}" for x, n in items]
        tail = f" WHERE {placed(late)}" if late else ""
        return f"SELECT {', '.join(out)} FROM {base}{tail}" + (f" ORDER BY {', '.join(map(placed, order))}" if order else "")

    def _histogram(self, x: str, source: str, cond: str, groups: list[str], keys: list[str], k_as: str) -> str:
        """Counts by (group, value) first, so that no group's rows are gathered in one place, only its distinct values."""
        inner = f"SELECT {k_as}{x} AS v, count(*) AS c{source}{cond} GROUP BY {', '.join([*groups, x])}"
        k_list = "".join(f"{k}, " for k in keys)
        hist = f"SELECT {k_list}sort_array(collect_list(named_struct('value', v, 'count', c))) AS h FROM ({inner}) WHERE v IS NOT NULL"
        return hist + (f" GROUP BY {', '.join(keys)}" if keys else "")

    def _position(self, kind: str, x: str, scope: Scope, source: str, cond: str, keys: list[str], k_as: str) -> str:
        """The place of the least (or greatest) value's first row in its group, in order of the source's key, from 0.

        No group is put in order: the extreme is found, then the first key that has it, then the keys before that one are counted.
        """
        if len(scope.rels) > 1:
            raise SyntaxProblem("ARGMIN and ARGMAX in groups take one source")
        r = scope.rels[0]
        key = ", ".join(f"{r.alias}.{quote(f.name)}" for f in ([r.column(r.key)] if r.key else r.schema))
        rows = f"(SELECT {k_as}{x} AS x, struct({key}) AS o{source}{cond})"
        k_list, s_list, by = "".join(f"{k}, " for k in keys), "".join(f"s.{k}, " for k in keys), f" GROUP BY {', '.join(f's.{k}' for k in keys)}" if keys else ""
        on = lambda t_: "".join(f"s.{k} <=> {t_}.{k} AND " for k in keys)
        best = f"SELECT {k_list}{'min' if kind == 'ARGMIN' else 'max'}(x) AS v FROM {rows} AS s{f' GROUP BY {k_list[:-2]}' if keys else ''}"
        first = f"SELECT {s_list}min(s.o) AS w FROM {rows} AS s JOIN ({best}) AS m ON {on('m')}s.x = m.v{by}"
        return f"SELECT {s_list}CAST(count_if(s.o < f.w) AS INT) AS h FROM {rows} AS s JOIN ({first}) AS f ON {on('f')}f.w IS NOT NULL{by or ' HAVING count(*) > 0'}"

    # -- sources

    def _from(self, n: t.Node, outer: Scope | None) -> tuple[list[Rel], str, set[str]]:
        if isinstance(n, t.Source):
            r, sql = self.source(n, outer)
            return [r], sql, set()
        left, lsql, lmerged = self._from(n.a, outer)
        right, rsql, rmerged = self._from(n.b, outer)
        rels, merged = left + right, lmerged | rmerged
        if isinstance(n.b, t.Join):
            rsql = f"({rsql})"
        if n.using:
            conds = []
            for c in n.using:
                a = next((r for r in left if r.column(c)), None)
                b = next((r for r in right if r.column(c)), None)
                if a is None or b is None:
                    raise Unknown(f"USING({c}) needs {c} on both sides")
                conds.append(f"{a.alias}.{quote(a.column(c).name)} = {b.alias}.{quote(b.column(c).name)}")
                merged.add(c.lower())
            on = " AND ".join(conds)
        elif n.on is not None:
            scope = Scope(self.s, rels, f"{lsql} CROSS JOIN {rsql}", outer, merged)
            lsql, rsql, on = self._exploded(n, scope, left, right, lsql, rsql)
            if scope.extra:
                raise SyntaxProblem("ON takes no properties behind references; join their class")
        else:
            on = None
        if n.kind in ("CROSS", "INNER") and on is None:
            return rels, f"{lsql} CROSS JOIN {rsql}", merged
        if on is None:
            raise SyntaxProblem(f"{n.kind} JOIN needs ON or USING")
        kind = {"INNER": "JOIN", "CROSS": "JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN", "FULL": "FULL JOIN", "SEMI": "LEFT SEMI JOIN", "ANTI": "LEFT ANTI JOIN"}[n.kind]
        return (left if n.kind in ("SEMI", "ANTI") else rels), f"{lsql} {kind} {rsql} ON {on}", merged

    def _exploded(self, n: t.Join, scope: Scope, left: list[Rel], right: list[Rel], lsql: str, rsql: str) -> tuple[str, str, str]:
        """An equality of a collection with a value joins each distinct element: the elements become rows of their side, with the element as join key.

        A row meets another at most once so. Where rows without a partner have to stay, or the left side's rows must not multiply,
        the collection is tested as a whole instead.
        """
        r = Resolver(self.s, scope, self.query)
        parts = []
        inner = n.kind in ("INNER", "CROSS")
        for c in self._conjuncts(n.on):
            if isinstance(c, t.Binary) and c.op == "=" and not c.quantifier:
                a, b = r.typed(c.a), r.typed(c.b)
                if a.array != b.array:
                    (coll, node), one = ((a, c.a), b) if a.array else ((b, c.b), a)
                    got = scope.find(node.parts) if isinstance(node, t.Name) else None
                    e = fresh("e")
                    explode = f"LATERAL explode(array_distinct({coll.sql})) AS {e}(k)"
                    if got and got[0] in left and inner:
                        lsql = f"{lsql} JOIN {explode}"
                        parts.append(f"{e}.k = {one.sql}")
                    elif got and got[0] in right and n.kind in ("INNER", "CROSS", "LEFT", "SEMI", "ANTI"):
                        rsql = f"({rsql} JOIN {explode})"
                        parts.append(f"{e}.k = {one.sql}")
                    else:
                        parts.append(f"array_contains({coll.sql}, {one.sql})")
                    continue
            parts.append(r.condition(c))
        return lsql, rsql, " AND ".join(parts)

    def _conjuncts(self, n: t.Node) -> list[t.Node]:
        if isinstance(n, t.Binary) and n.op == "AND":
            return self._conjuncts(n.a) + self._conjuncts(n.b)
        return [n]

    def source(self, n: t.Source, outer: Scope | None = None) -> tuple[Rel, str]:
        r, body = self._base(n, outer)
        alias = n.alias or r.name or r.alias
        alias = alias if alias.replace("_", "a").isalnum() and not alias[0].isdigit() else r.alias
        if n.ids is not None:
            if r.key is None:
                raise Unknown(f"{r.name} has no identities")
            ids = Resolver(self.s, Scope(self.s, [], ""), self.query)
            body = f"(SELECT * FROM {body} WHERE {quote(r.key)} IN ({', '.join(ids.sql(i) for i in n.ids)}))"
        r = Rel(alias, r.schema, r.key, r.refs, r.units, r.name)
        if n.path:
            r, body = paths.expand(self, r, body, n.path, outer)
            r = Rel(n.alias or r.alias, r.schema, r.key, r.refs, r.units, r.name)
        return r, f"{body} AS {r.alias}"

    def _base(self, n: t.Source, outer: Scope | None) -> tuple[Rel, str]:
        what = n.what
        if what == "*":
            return self._whole_store()
        if isinstance(what, t.Sub):
            sql, schema = self.query(what.query, outer)
            return Rel(n.alias or fresh("q"), schema, self._pin_key(what.query)), f"({sql})"
        if isinstance(what, list):
            return self._classes(what, outer)
        if isinstance(what, t.Object):
            if what.name not in self.s.catalog.named:
                raise Unknown(f"no object #{what.name}")
            cls, key = self.s.catalog.named[what.name]
            r, body = self._class(t.ClassRef(cls), outer)
            return r, f"(SELECT * FROM {body} WHERE {quote(r.key)} = {Resolver(self.s, Scope(self.s, []), self.query).sql(self.s.as_node(key))})"
        return self._values(what, outer)

    def _whole_store(self) -> tuple[Rel, str]:
        """All declared tables as one: columns of equal names and types share a column."""
        view, schema = self.s.whole_store()
        return Rel("store", schema, "pin_id", name="store"), view

    def _classes(self, refs: list[t.ClassRef], outer: Scope | None) -> tuple[Rel, str]:
        r, body = self._class(refs[0], outer)
        for other in refs[1:]:
            root = self.s.catalog.root(other.name)
            got = self.s.catalog.must(other.name)
            if isinstance(got, ClassDef) and got.simple and root.name.lower() == self.s.catalog.root(refs[0].name).name.lower():
                # Both are predicates over one table: no join.
                inner = Rel("x", r.schema, r.key, r.refs, r.units, root.name)
                cond = Resolver(self.s, Scope(self.s, [inner], f"{body} AS x"), self.query).member(inner, other.name, other.args)
                body = f"(SELECT x.* FROM {body} AS x WHERE {cond})"
                continue
            o, obody = self._class(other, outer)
            body = f"(SELECT x.* FROM {body} AS x LEFT SEMI JOIN {obody} AS y ON x.{quote(r.key)} = y.{quote(o.key)})"
        return r, body

    def _class(self, ref: t.ClassRef, outer: Scope | None) -> tuple[Rel, str]:
        name = ref.name
        if name.upper() in LISTINGS and self.s.catalog.table(name) is None and self.s.catalog.get_class(name) is None:
            df = self.s.catalog.listing(name)
            view = fresh("v")
            df.createOrReplaceTempView(view)
            return Rel(name, df.schema, None, name=name), view
        if any(name.lower() in self.s.catalog.others.get(k, ()) for k in ("COMMUNICATION", "PIPELINE", "LISTENER")):
            from lodestone.sources import services

            df, view = services.read(self.s, name), fresh("v")
            df.createOrReplaceTempView(view)
            return Rel(name, df.schema, None, name=name), view
        got = self.s.catalog.must(name)
        if isinstance(got, Table):
            r = Rel(name, got.schema, got.key, {k.lower(): v for k, v in got.refs.items()}, got.units, got.name)
            view = f"({self.s.guard(got)})" if self.s.guard(got) else got.view
            if ref.args:
                raise SyntaxProblem(f"{name} takes no parameters")
            return r, view
        q = got.query
        if ref.args:
            q = subst(q, {i: (t.Param("__any") if a is None else a) for i, a in enumerate(ref.args)})
        with self.s.bound({"__any": None}):
            sql, schema = self.query(q, outer)
            if got.window is not None:
                sql = self._windowed(got, sql, schema)
        try:
            root = self.s.catalog.root(name)
            key, refs, un, rname = root.key, {k.lower(): v for k, v in root.refs.items()}, root.units, root.name
        except Unknown:
            key, refs, un, rname = None, {}, {}, name
        return Rel(name, schema, key if key and any(f.name == key for f in schema) else None, refs, un, rname if got.simple else name), f"({sql})"

    def _windowed(self, c: ClassDef, sql: str, schema: T.StructType) -> str:
        """The members that the class's window leaves: the last n, or those within an interval of the newest (or of now, if it is negative).

        Order is that of the first ORDER BY property, else of creation, else of the key.
        """
        names = {f.name.lower(): f.name for f in schema}
        key = c.query.order[0].x.parts[-1].lower() if c.query.order else "created" if "created" in names else (self.s.catalog.root(c.name).key or "").lower()
        if key not in names:
            raise SyntaxProblem(f"the window of {c.name} needs an order")
        col = quote(names[key])
        if isinstance(c.window, int):
            return f"SELECT * FROM ({sql}) ORDER BY {col} DESC NULLS LAST LIMIT {c.window}"
        span = Resolver(self.s, Scope(self.s, []), self.query).sql(c.window)
        negative = isinstance(c.window, t.Lit) and str(c.window.value).lstrip().startswith("-")
        newest = f"CAST(current_timestamp() AS TIMESTAMP_NTZ) + {span}" if negative else f"(SELECT max({col}) FROM ({sql})) - {span}"
        return f"SELECT * FROM ({sql}) WHERE {col} >= {newest}"

    def _values(self, n: t.Node, outer: Scope | None) -> tuple[Rel, str]:
        """Rows from a value: a range of integers, identities, structs, or any collection, whose rows have one column ``value``."""
        if isinstance(n, t.Param):
            n = self.s.as_node(self.s.params.get(n.key, self.s.params.get(str(n.key))))
        r = Resolver(self.s, Scope(self.s, [], "", outer), self.query)
        if isinstance(n, t.Range):
            if n.low is None or n.high is None:
                raise SyntaxProblem("rows from a range need both ends")
            return self._made(f"SELECT id AS value FROM range({r.sql(n.low)}, {r.sql(n.high)} + 1)")
        items = n.items if isinstance(n, (t.Coll, t.ArrayOf)) else [n]
        if items and all(isinstance(i, t.Lit) and i.kind == "pid" for i in items):
            rel, body = self._whole_store()
            return rel, f"(SELECT * FROM {body} WHERE pin_id IN ({', '.join(r.sql(i) for i in items)}))"
        if items and all(isinstance(i, t.Struct) for i in items):
            names = list(dict.fromkeys(k for i in items for k, _ in i.fields))
            rows = [", ".join(f"{r.sql(dict(i.fields)[k]) if k in dict(i.fields) else 'NULL'} AS {quote(k)}" for k in names) for i in items]
            return self._made(" UNION ALL ".join(f"SELECT {x}" for x in rows))
        return self._made(f"SELECT explode({r.sql(n if isinstance(n, (t.Coll, t.ArrayOf)) else t.Coll([n]))}) AS value")

    def _made(self, sql: str) -> tuple[Rel, str]:
        return Rel(fresh("v"), self._schema(sql)), f"({sql})"


__all__ = ["Planner", "string", "walk", "has_aggregate", "subst"]
