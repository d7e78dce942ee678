"""Expressions: syntax tree to Spark SQL text, with the language's own rules for missing values and collections.

The text stays inside Catalyst. Types are known from the schemas of the sources; where a rule depends on a type that is
not known so, Spark's analyser is asked (nothing runs).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import types as T

from lodestone.functions import linalg, text, units
from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem
from lodestone.sources.catalog import Table, Unknown, fresh

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "ARGMIN", "ARGMAX", "VAR_POP", "VAR_SAMP", "STDDEV_POP", "STDDEV_SAMP", "HISTOGRAM"}
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLIP = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_TYPES = {
    "INT": "int", "UINT": "bigint", "INT64": "bigint", "UINT64": "decimal(20,0)", "INTEGER": "int", "BIGINT": "bigint", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "REAL": "float", "BOOL": "boolean", "BOOLEAN": "boolean",
    "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "INTERVAL": "interval day to second", "STRING": "string", "VARCHAR": "string", "TEXT": "string", "BINARY": "binary", "BSTR": "binary", "BYTES": "binary",
    "ENUM": "string", "IDENTITY": "string", "URIID": "string", "REF": "bigint", "PIN": "bigint", "DATE": "date",
}
_SIMPLE = {"EXP": "exp", "SIN": "sin", "COS": "cos", "TAN": "tan", "UPPER": "upper", "LOWER": "lower", "ABS": "abs"}
_BINARY_UDF = {"&": "ls_band", "|": "ls_bor", "^": "ls_bxor"}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def string(s: str) -> str:
    body = s.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\0").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{body}'"


def interval(s: str) -> str:
    """``[-]H[:MM[:SS[.f]]]`` without a limit on hours."""
    m = re.fullmatch(r"\s*(-?)(\d+)(?::(\d+)(?::(\d+(?:\.\d*)?))?)?\s*", s)
    if not m:
        raise SyntaxProblem(f"{s!r} is not an interval")
    sec = (int(m[2]) * 3600 + int(m[3] or 0) * 60) * 1_000_000 + round(float(m[4] or 0) * 1_000_000)
    return f"make_dt_interval(0, 0, 0, CAST({'-' if m[1] else ''}{sec / 1_000_000:.6f} AS DECIMAL(18,6)))"


@dataclass
class X:
    """A compiled expression: its SQL, its type if known, its unit."""

    sql: str
    kind: T.DataType | None = None
    unit: str | None = None

    @property
    def integral(self) -> bool:
        return isinstance(self.kind, _INTS) or isinstance(self.kind, T.DecimalType) and self.kind.scale == 0

    @property
    def array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)


@dataclass
class Rel:
    """A source in scope."""

    alias: str
    schema: T.StructType
    key: str | None = None
    refs: dict[str, str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    name: str | None = None

    def column(self, name: str) -> T.StructField | None:
        low = name.lower()
        if low == "pinid":
            low = "pin_id" if "pin_id" in (f.name.lower() for f in self.schema) else (self.key or "").lower()
        return next((f for f in self.schema if f.name.lower() == low), None)


class Scope:
    """The sources an expression may name; ``extra`` are joins that references in expressions ask for."""

    def __init__(self, session, rels: list[Rel], from_sql: str = "", outer: Scope | None = None, merged: set[str] | None = None):
        self.session, self.rels, self.from_sql, self.outer = session, rels, from_sql, outer
        self.merged = merged or set()
        self.extra: list[str] = []
        self.derefs: dict[tuple[str, str], Rel] = {}
        self.capture: tuple[str, str] | None = None
        self.grouped = False
        self.collective = False
        self.old: str | None = None

    def find(self, parts: list[str]) -> tuple[Rel, T.StructField, list[str]] | None:
        if len(parts) > 1:
            for r in self.rels:
                if r.alias.lower() == parts[0].lower() or (r.name or "").lower() == parts[0].lower():
                    if f := r.column(parts[1]):
                        return r, f, parts[2:]
        hits = [(r, f) for r in self.rels if (f := r.column(parts[0]))]
        if len(hits) > 1 and parts[0].lower() not in self.merged:
            raise Unknown(f"{parts[0]} is in more than one source: " + ", ".join(r.alias for r, _ in hits))
        if hits:
            return (*hits[0], parts[1:])
        return None

    def rel(self, name: str) -> Rel | None:
        return next((r for r in self.rels if r.alias.lower() == name.lower() or (r.name or "").lower() == name.lower()), None)

    def joined(self) -> str:
        return " ".join([self.from_sql, *self.extra])

    def type_of(self, sql: str) -> T.DataType | None:
        memo = self.session.memo
        key = (sql, self.joined())
        if key not in memo:
            source = f" FROM {self.joined()}" if self.from_sql else ""
            try:
                memo[key] = self.session.spark.sql(f"SELECT {sql} AS x{source}").schema[0].dataType
            except (AnalysisException, ParseException):
                memo[key] = None
        return memo[key]

    def deref(self, r: Rel, prop: str) -> Rel:
        """The row that a reference property points to, by an outer join."""
        key = (r.alias, prop.lower())
        if key not in self.derefs:
            target = self.session.catalog.root(r.refs[prop.lower()])
            alias = fresh("r")
            self.extra.append(f"LEFT JOIN {target.view} AS {alias} ON {r.alias}.{quote(prop)} = {alias}.{quote(target.key)}")
            self.derefs[key] = Rel(alias, target.schema, target.key, {k.lower(): v for k, v in target.refs.items()}, target.units, None)
        return self.derefs[key]


class Resolver:
    """Compiles expressions in a scope. ``subquery`` plans a nested query: (query, scope, whether to look at its schema) -> (SQL, schema)."""

    def __init__(self, session, scope: Scope, subquery: Callable):
        self.s, self.scope, self.subquery = session, scope, subquery

    # -- entry points

    def value(self, n: t.Node) -> X:
        method = getattr(self, "_" + type(n).__name__.lower(), None)
        if method is None:
            raise SyntaxProblem(f"{type(n).__name__} can't stand in an expression")
        return method(n)

    def sql(self, n: t.Node) -> str:
        return self.value(n).sql

    def typed(self, n: t.Node) -> X:
        """Like value(), but the type is known if Spark can tell it."""
        x = self.value(n)
        if x.kind is None:
            x.kind = self.scope.type_of(x.sql)
        return x

    def condition(self, n: t.Node) -> str:
        return self.sql(n)

    # -- constants and names

    def _lit(self, n: t.Lit) -> X:
        v = n.value
        if n.kind == "null":
            return X("NULL", T.NullType())
        if n.kind == "bool":
            return X("TRUE" if v else "FALSE", T.BooleanType())
        if n.kind in ("int", "temp"):
            return X(str(v) if -(2**31) <= v < 2**31 else f"{v}L", T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType())
        if n.kind == "pid":
            return X(f"{v}L", T.LongType())
        if n.kind == "float":
            return X(f"{v!r}D", T.DoubleType(), self._unit(n.unit))
        if n.kind == "timestamp":
            return X(f"TIMESTAMP_NTZ {string(v)}", T.TimestampNTZType())
        if n.kind == "interval":
            return X(interval(v), T.DayTimeIntervalType())
        if n.kind == "binary":
            return X(f"X'{v.hex()}'", T.BinaryType())
        return X(string(v), T.StringType())

    def _unit(self, name: str | None) -> str | None:
        if name is not None and name not in units.UNITS:
            raise SyntaxProblem(f"no unit {name}")
        return name

    def _name(self, n: t.Name) -> X:
        scope: Scope | None = self.scope
        while scope is not None:
            if got := scope.find(n.parts):
                return self._walk(scope, *got)
            scope = scope.outer
        if len(n.parts) == 2 and n.parts[0].lower() in self.s.catalog.enums and n.parts[1] in self.s.catalog.enums[n.parts[0].lower()]:
            return X(string(n.parts[1]), T.StringType())
        if n.prefix and n.prefix.lower() in self.s.catalog.enums:
            return X(string(n.parts[0]), T.StringType())
        if len(n.parts) == 1 and n.parts[0].lower() in self.s.catalog.stored:
            return self._stored_call(n.parts[0], [])
        raise Unknown(f"no property {'.'.join(n.parts)}")

    def _walk(self, scope: Scope, r: Rel, f: T.StructField, rest: list[str]) -> X:
        """A property, then fields of structs and maps, or properties of the rows that references point to."""
        if rest and f.name.lower() in r.refs:
            target = scope.deref(r, f.name)
            inner = target.column(rest[0])
            if inner is None:
                raise Unknown(f"no property {rest[0]} behind {f.name}")
            return self._walk(scope, target, inner, rest[1:])
        x = X(f"{r.alias}.{quote(f.name)}", f.dataType, r.units.get(f.name))
        for p in rest:
            if isinstance(x.kind, T.StructType):
                g = next((g for g in x.kind if g.name.lower() == p.lower()), None)
                if g is None:
                    raise Unknown(f"no field {p}")
                x = X(f"{x.sql}.{quote(g.name)}", g.dataType)
            elif isinstance(x.kind, T.MapType):
                x = X(f"try_element_at({x.sql}, {string(p)})", x.kind.valueType)
            elif isinstance(x.kind, T.VariantType):
                x = X(f"try_variant_get({x.sql}, {string('$.' + p)}, 'string')", T.StringType())
            elif x.array and isinstance(x.kind.elementType, T.StructType):
                g = next((g for g in x.kind.elementType if g.name.lower() == p.lower()), None)
                if g is None:
                    raise Unknown(f"no field {p}")
                x = X(f"{x.sql}.{quote(g.name)}", T.ArrayType(g.dataType))
            else:
                raise Unknown(f"{f.name} has no {p}")
        return x

    def _param(self, n: t.Param) -> X:
        bound = self.s.params
        key = n.key if n.key in bound else str(n.key)
        if key not in bound:
            raise Unknown(f"no value for the parameter :{n.key}")
        return self.value(self.s.as_node(bound[key]))

    def _self(self, n: t.Self) -> X:
        r = self.scope.rels[0] if self.scope.rels else None
        if r is None:
            raise Unknown("@ needs a source")
        if r.key is None:
            return X(f"struct({r.alias}.*)", T.StructType(list(r.schema)))
        return X(f"{r.alias}.{quote(r.key)}", r.column(r.key).dataType)

    def _object(self, n: t.Object) -> X:
        if n.name not in self.s.catalog.named:
            raise Unknown(f"no object #{n.name}")
        return self.value(self.s.as_node(self.s.catalog.named[n.name][1]))

    def _regex(self, n: t.Regex) -> X:
        return X(string(("(?i)" if "i" in n.flags else "") + ("(?m)" if "m" in n.flags else "") + n.body), T.StringType())

    def _capture(self, n: t.Capture) -> X:
        if self.scope.capture is None:
            raise SyntaxProblem(f"/{n.n} needs a SIMILAR TO before it")
        return X(f"regexp_extract({self.scope.capture[0]}, {self.scope.capture[1]}, {n.n})", T.StringType())

    # -- arithmetic

    def _unary(self, n: t.Unary) -> X:
        if n.op == "NOT":
            return self._not(n.x)
        x = self.typed(n.x)
        if n.op == "-":
            rank = linalg.rank_of(x.kind) if x.kind else 0
            return X(f"(- {x.sql})" if rank < 1 else linalg.scaled("*", x.sql, "(-1)", rank), x.kind, x.unit)
        if n.op == "&":
            return x
        return X(f"ls_bnot({x.sql})" if isinstance(x.kind, T.BinaryType) else f"(~ {x.sql})", x.kind)

    def _not(self, n: t.Node) -> X:
        """A negated predicate is TRUE where its operands are missing; comparisons turn round."""
        b = T.BooleanType()
        if isinstance(n, t.Binary) and n.op in _FLIP and n.quantifier is None:
            return self._coalesced(X(self._compare(_FLIP[n.op], n.a, n.b), b))
        if isinstance(n, t.Unary) and n.op == "NOT":
            return self.value(n.x)
        if isinstance(n, t.Binary) and n.op in ("AND", "OR"):
            other = "OR" if n.op == "AND" else "AND"
            return X(f"({self._not(n.a).sql} {other} {self._not(n.b).sql})", b)
        if isinstance(n, (t.In, t.Between, t.Is, t.IsA, t.Similar)):
            return self.value(type(n)(**{**n.__dict__, "negated": not n.negated}))
        if isinstance(n, t.Exists):
            return X(f"(NOT {self.sql(n)})", b)
        return self._coalesced(X(f"(NOT {self.sql(n)})", b))

    def _coalesced(self, x: X) -> X:
        return x if self.s.flags["nulls_out"] else X(f"coalesce({x.sql}, TRUE)", x.kind)

    def _binary(self, n: t.Binary) -> X:
        b = T.BooleanType()
        if n.op in ("AND", "OR"):
            return X(f"({self.sql(n.a)} {n.op} {self.sql(n.b)})", b)
        if n.op in _FLIP:
            if n.quantifier:
                return X(self._quantified(n), b)
            sql = self._compare(n.op, n.a, n.b)
            return self._coalesced(X(sql, b)) if n.op == "<>" else X(sql, b)
        a, c = self.typed(n.a), self.typed(n.b)
        for hook in self.s.operators.get(n.op, ()):
            if (got := hook(a, c)) is not None:
                return got if isinstance(got, X) else X(got)
        if n.op == "||":
            return X(f"concat({self._as_string(a)}, {self._as_string(c)})", T.StringType())
        if n.op in ("&", "|", "^"):
            if isinstance(a.kind, T.BinaryType):
                return X(f"{_BINARY_UDF[n.op]}({a.sql}, {c.sql})", a.kind)
            return X(f"({a.sql} {n.op} {c.sql})", self._wider(a, c))
        if n.op in ("<<", ">>", ">>>"):
            if n.op == "<<" and isinstance(a.kind, T.IntegerType):  # the result may need more than 32 bits
                a = X(f"CAST({a.sql} AS BIGINT)", T.LongType())
            left, right = {"<<": ("shiftleft", "shiftright"), ">>": ("shiftright", "shiftleft"), ">>>": ("shiftrightunsigned", "shiftleft")}[n.op]
            if isinstance(n.b, t.Lit):
                return X(f"{left}({a.sql}, {c.sql})" if n.b.value >= 0 else f"{right}({a.sql}, {-n.b.value})", a.kind)
            return X(f"IF({c.sql} >= 0, {left}({a.sql}, {c.sql}), {right}({a.sql}, - {c.sql}))", a.kind)
        return self._arithmetic(n.op, a, c)

    def _wider(self, a: X, b: X) -> T.DataType | None:
        if a.integral and b.integral:
            return T.LongType() if isinstance(a.kind, T.LongType) or isinstance(b.kind, T.LongType) else a.kind
        if isinstance(a.kind, T.NumericType) and isinstance(b.kind, T.NumericType) and not isinstance(a.kind, T.DecimalType) and not isinstance(b.kind, T.DecimalType):
            return T.DoubleType() if T.DoubleType() in (a.kind, b.kind) or not isinstance(b.kind, T.FloatType) or not isinstance(a.kind, T.FloatType) else T.FloatType()
        return None

    def _arithmetic(self, op: str, a: X, b: X) -> X:
        ra, rb = (linalg.rank_of(x.kind) if x.kind is not None else 0 for x in (a, b))
        if ra > 0 or rb > 0:
            return self._algebra(op, a, b, ra, rb)
        unit = None
        if a.unit or b.unit:
            if op in ("+", "-", "%"):
                p, q, unit = units.aligned(a.sql, a.unit, b.sql, b.unit)
                return X(f"({p} {op} {q})", T.DoubleType(), unit)
            sql, unit = units.product(a.sql, a.unit, b.sql, b.unit, op == "/")
            return X(sql, T.DoubleType(), unit)
        if op == "/":
            if a.integral and b.integral:
                return X(f"({a.sql} div {b.sql})", T.LongType())
            return X(f"({a.sql} / {b.sql})", T.DoubleType() if self._wider(a, b) else None)
        return X(f"({a.sql} {op} {b.sql})", self._wider(a, b))

    def _algebra(self, op: str, a: X, b: X, ra: int, rb: int) -> X:
        if op in ("+", "-") and ra == rb:
            return X(linalg.elementwise(op, a.sql, b.sql, ra), a.kind)
        if op == "*":
            if ra == 0:
                return X(linalg.scaled("*", b.sql, a.sql, rb), b.kind)
            if rb == 0:
                return X(linalg.scaled("*", a.sql, b.sql, ra), a.kind)
            kind = {(1, 1): T.DoubleType(), (2, 2): linalg.MATRIX}.get((ra, rb), linalg.VECTOR)
            return X(linalg.multiply(a.sql, ra, b.sql, rb), kind)
        if op == "/" and rb == 0:
            return X(linalg.scaled("/", a.sql, b.sql, ra), None)
        if op == "/" and ra == 2 and rb == 2:  # X with X * b = a
            return X(f"ls_solve(CAST({a.sql} AS ARRAY<ARRAY<DOUBLE>>), CAST({b.sql} AS ARRAY<ARRAY<DOUBLE>>))", linalg.MATRIX)
        raise SyntaxProblem(f"{op} does not go with these shapes")

    # -- predicates

    def _compare(self, op: str, an: t.Node, bn: t.Node) -> str:
        if isinstance(bn, t.Param):
            bound = self.s.params.get(bn.key, self.s.params.get(str(bn.key), bn))
            if bound is None or isinstance(bound, (t.Range, t.Coll)):
                if bound is None:
                    return "TRUE"
                return self._within(an, bound) if op == "=" else f"(NOT {self._within(an, bound)})"
        if isinstance(bn, t.Range) and op in ("=", "<>"):
            inside = self._within(an, bn)
            return inside if op == "=" else f"(NOT {inside})"
        for side, other, turn in ((an, bn, op), (bn, an, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op))):
            if isinstance(side, t.Element) and side.special in ("SOME", "ANY", "ALL"):
                f = "forall" if side.special == "ALL" else "exists"
                return f"{f}({self.sql(side.x)}, e -> e {turn} {self.sql(other)})"
        a, b = self.typed(an), self.typed(bn)
        ci = isinstance(an, t.Call) and isinstance(bn, t.Call) and an.name == bn.name == "UPPER"
        if a.array and not b.array:
            return f"{'exists' if op == '=' else 'forall'}({a.sql}, e -> e {op} {b.sql})"
        if b.array and not a.array:
            return f"{'exists' if op == '=' else 'forall'}({b.sql}, e -> {a.sql} {op} e)"
        if a.unit or b.unit:
            p, q, _ = units.aligned(a.sql, a.unit, b.sql, b.unit)
            return f"({p} {op} {q})"
        if self.s.flags["case_insensitive"] and isinstance(a.kind, T.StringType) and isinstance(b.kind, T.StringType) and not ci:
            return f"(lower({a.sql}) {op} lower({b.sql}))"
        if self.s.flags["numeric_strings"] and isinstance(a.kind, T.StringType) and isinstance(b.kind, T.StringType):
            p, q = (f"try_cast({x} AS DOUBLE)" for x in (a.sql, b.sql))
            return f"coalesce({p} {op} {q}, {a.sql} {op} {b.sql})"
        if isinstance(a.kind, T.TimestampNTZType) and isinstance(b.kind, T.StringType):
            return f"({a.sql} {op} CAST({b.sql} AS TIMESTAMP_NTZ))"
        return f"({a.sql} {op} {b.sql})"

    def _quantified(self, n: t.Binary) -> str:
        every = n.quantifier == "ALL"
        if isinstance(n.b, t.Sub):
            a = self.sql(n.a)
            q, schema = self.subquery(n.b.query, self.scope)
            col = quote(schema[0].name)
            if n.op == "=" and not every:
                return f"({a} IN ({q}))"
            if n.op == "<>" and every:
                return f"(NOT EXISTS (SELECT 1 FROM ({q}) AS q WHERE q.{col} = {a}))"
            low, high = (f"(SELECT {f}({col}) FROM ({q}))" for f in ("min", "max"))
            if n.op == "=":
                return f"coalesce({a} = {low} AND {a} = {high}, TRUE)"
            if n.op == "<>":
                return f"coalesce({a} <> {low} OR {a} <> {high}, FALSE)"
            side = high if (n.op in (">", ">=")) == every else low
            return f"coalesce({a} {n.op} {side}, {'TRUE' if every else 'FALSE'})"
        a, b = self.sql(n.a), self.sql(n.b)
        return f"{'forall' if every else 'exists'}({b}, e -> {a} {n.op} e)"

    def _in(self, n: t.In) -> X:
        b = T.BooleanType()
        if n.negated:
            if isinstance(n.where, t.Sub):  # missing values match nothing, so this is an anti-join
                q, schema = self.subquery(n.where.query, self.scope)
                return X(f"(NOT EXISTS (SELECT 1 FROM ({q}) AS q WHERE q.{quote(schema[0].name)} = {self.sql(n.x)}))", b)
            return self._coalesced(X(f"(NOT {self._within(n.x, n.where)})", b))
        return X(self._within(n.x, n.where), b)

    def _within(self, xn: t.Node, where: t.Node) -> str:
        if isinstance(where, t.Param):
            where = self.s.as_node(self.s.params.get(where.key, self.s.params.get(str(where.key))))
        x = self.typed(xn)
        if isinstance(where, t.Range):
            test = lambda v: " AND ".join([f"{v} {op} {self.sql(e)}" for op, e in ((">=", where.low), ("<=", where.high)) if e is not None] or ["TRUE"])
        elif isinstance(where, t.Sub):
            q, _ = self.subquery(where.query, self.scope)
            test = lambda v: f"{v} IN ({q})"
        elif isinstance(where, (t.Coll, t.ArrayOf)):
            if not where.items:
                return "FALSE"
            parts, plain = [], []
            for item in where.items:
                if isinstance(item, t.Range):
                    parts.append(item)
                else:
                    plain.append(self.sql(item))
            if parts:
                return "(" + " OR ".join([self._within(xn, p) for p in parts] + ([f"{x.sql} IN ({', '.join(plain)})"] if plain else [])) + ")"
            test = lambda v: f"{v} IN ({', '.join(plain)})"
        else:
            y = self.typed(where)
            if x.array and y.array:
                return f"arrays_overlap({x.sql}, {y.sql})"
            if isinstance(y.kind, T.StructType) and {"lo", "hi"} <= {f.name for f in y.kind}:
                return f"({x.sql} >= {y.sql}.lo AND {x.sql} <= {y.sql}.hi)"
            return f"array_contains({y.sql}, {x.sql})" if y.array else f"({x.sql} = {y.sql})"
        return f"exists({x.sql}, e -> {test('e')})" if x.array else f"({test(x.sql)})"

    def _between(self, n: t.Between) -> X:
        return self._in(t.In(n.x, t.Range(n.low, n.high), n.negated))

    def _is(self, n: t.Is) -> X:
        x = self.sql(n.x)
        if n.what == "NULL":
            return X(f"({x} IS {'NOT ' if n.negated else ''}NULL)", T.BooleanType())
        return X(f"({'NOT ' if n.negated else ''}({x} <=> {n.what}))", T.BooleanType())

    def _isa(self, n: t.IsA) -> X:
        r = self._rel_of(n.x)
        sql = " AND ".join(self.member(r, name, args) for name, args in n.classes)
        return X(f"(NOT coalesce({sql}, FALSE))" if n.negated else f"coalesce({sql}, FALSE)", T.BooleanType())

    def _rel_of(self, n: t.Node) -> Rel:
        if isinstance(n, t.Name) and len(n.parts) == 1:
            if r := self.scope.rel(n.parts[0]):
                return r
            if n.parts[0].lower() in ("pinid", "pin_id"):
                return self.scope.rels[0]
        if isinstance(n, t.Self):
            return self.scope.rels[0]
        raise SyntaxProblem("IS A needs a source")

    def member(self, r: Rel, name: str, args: list[t.Node | None] = ()) -> str:
        """The predicate by which a row of ``r`` belongs to a class, with that of its bases."""
        got = self.s.catalog.must(name)
        if isinstance(got, Table):
            return "TRUE" if (r.name or "").lower() == name.lower() else "FALSE"
        if not got.simple:
            raise SyntaxProblem(f"{name} is not a plain predicate")
        inner = Scope(self.s, [r], self.scope.from_sql, self.scope.outer)
        inner.old = self.scope.old
        with self.s.bound(dict(enumerate(args)) if args else {}):
            own = Resolver(self.s, inner, self.subquery).condition(got.query.where) if got.query.where is not None else "TRUE"
        base = "TRUE" if (r.name or "").lower() == got.base.lower() else self.member(r, got.base)
        return own if base == "TRUE" else f"({base} AND {own})"

    def _similar(self, n: t.Similar) -> X:
        x = self.typed(n.x)
        p = self.sql(n.pattern)
        self.scope.capture = (x.sql, p)
        sql = f"exists({x.sql}, e -> e RLIKE {p})" if x.array else f"({x.sql} RLIKE {p})"
        return self._coalesced(X(f"(NOT {sql})", T.BooleanType())) if n.negated else X(sql, T.BooleanType())

    def _exists(self, n: t.Exists) -> X:
        if isinstance(n.what, t.Sub):
            q, _ = self.subquery(n.what.query, self.scope, False)
            return X(f"EXISTS ({q})", T.BooleanType())
        return X(f"({self.sql(n.what)} IS NOT NULL)", T.BooleanType())

    def _sub(self, n: t.Sub) -> X:
        q, schema = self.subquery(n.query, self.scope)
        return X(f"({q})", schema[0].dataType if schema else None)

    # -- construction

    def _coll(self, n: t.Coll) -> X:
        if not n.items:
            return X("array()", T.ArrayType(T.NullType()))
        xs = [self.typed(i) for i in n.items]
        if any(x.array for x in xs):
            return X(f"concat({', '.join(x.sql if x.array else f'array({x.sql})' for x in xs)})", next(x.kind for x in xs if x.array))
        return X(f"array({', '.join(x.sql for x in xs)})", T.ArrayType(self._common(xs)))

    def _common(self, xs: list[X]) -> T.DataType:
        kinds = [x.kind for x in xs if x.kind is not None and not isinstance(x.kind, T.NullType)]
        if not kinds:
            return T.StringType()
        if all(isinstance(k, T.NumericType) for k in kinds):
            return T.DoubleType() if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds) else T.LongType() if T.LongType() in kinds else kinds[0]
        return kinds[0]

    def _struct(self, n: t.Struct) -> X:
        xs = [(k, self.typed(v)) for k, v in n.fields]
        kind = T.StructType([T.StructField(k, x.kind) for k, x in xs]) if all(x.kind is not None for _, x in xs) else None
        return X(f"named_struct({', '.join(f'{string(k)}, {x.sql}' for k, x in xs)})", kind)

    def _mapof(self, n: t.MapOf) -> X:
        return X(f"map({', '.join(f'{self.sql(k)}, {self.sql(v)}' for k, v in n.pairs)})")

    def _arrayof(self, n: t.ArrayOf) -> X:
        xs = [self.typed(i) for i in n.items]
        if any(x.array for x in xs):
            return X(f"array({', '.join(x.sql for x in xs)})", T.ArrayType(xs[0].kind))
        return X(f"array({', '.join(x.sql for x in xs)})", T.ArrayType(self._common(xs)))

    def _range(self, n: t.Range) -> X:
        low, high = ("NULL" if x is None else self.sql(x) for x in (n.low, n.high))
        return X(f"named_struct('lo', {low}, 'hi', {high})")

    def _stored(self, n: t.Stored) -> X:
        return X(string(n.text), T.StringType())

    def _element(self, n: t.Element) -> X:
        x = self.typed(n.x)
        inner = x.kind.elementType if x.array else None
        if n.special:
            at = {"FIRST": 1, "LAST": -1}.get(n.special)
            if at:
                return X(f"try_element_at({x.sql}, {at})", inner) if x.array else x
            if n.special == "CONCAT":
                return X(f"array_join({x.sql}, '')", T.StringType())
            if n.special in AGGREGATES:
                return self._over_collection(n.special, x)
            raise SyntaxProblem(f":{n.special} is no element")
        if isinstance(x.kind, T.MapType):
            return X(f"try_element_at({x.sql}, {self.sql(n.index[0])})", x.kind.valueType)
        sql = x.sql
        for i in n.index:
            sql = f"try_element_at({sql}, {i.value + 1})" if isinstance(i, t.Lit) and i.kind == "int" and i.value >= 0 else f"try_element_at({sql}, CAST({self.sql(i)} AS INT) + 1)"
            inner_now = inner
            inner = inner.elementType if isinstance(inner, T.ArrayType) else None
        return X(sql, inner_now)

    def _pathof(self, n: t.PathOf) -> X:
        raise SyntaxProblem("a path from a constant belongs in FROM")

    # -- conversion

    def _cast(self, n: t.Cast) -> X:
        x = self.typed(n.x)
        up = n.kind.upper()
        base, _, suffix = n.kind.partition(".")
        if base in units.UNITS and (n.kind not in ("INT",)):
            sql = units.convert(f"CAST({x.sql} AS DOUBLE)" if x.unit is None else x.sql, x.unit, base)
            return X(f"CAST({sql} AS FLOAT)" if suffix == "f" else sql, T.FloatType() if suffix == "f" else T.DoubleType(), base)
        if up not in _TYPES:
            if up.lower() in self.s.catalog.enums:
                values = ", ".join(string(v) for v in self.s.catalog.enums[up.lower()])
                return X(f"IF({x.sql} IN ({values}), {x.sql}, NULL)", T.StringType())
            raise SyntaxProblem(f"no type {n.kind}")
        kind = _TYPES[up]
        if kind in ("int", "bigint") and isinstance(x.kind, T.StringType):
            return X(f"CAST({x.sql} AS {kind})", T.IntegerType() if kind == "int" else T.LongType())
        if kind == "interval day to second" and isinstance(n.x, t.Lit):
            return X(interval(n.x.value), T.DayTimeIntervalType())
        simple = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "binary": T.BinaryType()}
        return X(f"CAST({x.sql} AS {kind})", simple.get(kind))

    def _case(self, n: t.Case) -> X:
        whens = []
        first = None
        for c, v in n.whens:
            test = self.sql(c) if n.subject is None else self._compare("=", n.subject, c)
            x = self.value(v)
            first = first or x
            whens.append(f"WHEN {test} THEN {x.sql}")
        other = "" if n.other is None else f" ELSE {self.sql(n.other)}"
        return X(f"CASE {' '.join(whens)}{other} END", first.kind if isinstance(first.kind, T.StringType) else None)

    def _extract(self, n: t.Extract) -> X:
        x = self.sql(n.x)
        out = {
            "FRACTIONAL": f"CAST(EXTRACT(SECOND FROM {x}) * 1000000 AS BIGINT) % 1000000", "SECOND": f"CAST(FLOOR(EXTRACT(SECOND FROM {x})) AS INT)", "MINUTE": f"EXTRACT(MINUTE FROM {x})", "HOUR": f"EXTRACT(HOUR FROM {x})", "DAY": f"EXTRACT(DAY FROM {x})",
            "WDAY": f"(dayofweek({x}) - 1)", "MONTH": f"EXTRACT(MONTH FROM {x})", "YEAR": f"EXTRACT(YEAR FROM {x})", "IDENTITY": f"({x} & 0)", "STOREID": f"shiftrightunsigned({x}, 48)",
        }
        if n.part not in out:
            raise SyntaxProblem(f"EXTRACT has no part {n.part}")
        return X(out[n.part], T.IntegerType())

    def _trim(self, n: t.Trim) -> X:
        x = self.sql(n.x)
        what = self.value(n.what) if n.what is not None else X("' '")
        if isinstance(n.what, t.Lit) and len(n.what.value) != 1:  # whole repeats of a longer text
            body = "".join("\\" + c if not c.isalnum() else c for c in n.what.value)
            sql = x
            if n.side in ("LEADING", "BOTH"):
                sql = f"regexp_replace({sql}, {string(f'^({body})+')}, '')"
            if n.side in ("TRAILING", "BOTH"):
                sql = f"regexp_replace({sql}, {string(f'({body})+$')}, '')"
            return X(sql, T.StringType())
        return X(f"TRIM({n.side} {what.sql} FROM {x})", T.StringType())

    # -- calls

    def _as_string(self, x: X) -> str:
        return x.sql if isinstance(x.kind, T.StringType) else f"CAST({x.sql} AS STRING)"

    def _call(self, n: t.Call) -> X:
        if n.name in AGGREGATES:
            return self._aggregate(n)
        if n.name in _SIMPLE:
            x = self.value(n.args[0])
            if n.name in ("UPPER", "LOWER"):
                return X(f"{_SIMPLE[n.name]}({x.sql})", T.StringType())
            return X(f"{_SIMPLE[n.name]}({x.sql})", x.kind if n.name == "ABS" else T.DoubleType(), x.unit if n.name == "ABS" else None)
        method = getattr(self, "_f_" + n.name.lower(), None)
        if method is not None:
            return method(*n.args)
        if n.name.lower() in self.s.functions:
            name, kind = self.s.functions[n.name.lower()]
            return X(f"{name}({', '.join(self.sql(a) for a in n.args)})", kind)
        if n.name.lower() in self.s.catalog.stored:
            return self._stored_call(n.name, n.args)
        raise Unknown(f"no function {n.name}")

    def _stored_call(self, name: str, args: list[t.Node]) -> X:
        from lodestone.lang.parser import parse_expression

        with self.s.bound(dict(enumerate(args))):
            return self.value(parse_expression(self.s.catalog.stored[name.lower()]))

    def _clean(self, sql: str) -> X:
        """Results outside the domain are missing."""
        return X(f"nullif({sql}, double('NaN'))", T.DoubleType())

    def _f_ln(self, x):
        return X(f"ln({self.sql(x)})", T.DoubleType())

    def _f_sqrt(self, x):
        return self._clean(f"sqrt({self.sql(x)})")

    def _f_asin(self, x):
        return self._clean(f"asin({self.sql(x)})")

    def _f_acos(self, x):
        return self._clean(f"acos({self.sql(x)})")

    def _f_atan(self, x, y=None):
        return X(f"atan({self.sql(x)})" if y is None else f"atan2({self.sql(x)}, {self.sql(y)})", T.DoubleType())

    def _f_power(self, x, y):
        return X(f"pow({self.sql(x)}, {self.sql(y)})", T.DoubleType())

    def _rounded(self, f, n):
        x = self.typed(n)
        return x if x.integral else X(f"CAST({f}({x.sql}) AS DOUBLE)", T.DoubleType(), x.unit)

    def _f_floor(self, x):
        return self._rounded("floor", x)

    def _f_ceil(self, x):
        return self._rounded("ceil", x)

    def _f_setbit(self, x, n):
        a = self.typed(x)
        return X(f"({a.sql} | {self._bit(a, n)})", a.kind)

    def _f_resetbit(self, x, n):
        a = self.typed(x)
        return X(f"({a.sql} & ~ {self._bit(a, n)})", a.kind)

    def _bit(self, a: X, n) -> str:
        return f"shiftleft({'1' if isinstance(a.kind, T.IntegerType) else '1L'}, {self.sql(n)})"

    def _f_testbit(self, x, n):
        return X(f"(getbit({self.sql(x)}, {self.sql(n)}) = 1)", T.BooleanType())

    def _f_bitfield(self, x, shift, size):
        return X(f"(shiftrightunsigned(CAST({self.sql(x)} AS BIGINT), {self.sql(shift)}) & (shiftleft(1L, {self.sql(size)}) - 1))", T.LongType())

    def _f_concat(self, *args):
        xs = [self.typed(a) for a in args]
        if len(xs) == 1 and xs[0].array:
            return X(f"array_join({xs[0].sql}, '')", T.StringType())
        return X(f"concat({', '.join(map(self._as_string, xs))})", T.StringType())

    def _f_length(self, n):
        x = self.typed(n)
        return X(f"octet_length(array_join({x.sql}, ''))" if x.array else f"octet_length({self._as_string(x) if not isinstance(x.kind, T.BinaryType) else x.sql})", T.IntegerType())

    def _f_position(self, s, p):
        a, b = self.sql(s), self.sql(p)  # bytes before the place
        return X(f"IF(locate({b}, {a}) = 0, IF({b} IS NULL OR {a} IS NULL, NULL, -1), octet_length(substring({a}, 1, locate({b}, {a}) - 1)))", T.IntegerType())

    def _f_substr(self, s, start, size=None):
        a = self.sql(s)
        if size is None:
            size, start = start, t.Lit(0, "int")
        n, b = self.sql(size), self.sql(start)
        if isinstance(start, t.Lit) and start.value >= 0:
            return X(f"rpad(substring({a}, {start.value + 1}, {n}), {n}, ' ')", T.StringType())
        return X(f"rpad(concat(repeat(' ', greatest(0, - ({b}))), substring({a}, greatest({b}, 0) + 1, greatest(0, {n} + least({b}, 0)))), {n}, ' ')", T.StringType())

    def _f_replace(self, s, a, b):
        return X(f"replace({self.sql(s)}, {self.sql(a)}, {self.sql(b)})", T.StringType())

    def _f_pad(self, s, n, p=None):
        a, size, fill = self.sql(s), self.sql(n), "' '" if p is None else self.sql(p)
        return X(f"IF(length({a}) < {size}, rpad({a}, {size}, {fill}), {a})", T.StringType())

    def _exists_any(self, f: str, xn, pn) -> X:
        x = self.typed(xn)
        p = self.typed(pn)
        ci = self.s.flags["case_insensitive"]
        one = lambda a, b: f"{f}(lower({a}), lower({b}))" if ci else f"{f}({a}, {b})"
        if p.array:
            return X(f"exists({p.sql}, p -> {one(x.sql, 'p')})", T.BooleanType())
        return X(f"exists({x.sql}, e -> {one('e', p.sql)})" if x.array else one(x.sql, p.sql), T.BooleanType())

    def _f_begins(self, x, p):
        return self._exists_any("startswith", x, p)

    def _f_contains(self, x, p):
        if self.typed(x).array and not isinstance(self.typed(x).kind.elementType, T.StringType):
            return X(f"array_contains({self.sql(x)}, {self.sql(p)})", T.BooleanType())
        return self._exists_any("contains", x, p)

    def _f_ends(self, x, p):
        return self._exists_any("endswith", x, p)

    def _f_hash(self, x):
        a = self.typed(x)
        return X(f"unhex(sha2({a.sql if isinstance(a.kind, (T.StringType, T.BinaryType)) else self._as_string(a)}, 256))", T.BinaryType())

    def _f_tonum(self, n):
        x = self.typed(n)
        if isinstance(x.kind, (T.TimestampType, T.TimestampNTZType)):
            return X(f"unix_micros(CAST({x.sql} AS TIMESTAMP))", T.LongType())
        if isinstance(x.kind, T.BooleanType):
            return X(f"CAST({x.sql} AS INT)", T.IntegerType())
        return X(f"try_cast({x.sql} AS DOUBLE)", T.DoubleType())

    def _f_toinum(self, n):
        x = self._f_tonum(n)
        return x if x.integral else X(f"CAST({x.sql} AS BIGINT)", T.LongType())

    def _f_coalesce(self, *args):
        xs = [self.value(a) for a in args]
        kinds = {x.kind for x in xs}
        return X(f"coalesce({', '.join(x.sql for x in xs)})", xs[0].kind if len(kinds) == 1 else None)

    def _f_current_timestamp(self):
        return X("current_timestamp()", T.TimestampType())

    def _f_current_user(self):
        return X(string(self.s.identity), T.StringType())

    def _f_current_store(self):
        return X(string(self.s.store_name), T.StringType())

    def _f_islocal(self, x):
        return X(f"(shiftrightunsigned(CAST({self.sql(x)} AS BIGINT), 48) = {self.s.store_id})", T.BooleanType())

    def _f_ischanged(self, n):
        if self.scope.old is None:
            raise SyntaxProblem("ISCHANGED belongs in the predicate of a class, where rows change")
        return X(f"(NOT ({self.sql(n)} <=> {self.scope.old}.{quote(n.parts[-1])}))", T.BooleanType())

    def _f_dataevents(self, n):
        r = self._rel_of(n)
        tests = []
        for c in self.s.catalog.classes.values():
            try:
                if c.simple and self.s.catalog.root(c.name).name.lower() == self.s.catalog.root(r.name).name.lower():
                    tests.append(f"IF({self.member(r, c.name)}, {string(c.name)}, NULL)")
            except Unknown:  # a family needs its parameters
                continue
        return X(f"array_compact(array({', '.join(tests)}))" if tests else "CAST(array() AS ARRAY<STRING>)", T.ArrayType(T.StringType()))

    def _f_norm(self, v, p=None):
        return X(linalg.norm(self.sql(v), None if p is None else self.sql(p)), T.DoubleType())

    def _f_trace(self, m):
        return X(linalg.trace(self.sql(m)), T.DoubleType())

    def _f_transpose(self, m):
        x = self.typed(m)
        return X(linalg.transpose(x.sql), x.kind)

    def _f_det(self, m):
        return X(f"ls_det({self._matrix(m)})", T.DoubleType())

    def _f_inv(self, m):
        return X(f"ls_inv({self._matrix(m)})", linalg.MATRIX)

    def _f_rank(self, m):
        return X(f"ls_rank({self._matrix(m)})", T.IntegerType())

    def _matrix(self, m) -> str:
        return f"CAST({self.sql(m)} AS ARRAY<ARRAY<DOUBLE>>)"

    # -- aggregates

    def _aggregate(self, n: t.Call) -> X:
        if n.star:
            return X("count(*)", T.LongType())
        if n.name == "COUNT" and len(n.args) == 2:
            return X(f"size({self.sql(n.args[1])})", T.IntegerType())
        if len(n.args) > 1:
            return self._n_ary(n)
        if isinstance(n.args[0], t.Sub):
            q, schema = self.subquery(n.args[0].query, self.scope)
            arg = "*" if n.name == "COUNT" else quote(schema[0].name)
            return X(f"(SELECT {n.name.lower()}({arg}) FROM ({q}))", T.LongType() if n.name == "COUNT" else None)
        x = self.typed(n.args[0])
        if x.array and not self.scope.grouped:
            return self._over_collection(n.name, x)
        distinct = "DISTINCT " if n.distinct else ""
        if x.array:
            return self._over_flattened(n.name, x)
        kind = {"COUNT": T.LongType(), "AVG": None, "SUM": T.LongType() if x.integral else x.kind, "MIN": x.kind, "MAX": x.kind}.get(n.name, T.DoubleType())
        unit = x.unit if n.name in ("SUM", "AVG", "MIN", "MAX") else None
        if n.name == "AVG" and isinstance(x.kind, (T.TimestampType, T.TimestampNTZType)):
            # Summed as integers: a sum of doubles depends on its order and loses microseconds. Rounded as DuckDB rounds it.
            micros = f"{distinct}CAST(unix_micros(CAST({x.sql} AS TIMESTAMP)) AS DECIMAL(20, 0))"
            mean = f"CAST(sum({micros}) / nullif(count({micros}), 0) AS DOUBLE)"
            return X(f"CAST(timestamp_micros(CAST(round(CAST({mean} AS DECIMAL(38, 3))) AS BIGINT)) AS {'TIMESTAMP_NTZ' if isinstance(x.kind, T.TimestampNTZType) else 'TIMESTAMP'})", x.kind)
        if n.name in ("ARGMIN", "ARGMAX"):
            return X(f"first(__part_{self.s.part(n.name, x.sql)})", T.IntegerType())
        if n.name == "HISTOGRAM":
            return X(f"first(__part_{self.s.part(n.name, x.sql)})")
        return X(f"{n.name.lower()}({distinct}{x.sql})", kind, unit)

    def _n_ary(self, n: t.Call) -> X:
        xs = [self.typed(a) for a in n.args]
        sqls = [x.sql for x in xs]
        joined = ", ".join(sqls)
        if n.name in ("MIN", "MAX"):
            return X(f"{'least' if n.name == 'MIN' else 'greatest'}({joined})", self._common(xs), xs[0].unit)
        if n.name in ("ARGMIN", "ARGMAX"):
            return X(f"CAST(array_position(array({joined}), {'least' if n.name == 'ARGMIN' else 'greatest'}({joined})) - 1 AS INT)", T.IntegerType())
        return self._over_collection(n.name, X(f"array({joined})", T.ArrayType(self._common(xs))))

    def _over_collection(self, name: str, x: X) -> X:
        c, inner = x.sql, x.kind.elementType if x.array else None
        total = f"aggregate({c}, CAST(0 AS DOUBLE), (s, e) -> s + coalesce(e, 0))"
        count = f"size(filter({c}, e -> e IS NOT NULL))"
        mean = f"(aggregate({c}, CAST(0 AS DOUBLE), (s, e) -> s + coalesce(e, 0)) / nullif({count}, 0))"
        squares = f"aggregate(transform(filter({c}, e -> e IS NOT NULL), e -> pow(e - {mean}, 2)), CAST(0 AS DOUBLE), (s, e) -> s + e)"
        if name == "COUNT":
            return X(count, T.IntegerType())
        if name == "SUM":
            if isinstance(inner, _INTS):
                return X(f"aggregate({c}, 0L, (s, e) -> s + coalesce(e, 0))", T.LongType())
            return X(total, T.DoubleType(), x.unit)
        if name == "AVG":
            return X(mean, T.DoubleType(), x.unit)
        if name in ("MIN", "MAX"):
            return X(f"array_{name.lower()}({c})", inner, x.unit)
        if name in ("ARGMIN", "ARGMAX"):
            return X(f"CAST(array_position({c}, array_{name[3:].lower()}({c})) - 1 AS INT)", T.IntegerType())
        if name == "HISTOGRAM":
            return X(f"transform(array_sort(array_distinct({c})), v -> named_struct('value', v, 'count', size(filter({c}, e -> e = v))))")
        spread = f"({squares} / nullif({count}{' - 1' if name.endswith('SAMP') else ''}, 0))"
        return X(f"sqrt({spread})" if name.startswith("STDDEV") else spread, T.DoubleType())

    def _over_flattened(self, name: str, x: X) -> X:
        """Collections inside a group count element by element."""
        one = self._over_collection
        if name == "COUNT":
            return X(f"sum({one('COUNT', x).sql})", T.LongType())
        if name == "SUM":
            return X(f"sum({one('SUM', x).sql})", one("SUM", x).kind)
        if name == "AVG":
            return X(f"(sum({one('SUM', x).sql}) / nullif(sum({one('COUNT', x).sql}), 0))", T.DoubleType())
        if name in ("MIN", "MAX"):
            return X(f"{name.lower()}(array_{name.lower()}({x.sql}))", x.kind.elementType)
        if name == "HISTOGRAM":
            return one("HISTOGRAM", X(f"flatten(collect_list({x.sql}))", x.kind))
        # Moments from sums: n, the sum and the sum of squares of each row.
        n, s = f"sum({one('COUNT', x).sql})", f"sum({one('SUM', x).sql})"
        q = f"sum(aggregate({x.sql}, CAST(0 AS DOUBLE), (a, e) -> a + coalesce(e * e, 0)))"
        spread = f"(({q} - {s} * {s} / nullif({n}, 0)) / nullif({n}{' - 1' if name.endswith('SAMP') else ''}, 0))"
        return X(f"sqrt({spread})" if name.startswith("STDDEV") else spread, T.DoubleType())

    # -- free text

    def match(self, m: t.Match, rels: list[Rel]) -> str:
        """Each string asks for one of its words (or all of them); words match the beginnings of stems. ``"..."`` is a phrase."""
        cols = []
        for r in rels:
            for f in r.schema:
                if isinstance(f.dataType, T.StringType) and (not m.props or f.name.lower() in (p.lower() for p in m.props)):
                    view = self.s.text_indexes.get(((r.name or "").lower(), f.name.lower())) if r.key else None
                    cols.append((f"{r.alias}.{quote(f.name)}", (f"{r.alias}.{quote(r.key)}", view, f.name) if view else None))
        if not cols:
            raise Unknown("MATCH finds no text")
        every = []
        for w in m.words:
            if isinstance(w, t.Param):
                w = self.s.as_node(self.s.params.get(w.key, self.s.params.get(str(w.key))))
            if not isinstance(w, t.Lit) or w.kind != "string":
                raise SyntaxProblem("AGAINST takes strings")
            every.append("(" + " OR ".join(self._text_match(c, w.value, index) for c, index in cols) + ")")
        return " AND ".join(every)

    def _text_match(self, col: str, query: str, index: tuple[str, str, str] | None = None) -> str:
        if index is not None:
            return self._indexed(col, query, *index)
        if m := re.fullmatch(r'\s*"(.*)"\s*', query):
            asked = text.words(m[1])
            inside = "".join(f"contains(lower({col}), {string(w)}) AND " for w in asked)
            return f"({inside}contains(concat(' ', array_join({text.tokens_sql(col)}, ' '), ' '), {string(' ' + ' '.join(asked) + ' ')}))"
        stems = text.stems_of(query, self.s.flags["filter_stop_words"])
        if not stems:
            return "FALSE"
        link = " AND " if self.s.flags["all_words"] else " OR "
        tokens = text.tokens_sql(col)
        # A stem and its word share all but the stem's last letter: that is tested first, in the text and then in its words, without leaving the JVM.
        starts = [string(x[: max(1, len(x) - 1)]) for x in stems]
        inside = link.join(f"contains(lower({col}), {x})" for x in starts)
        some = lambda begins: link.join(f"exists(ws, w -> startswith(w, {x}))" for x in begins)
        rough = f"transform(array({tokens}), ws -> {some(starts)})[0]"
        # Only words that begin so go to Python: of long texts all words together would fill its workers.
        few = f"array_distinct(filter({tokens}, w -> {' OR '.join(f'startswith(w, {x})' for x in starts)}))"
        exact = f"transform(array(ls_stems({few})), ws -> {some(map(string, stems))})[0]"
        return f"(({inside}) AND {rough} AND {exact})"

    def _indexed(self, col: str, query: str, key: str, view: str, prop: str) -> str:
        """The same from the index: keys of the words that begin so. A phrase is looked up by its words and then read."""
        m = re.fullmatch(r'\s*"(.*)"\s*', query)
        stems = text.stems_of(m[1] if m else query, bool(m) or self.s.flags["filter_stop_words"])
        every = bool(m) or self.s.flags["all_words"]
        begins = [f"startswith(w.word, {string(x)})" for x in stems]
        # Words of which one will do are looked up together: one semi-join instead of a mark on each row for each word.
        has = [f"{key} IN (SELECT w.key FROM {view} AS w WHERE w.prop = {string(prop)} AND ({b}))" for b in (begins if every else [" OR ".join(begins)] if begins else [])]
        if m:
            return "(" + " AND ".join([*has, self._text_match(col, query)]) + ")"
        return "(" + " AND ".join(has) + ")" if has else "FALSE"
