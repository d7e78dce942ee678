"""Class events: which rows enter, stay in or leave a class when rows change, and what that sets off.

Membership of all classes is one projection: a boolean column for each class. Actions are statements over sets of rows:
``@self`` stands for each row that met the event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.lang import tree as t
from lodestone.plans.resolve import Rel, Resolver, Scope, quote
from lodestone.sources.catalog import ClassDef, Unknown, fresh

KINDS = ("enter", "update", "leave")


def relevant(session, table: str) -> list[ClassDef]:
    """The plain classes over a table; families have no members of their own."""
    out = []
    for c in session.catalog.classes.values():
        try:
            if c.simple and session.catalog.root(c.name).name.lower() == table.lower():
                out.append(c)
        except Unknown:
            continue
    return out


def membership(session, table: str, df: DataFrame, classes: list[ClassDef], old: DataFrame | None = None) -> DataFrame:
    """``df`` with a boolean column ``in_<class>`` for each class."""
    view = fresh("m")
    df.createOrReplaceTempView(view)
    rel = Rel("x", df.schema, "pin_id" if "pin_id" in df.columns else None, {}, {}, table)
    scope = Scope(session, [rel], f"{view} AS x")
    source = f"{view} AS x"
    if old is not None:
        oview = fresh("m")
        old.createOrReplaceTempView(oview)
        source += f" LEFT JOIN {oview} AS y ON x.pin_id = y.pin_id"
        scope.old = "y"
    r = Resolver(session, scope, session.planner.query)
    cols = []
    for c in classes:
        try:
            cols.append(f"coalesce({r.member(rel, c.name)}, FALSE) AS {quote('in_' + c.name)}")
        except (Unknown, ValueError):  # needs parameters, or a change to look at
            cols.append(f"FALSE AS {quote('in_' + c.name)}")
    return session.spark.sql(f"SELECT x.*, {', '.join(cols)} FROM {source}")


def changes(session, table: str, old: DataFrame | None, new: DataFrame | None, key: str = "pin_id") -> DataFrame:
    """(key, class, kind) for every class that a row entered, was updated in, or left."""
    classes = relevant(session, table)
    spark = session.spark
    none = f"`{key}` long, class string, kind string"
    if not classes:
        return spark.createDataFrame([], none)
    flags = [f"in_{c.name}" for c in classes]

    def of(df: DataFrame | None, side: str, before: DataFrame | None) -> DataFrame:
        if df is None:
            return spark.createDataFrame([], f"k long, {side} array<boolean>")
        m = membership(session, table, df, classes, before)
        return m.select(F.col(key).alias("k"), F.array(*[F.col(quote(f)) for f in flags]).alias(side))

    both = of(old, "was", None).join(of(new, "now", old), "k", "full")
    names = F.array(*[F.lit(c.name) for c in classes])
    each = both.select("k", F.explode(F.arrays_zip(names.alias("c"), F.coalesce("was", F.array_repeat(F.lit(False), len(classes))).alias("w"), F.coalesce("now", F.array_repeat(F.lit(False), len(classes))).alias("n"))).alias("e"))
    kind = F.when(~F.col("e.w") & F.col("e.n"), "enter").when(F.col("e.w") & F.col("e.n"), "update").when(F.col("e.w") & ~F.col("e.n"), "leave")
    return each.select(F.col("k").alias(key), F.col("e.c").alias("class"), kind.alias("kind")).where("kind IS NOT NULL")


def publish(session, store, table: str, old: DataFrame | None, new: DataFrame | None, names: set[str]) -> None:
    """Runs what the changes set off, in the order enter, update, leave. An error undoes the statement."""
    listeners = [x for x in session.listeners if x[0] is None or x[0].lower() in {c.name.lower() for c in relevant(session, table)}]
    acting = [c for c in relevant(session, table) if any(c.actions.values())]
    if not acting and not listeners:
        return
    found = changes(session, table, old, new)
    found = session.spark.read.schema(found.schema).parquet(store._write(found, "_old", "events"))
    for kind in KINDS:
        rows = new if kind != "leave" else old
        if rows is None:
            continue
        for c in acting:
            for action in c.actions.get(kind, ()):
                hit = found.where((F.col("class") == c.name) & (F.col("kind") == kind)).select("pin_id")
                if not hit.isEmpty():
                    act(session, store, table, action, rows.join(hit, "pin_id", "left_semi"), names, {"kind": kind, "class": c.name})
        for cls, wanted, f in listeners:
            if wanted is None or wanted == kind:
                hit = found.where(F.col("kind") == kind)
                hit = hit if cls is None else hit.where(F.lower("class") == cls.lower())
                if not hit.isEmpty():
                    f(kind, rows.join(hit.select("pin_id").distinct(), "pin_id", "left_semi"))


def listen(session, f: Callable[[str, DataFrame], None], cls: str | None = None, kind: str | None = None) -> None:
    """``f(kind, rows)`` is called with the rows that entered, changed in or left a class (or any)."""
    session.listeners.append((cls, kind, f))


def act(session, store, table: str, action: t.Node, rows: DataFrame, names: set[str], event: dict[str, str] | None = None) -> None:
    """One statement for all rows that met the event: ``@self`` is each of them, ``@event`` has the event's ``kind`` and ``class``.

    ``@ctx`` and ``@auto`` are there but hold nothing: their properties are missing.
    """
    on = lambda n, alias: _on(n, alias, event or {})
    if isinstance(action, t.Update) and isinstance(action.source.what, t.Self):
        s = t.Update(t.Source([t.ClassRef(table)]), on(action.changes, "x"), on(action.where, "x"), action.raw)
        _, more = store._update(session, s, rows.select("pin_id"))
        names |= set(more)
    elif isinstance(action, t.Delete) and isinstance(action.source.what, t.Self):
        s = t.Delete(action.kind, t.Source([t.ClassRef(table)]), on(action.where, "x"))
        _, more = store._remove(session, s, rows.select("pin_id"))
        names |= set(more)
    elif isinstance(action, t.Insert):
        view = fresh("a")
        rows.createOrReplaceTempView(view)
        r = Resolver(session, Scope(session, [Rel("self", rows.schema, "pin_id" if "pin_id" in rows.columns else None, {}, {}, "self")], f"{view} AS self"), session.planner.query)
        target = store._root(session, action.into[0][0]) if action.into else table if action.copy_self else "pins"
        from lodestone.sources.store import SYSTEM

        for row in action.rows:
            if action.copy_self:  # the row itself with some properties replaced
                new = {k: r.sql(on(v, "self")) for k, v in row.fields}
                cols = [c for c in rows.columns if c not in SYSTEM and c not in new]
                df = session.spark.sql(f"SELECT {', '.join([*[f'self.{quote(c)}' for c in cols], *[f'{v} AS {quote(k)}' for k, v in new.items()]])} FROM {view} AS self")
                store._insert_frame(session, target, df, [], None, names)
                continue
            items = ", ".join(f"{r.sql(on(v, 'self'))} AS {quote(k)}" for k, v in row.fields)
            df = session.spark.sql(f"SELECT {items} FROM {view} AS self")
            store._insert_frame(session, target, df, [c for c, _ in action.into], action.into[0][1] if action.into else None, names)
    elif isinstance(action, (t.Update, t.Delete)):
        action = on(action, None)
        _, more = store._update(session, action) if isinstance(action, t.Update) else store._remove(session, action)
        names |= set(more)
    else:
        session.run(action)


def _on(n, alias: str | None, event: dict[str, str]):
    """``@self.p`` as a property of the rows (if they have an alias), ``@event.p`` as a constant, properties of ``@ctx`` and ``@auto`` as missing."""
    if isinstance(n, t.PathOf) and isinstance(n.x, t.Self):
        if n.x.which == "event":
            v = event.get(n.steps[0].props[0])
            return t.Lit(v, "string") if v is not None else t.Lit(None, "null")
        if n.x.which in ("ctx", "auto"):
            return t.Lit(None, "null")
        if alias is not None:
            return t.Name([alias, *[s.props[0] for s in n.steps]])
    if isinstance(n, t.Self) and alias is not None:
        return t.Name([alias, "pin_id"])
    if isinstance(n, t.Node):
        return type(n)(**{k: _on(v, alias, event) for k, v in vars(n).items()})
    if isinstance(n, list):
        return [_on(v, alias, event) for v in n]
    if isinstance(n, tuple):
        return tuple(_on(v, alias, event) for v in n)
    return n
