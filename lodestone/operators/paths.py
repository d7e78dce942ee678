"""Paths along reference properties.

A step is a join of the references with the keys they name. A bounded repetition of a reference with one value is one chain of joins, whose
nodes become rows; of references with several values, a union of ways that begin with each other. The identities on the way are the cycle
guard. An unbounded repetition runs as rounds of joins: each round joins the newly reached nodes with the edges, a few steps in one
job, and drops those that their start has reached already, until a round finds none.

A filter behind the repetition (``next{1,3}[x > 1]``) holds for the last node only, one before it (``next[x > 1]{1,3}``) for all nodes on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem
from lodestone.sources.catalog import Unknown, fresh, shared_dir

#: Longer bounded repetitions of a reference with one value run in rounds.
LONGEST = 8


def closure(edges: DataFrame, starts: DataFrame, low: int = 0, most: int | None = None, hops: int = 4) -> DataFrame:
    """(start, node, depth): what each start reaches in ``low`` steps or more (and in ``most`` or fewer), with the least depth of each node.

    edges: (src, dst); starts: (start). Nulls lead nowhere. A round takes ``hops`` steps from the frontier in one job; what it has reached is written
    to the checkpoint folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct().checkpoint()
    front = starts.where("start IS NOT NULL").select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct().checkpoint()
    reached, depth = front, 0
    while most is None or depth < most:
        known, found = reached, None
        for _ in range(hops if most is None else min(hops, most - depth)):
            depth += 1
            step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
            front = step.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
            known = known.unionByName(front)
            found = front if found is None else found.unionByName(front)
        found = found.checkpoint()
        front = found.where(F.col("depth") == depth)
        reached = reached.unionByName(found)
        if depth % (4 * hops) == 0:
            reached = reached.checkpoint()
        if front.isEmpty():
            break
    return reached.where(F.col("depth") >= low)


def checkpoint_dir(spark) -> str:
    """The folder that all executors share: the one set, or in local mode one made here."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark.sparkContext.getCheckpointDir()


def expand(planner, rel, body: str, steps: list[t.Step], outer):
    """(Rel, SQL in parentheses) of the rows at the end of a path that begins at the rows of ``body``."""
    for s in steps:
        rel, body = _step(planner, rel, body, s, outer)
    return rel, body


def _filtered(planner, rel, s: t.Step, body: str) -> str:
    """The rows of ``body`` that the step's filter leaves; the filter may name references, whose rows are joined here."""
    from lodestone.plans.resolve import Rel, Resolver, Scope

    if s.where is None:
        return body
    scope = Scope(planner.s, [Rel("t", rel.schema, rel.key, rel.refs, rel.units, rel.name)], f"{body} AS t")
    cond = Resolver(planner.s, scope, planner.query).condition(s.where)
    return f"(SELECT t.* FROM {scope.joined()} WHERE {cond})"


def _step(planner, rel, body: str, s: t.Step, outer):
    from lodestone.plans.resolve import Rel, quote

    props = s.props
    if props == ["*"]:
        props = [f.name for f in rel.schema if f.name.lower() in rel.refs]
        if not props:
            raise Unknown(f"{rel.alias} has no references")
    fields = []
    for p in props:
        f = rel.column(p)
        if f is None:
            raise Unknown(f"no property {p} in {rel.name or rel.alias}")
        fields.append(f)
    if all(f.name.lower() not in rel.refs for f in fields):
        return _values(planner, rel, body, s, fields[0])
    targets = {rel.refs[f.name.lower()].lower() for f in fields}
    if len(targets) > 1:
        raise SyntaxProblem("the properties of one step lead to different classes")
    target = planner.s.catalog.root(rel.refs[fields[0].name.lower()])
    schema = T.StructType([*target.schema, T.StructField("depth", T.IntegerType())]) if planner.s.flags["path_depth"] else target.schema
    out = Rel(fresh("p"), schema, target.key, {k.lower(): v for k, v in target.refs.items()}, target.units, target.name)
    key = quote(target.key)
    plain = Rel("t", target.schema, target.key, out.refs, target.units, target.name)
    last = s.last and (s.low, s.high) != (1, 1)
    at_each = target.view if last else _filtered(planner, plain, s, target.view)
    depth = ", {} AS depth" if planner.s.flags["path_depth"] else ""
    if (s.low, s.high) == (1, 1):
        if len(fields) == 1 and not isinstance(fields[0].dataType, T.ArrayType):
            return out, f"(SELECT t.*{depth.format(1)} FROM {body} AS b JOIN {at_each} AS t ON b.{quote(fields[0].name)} = t.{key})"
        edge = " UNION ALL ".join(f"SELECT {_reference('b', f, s)} AS ref FROM {body} AS b" for f in fields)
        return out, f"(SELECT t.*{depth.format(1)} FROM ({edge}) AS b JOIN {at_each} AS t ON b.ref = t.{key})"
    own = (rel.name or "").lower() == target.name.lower()
    if not own and s.high != 1:
        raise SyntaxProblem("only a reference to its own class can repeat")
    if s.low == 0 and not own:
        raise SyntaxProblem("a step to another class can't be left out")
    single = len(fields) == 1 and not isinstance(fields[0].dataType, T.ArrayType)
    if s.high is None or single and s.high > LONGEST:
        sql = _reached(planner, rel, body, s, fields, target, at_each, depth)
    elif single:
        sql = _chain(body, s, fields[0], target, at_each, bool(depth))
    else:
        sql = _branches(body, s, fields, target, at_each, bool(depth))
    return out, _filtered(planner, out, s, sql) if last else sql


def _reference(alias: str, f: T.StructField, s: t.Step) -> str:
    from lodestone.plans.resolve import quote

    col = f"{alias}.{quote(f.name)}"
    if not isinstance(f.dataType, T.ArrayType):
        return col
    if s.element in ("FIRST", "LAST"):
        return f"try_element_at({col}, {1 if s.element == 'FIRST' else -1})"
    if isinstance(s.element, t.Lit):
        return f"try_element_at({col}, {s.element.value + 1})"
    return f"explode({col})"


def _all_references(alias: str, fields, s: t.Step) -> str:
    """An array of all references of a row by which a step can go on."""
    parts = [_reference(alias, f, s).removeprefix("explode") for f in fields]
    arrays = [p if isinstance(f.dataType, T.ArrayType) and s.element is None else f"array({p})" for f, p in zip(fields, parts, strict=True)]
    return f"concat({', '.join(f'coalesce({a}, array())' for a in arrays)})"


def _row(alias: str, target, depth: int | None) -> str:
    from lodestone.plans.resolve import quote, string

    fields = [f"{string(f.name)}, {alias}.{quote(f.name)}" for f in target.schema]
    return f"named_struct({', '.join(fields + ([f"'depth', {depth}"] if depth is not None else []))})"


def _chain(body: str, s: t.Step, f: T.StructField, target, node: str, depth: bool) -> str:
    """A reference with one value: every start has one chain, so its nodes are joined one after the other once, and those of the depths asked for become rows.

    No node occurs twice on the way; a node that is missing, known or filtered ends the chain.
    """
    from lodestone.plans.resolve import quote

    key, sql, seen = quote(target.key), f"{body} AS t0", [f"t0.{quote(target.key)}"]
    for i in range(1, s.high + 1):
        sql += f" LEFT JOIN {node} AS t{i} ON t{i - 1}.{quote(f.name)} = t{i}.{key} AND NOT t{i}.{key} IN ({', '.join(seen)})"
        seen.append(f"t{i}.{key}")
    rows = ", ".join(_row(f"t{i}", target, i if depth else None) for i in range(s.low, s.high + 1))
    return f"(SELECT inline(filter(array({rows}), n -> n.{key} IS NOT NULL)) FROM {sql})"


def _branches(body: str, s: t.Step, fields, target, node: str, depth: bool) -> str:
    """References with several values: a row for each way; the identities on the way go along as the cycle guard. Ways of k steps begin with those of k - 1."""
    from lodestone.plans.resolve import quote

    key, parts = quote(target.key), []
    cols = ", ".join(quote(f.name) for f in target.schema)
    sql = f"(SELECT b.*, array(b.{key}) AS __way FROM {body} AS b)"
    for i in range(s.high + 1):
        if i:
            ref = _all_references("w", fields, s)
            sql = f"(SELECT t.*, array_append(w.__way, t.{key}) AS __way FROM (SELECT w.__way, explode({ref}) AS ref FROM {sql} AS w) AS w JOIN {node} AS t ON w.ref = t.{key} WHERE NOT array_contains(w.__way, t.{key}))"
        if i >= s.low:
            parts.append(f"SELECT {cols}{f', {i} AS depth' if depth else ''} FROM {sql}")
    return "(" + " UNION ALL ".join(parts) + ")"


def _values(planner, rel, body: str, s: t.Step, f: T.StructField):
    """A property that is no reference: its values, the elements of a collection one by one."""
    from lodestone.plans.resolve import Rel, quote

    x = f"b.{quote(f.name)}"
    kind = f.dataType
    if isinstance(kind, T.ArrayType) and s.element is None:
        sql = f"SELECT explode({x}) AS value FROM {body} AS b"
        kind = kind.elementType
    elif isinstance(kind, T.ArrayType):
        sql = f"SELECT {_reference('b', f, s)} AS value FROM {body} AS b"
        kind = kind.elementType
    else:
        sql = f"SELECT {x} AS value FROM {body} AS b WHERE {x} IS NOT NULL"
    schema = T.StructType([T.StructField("value", kind)])
    if isinstance(kind, T.StructType):
        sql, schema = f"SELECT value.* FROM ({sql})", kind
    out = Rel(fresh("p"), schema)
    return out, _filtered(planner, out, s, f"({sql})")


def _reached(planner, rel, body: str, s: t.Step, fields, target, node: str, depth: str) -> str:
    """Nodes that each start reaches, once each."""
    from lodestone.plans.resolve import quote

    spark, key = planner.s.spark, quote(target.key)
    edges = spark.sql(f"SELECT b.{key} AS src, explode({_all_references('b', fields, s)}) AS dst FROM {target.view} AS b")
    if node != target.view:
        edges = edges.join(spark.sql(f"SELECT t.{key} AS dst FROM {node} AS t"), "dst", "left_semi")
    starts = spark.sql(f"SELECT b.{quote(rel.key)} AS start FROM {body} AS b")
    view = fresh("c")
    closure(edges, starts, s.low, s.high).createOrReplaceTempView(view)
    return f"(SELECT t.*{depth.format('c.depth')} FROM {view} AS c JOIN {target.view} AS t ON c.node = t.{key})"
