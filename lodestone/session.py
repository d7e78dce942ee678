"""A session: statements in, DataFrames out."""

from __future__ import annotations

import contextlib
import datetime
import decimal
import json
import os
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import bits, linalg, text
from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem
from lodestone.lang.parser import parse, parse_expression
from lodestone.plans.query import Planner
from lodestone.plans.resolve import X
from lodestone.sources.catalog import Catalog, ClassDef, Table, fresh, shared_dir

#: Key and reference properties of well-known tables.
KNOWN_KEYS = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {}),
    "documents": ("doc_id", {}),
    "embeddings": ("vec_id", {}),
    "pages": ("page_id", {}),
    "benchmark": ("item_id", {}),
    "labels": (None, {"doc_id": "documents"}),
    "conversations": (None, {}),
}
_FLAGS = {
    "nulls_out": "comparisons with missing operands are not true (standard SQL)",
    "case_insensitive": "strings compare without regard to case",
    "numeric_strings": "strings that look like numbers compare as numbers",
    "strict_missing": "rows whose group or sort keys are all missing are dropped",
    "all_words": "MATCH asks for every word",
    "filter_stop_words": "MATCH ignores stop words in the query",
    "path_depth": "the rows at the end of a step have a column depth: how many times it was repeated",
}


class Session:
    """Runs statements of the language over named DataFrames and, if given, a store that can be changed."""

    def __init__(self, spark: SparkSession, store=None, identity: str = "owner", store_id: int = 0, **flags: bool):
        unknown = set(flags) - set(_FLAGS)
        if unknown:
            raise TypeError(f"no flags {sorted(unknown)}")
        self.spark, self.store, self.identity, self.store_id = spark, store, identity, store_id
        self.store_name = getattr(store, "name", "store")
        self.flags = dict.fromkeys(_FLAGS, False) | flags
        self.catalog = Catalog(spark)
        self.planner = Planner(self)
        self.params: dict = {}
        self.memo: dict = {}
        self.out_units: dict[str, str] = {}
        self.pending_parts: list[tuple[str, int, str]] = []
        self.operators: dict[str, list[Callable]] = {}
        self.functions: dict[str, tuple[str, T.DataType | None]] = {}
        self.services: dict[str, object] = {}
        self.trace: dict[str, bool] = {}
        self.plans: list[str] = []
        self.base = ""
        self.listeners: list[Callable] = []
        self.show_deleted = False
        self._whole: tuple[str, T.StructType] | None = None
        self.text_indexes: dict[tuple[str, str], str] = {}  #: (table, property) -> view of the index
        self._n_parts = 0
        prepare(spark)
        if store is not None:
            store.attach(self)

    # -- names

    def register(self, name: str, df: DataFrame, key: str | None = None, refs: dict[str, str] | None = None) -> Table:
        """Name a DataFrame; ``refs``: reference property -> name of the table whose key it holds."""
        self._whole = None
        self.text_indexes = {k: v for k, v in self.text_indexes.items() if k[0] != name.lower()}
        return self.catalog.add(name, df, key, refs)

    def index_text(self, name: str, *props: str, path: str | None = None) -> str:
        """Build (or build anew) the inverted index of text properties of a table with a key; MATCH on these properties then looks words up instead of
        reading texts. The index is written to ``path``, or to the shared folder, as many files, each in order of words, so that no word has to fit into
        one. It goes when the table changes."""
        import uuid

        from lodestone.operators import text_search

        table = self.catalog.root(name)
        if table.key is None:
            raise LookupError(f"{name} has no key")
        props = props or tuple(f.name for f in table.schema if isinstance(f.dataType, T.StringType))
        path = path or f"{shared_dir(self.spark)}/words-{uuid.uuid4().hex}"
        found = text_search.index(self.spark.table(table.view), table.key, *props)
        found.sortWithinPartitions("word").write.mode("overwrite").parquet(path)
        view = fresh("w")
        self.spark.read.schema(found.schema).parquet(path).createOrReplaceTempView(view)
        self.text_indexes |= {(table.name.lower(), p.lower()): view for p in props}
        return path

    def register_parquet(self, folder: str, names: list[str] | None = None) -> Session:
        """Name the parquet tables of a folder; each is opened when a query first names it."""
        for n in names or KNOWN_KEYS:
            key, refs = KNOWN_KEYS.get(n, (None, {}))
            self.catalog.lazily(n, lambda n=n, key=key, refs=refs: (self.spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet"), key, refs))
        return self

    def register_function(self, name: str, f: Callable, kind: str = "string") -> None:
        """A Python function as a function of the language: pandas UDFs as they are, others wrapped to run on Arrow batches."""
        sql_name = "ls_f_" + name.lower()
        if not hasattr(f, "evalType"):
            plain = f

            def batch(*cols):
                return pd.Series([plain(*row) for row in zip(*cols, strict=True)], dtype=object)

            f = _typed_batch(batch, plain, kind)
        self.spark.udf.register(sql_name, f)
        self.functions[name.lower()] = (sql_name, None)

    def register_operator(self, op: str, hook: Callable[[X, X], object]) -> None:
        """``hook(a, b)`` gets both compiled operands and gives SQL, or None to leave them to the operator itself."""
        self.operators.setdefault(op, []).insert(0, hook)

    def register_service(self, name: str, service) -> None:
        self.services[name.lower()] = service

    def define_expression(self, name: str, expression: str) -> None:
        """A stored expression: its name stands for it, with arguments for ``:0``, ``:1`` ..."""
        parse_expression(expression)
        self.catalog.stored[name.lower()] = expression

    def name_object(self, name: str, cls: str, key: object) -> None:
        self.catalog.named[name] = (cls, key)

    # -- parameters

    def as_node(self, v: object) -> t.Node:
        """A Python value as a constant of the language."""
        if isinstance(v, t.Node):
            return v
        if v is None:
            return t.Lit(None, "null")
        if isinstance(v, bool):
            return t.Lit(v, "bool")
        if isinstance(v, int):
            return t.Lit(v, "int")
        if isinstance(v, (float, decimal.Decimal)):
            return t.Lit(float(v), "float")
        if isinstance(v, (bytes, bytearray)):
            return t.Lit(bytes(v), "binary")
        if isinstance(v, (datetime.datetime, datetime.date)):
            return t.Lit(v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat(), "timestamp")
        if isinstance(v, (list, tuple, set)):
            return t.Coll([self.as_node(x) for x in v])
        if isinstance(v, dict):
            return t.Struct([(k, self.as_node(x)) for k, x in v.items()])
        if isinstance(v, range):
            return t.Range(t.Lit(v.start, "int"), t.Lit(v.stop - 1, "int"))
        return t.Lit(str(v), "string")

    @contextlib.contextmanager
    def bound(self, params: dict) -> Iterator[None]:
        before = self.params
        self.params = {**before, **params}
        try:
            yield
        finally:
            self.params = before

    def part(self, kind: str, sql: str) -> int:
        """The number under which a query's histogram or position is worked out."""
        for k, i, x in self.pending_parts:
            if (k, x) == (kind, sql):
                return i
        self._n_parts += 1
        self.pending_parts.append((kind, self._n_parts, sql))
        return self._n_parts

    # -- running

    def execute(self, script: str, params: dict | list | None = None, limit: int | None = None, skip: int | None = None) -> DataFrame | None:
        """Runs all statements; the DataFrame of the last query, or the number of rows changed as a DataFrame (n)."""
        out = None
        with self.bound(dict(enumerate(params)) if isinstance(params, (list, tuple)) else params or {}):
            for s in parse(script):
                out = self.run(s, limit, skip)
        return out

    def run(self, s: t.Node, limit: int | None = None, skip: int | None = None) -> DataFrame | None:
        if isinstance(s, t.With):
            with self.bound(dict(s.values)):
                return self.run(s.body, limit, skip)
        if isinstance(s, (t.Select, t.SetOp)):
            self.memo = {}
            self.pending_parts = []
            df = self.planner.frame(s, limit, skip)
            if any(self.trace.values()):
                self.plans.append(df._jdf.queryExecution().toString())
            return df
        if isinstance(s, (t.Insert, t.Update, t.Delete, t.Transaction)):
            if self.store is None:
                raise RuntimeError("this session has no store to change")
            self.memo = {}
            n = self.store.run(self, s)
            return None if n is None else self.spark.createDataFrame([(n,)], "n long")
        if isinstance(s, t.Create):
            return self._create(s)
        if isinstance(s, t.Drop):
            self._drop(s)
        elif isinstance(s, t.Rule):
            self._rule(s)
        elif isinstance(s, t.Setting):
            self._set(s)
        else:
            raise SyntaxProblem(f"{type(s).__name__} is no statement")
        return None

    def json(self, query: str, params: dict | None = None) -> DataFrame:
        """The rows of a query as JSON texts (value), made and left in the executors."""
        return self.execute(query, params).select(F.to_json(F.struct("*")).alias("value"))

    def execute_json(self, script: str, params: dict | None = None, most: int | None = None) -> str:
        """All results as one JSON text: an array of rows, or for several statements an array of those.

        Rows come to the driver a partition at a time; a result of more than ``most`` rows is an error then, as one text has to fit into memory. json()
        gives results of any size.
        """
        results = []
        with self.bound(params or {}):
            for s in parse(script):
                if (df := self.run(s)) is not None:
                    texts = []
                    for row in df.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator():
                        if most is not None and len(texts) == most:
                            raise ValueError(f"the result has more than {most} rows")
                        texts.append(row["value"])
                    results.append("[" + ",".join(texts) + "]")
        return results[0] if len(results) == 1 else "[" + ",".join(results) + "]"

    def value_json(self, expression: str) -> str:
        row = self.execute(f"SELECT {expression} AS value").select(F.to_json(F.struct("value")).alias("j")).first()
        return json.dumps(json.loads(row["j"]).get("value"))

    def count(self, query: str, params: dict | None = None) -> int:
        return self.execute(query, params).count()

    def exists(self, query: str, params: dict | None = None) -> bool:
        return not self.execute(query, params).isEmpty()

    def analyze(self, query: str, params: dict | None = None) -> str:
        """The plan as text."""
        df = self.execute(query, params)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def sql(self, query: str, params: dict | None = None) -> str:
        """The Spark SQL that a query becomes."""
        with self.bound(params or {}):
            self.memo = {}
            return self.planner.query(parse(query)[0])[0]

    def is_satisfied(self, predicate: str, row: dict, params: dict | None = None) -> bool:
        """Whether one row, given as a dict, meets a predicate."""
        with self.bound(params or {}):
            q = t.Select([t.Item(t.Lit(1, "int"), "x")], t.Source(t.Coll([self.as_node(row)])), parse_expression(predicate))
            return not self.run(q).isEmpty()

    def execute_async(self, script: str, done: Callable[[DataFrame | None, Exception | None], None], params: dict | None = None) -> threading.Thread:
        """Runs a script on a thread of its own; ``done`` gets the result or the error."""
        from pyspark import InheritableThread

        def work() -> None:
            try:
                done(self.execute(script, params), None)
            except Exception as e:  # noqa: BLE001  handed to the caller
                done(None, e)

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        return thread

    def statement(self):
        """A builder of a query."""
        from lodestone.builder import Statement

        return Statement(self)

    # -- definitions

    def _create(self, s: t.Create) -> None:
        kind = s.kind
        if kind in ("CLASS", "EVENT"):
            if not isinstance(s.body, t.Select):
                raise SyntaxProblem("a class is a SELECT")
            actions, window = {}, None
            for key, v in s.props:
                if key.lower() in ("onenter", "onupdate", "onleave"):
                    items = v.items if isinstance(v, t.Coll) else [v]
                    actions[key[2:].lower()] = [x for i in items for x in (i.body if isinstance(i, t.Stored) else [i])]
                elif key.lower() == "window":
                    window = v.value if isinstance(v, t.Lit) and v.kind == "int" else v
            self.catalog.define(ClassDef(s.name, s.body, kind == "EVENT", actions, window))
        elif kind == "ENUMERATION":
            self.catalog.enums[s.name.lower()] = [str(x) for x in s.body]
        elif kind == "CONDITION":
            self.catalog.conditions[s.name.lower()] = s.body
        elif kind == "ACTION":
            self.catalog.actions[s.name.lower()] = s.body
        elif kind == "LOADER":
            self._load(s)
        elif kind == "STORE":
            self._open(s.body)
        else:
            self.catalog.others.setdefault(kind, {})[(s.name or fresh("o")).lower()] = s
        return None

    def _load(self, s: t.Create) -> None:
        """A loader is a Python module with ``load(session)``."""
        import importlib

        try:
            importlib.import_module(str(s.body.value)).load(self)
        except ImportError:
            if not s.extra.get("optional"):
                raise
        self.catalog.others.setdefault("LOADER", {})[s.name.lower()] = s

    def _drop(self, s: t.Drop) -> None:
        low = s.name.lower()
        if s.kind == "STORE":
            for name in self.store.manifest["tables"]:
                self.catalog.drop_table(name)
            self.store.drop()
            self.store = None
            return
        places = {"CLASS": self.catalog.classes, "EVENT": self.catalog.classes, "ENUMERATION": self.catalog.enums, "CONDITION": self.catalog.conditions, "ACTION": self.catalog.actions}
        place = places.get(s.kind, self.catalog.others.get(s.kind, {}))
        if low not in place:
            raise LookupError(f"no {s.kind.lower()} {s.name}")
        del place[low]

    def _rule(self, s: t.Rule) -> None:
        """A rule is a class whose predicate joins its conditions and whose entering runs its actions."""
        from lodestone.plans.query import subst

        where, source = None, None
        for name, args in s.conditions:
            low = name.lower()
            params = dict(enumerate(args))
            if low in self.catalog.conditions:
                c = subst(self.catalog.conditions[low], params)
                where = c if where is None else t.Binary("AND", where, c)
            else:
                ref = t.ClassRef(name, list(args))
                source = [ref] if source is None else [*source, ref]
        if source is None:
            raise SyntaxProblem("a rule needs a class among its conditions")
        acts = []
        for name, args in s.actions:
            if name.lower() not in self.catalog.actions:
                raise LookupError(f"no action {name}")
            acts += [subst(a, dict(enumerate(args))) for a in self.catalog.actions[name.lower()]]
        self.catalog.rules[s.name.lower()] = s
        self.catalog.define(ClassDef(s.name, t.Select(None, t.Source(source), where), True, {"enter": acts}))

    def _set(self, s: t.Setting) -> None:
        if s.what == "BASE":
            self.base = str(s.value)
        elif s.what == "PREFIX":
            self.catalog.prefixes[s.name] = str(s.value)
        elif s.what == "TRACE":
            self.trace[s.name] = bool(s.value)
        elif s.what == "CLOSE":
            self.store = None
        elif s.what == "OPEN":
            self._open(s.value)
        elif s.what == "START":
            if s.name.lower() not in self.catalog.others.get("FSM", {}):
                raise LookupError(f"no machine {s.name}")
            self.catalog.others["FSM"][s.name.lower()].extra["started"] = True

    def _open(self, options: object) -> None:
        """A store by its path, or by options (path, name)."""
        from lodestone.sources.store import Store

        if isinstance(options, t.Struct):
            values = {k.lower(): v.value for k, v in options.fields}
            self.store = Store(self.spark, values["path"], values.get("name", "store"))
        else:
            self.store = Store(self.spark, options.value)
        self.store_name = self.store.name
        self.store.attach(self)

    def inject(self, table: str, **values) -> None:
        """A message: a row that sets off the actions of the classes it would enter, and is not kept."""
        from lodestone.streaming.events import publish

        row = self.planner.frame(t.Select([t.Item(self.as_node(v), k) for k, v in {"pin_id": -1, **values}.items()]))
        schema = self.catalog.must(table).schema
        for f in schema:
            if f.name not in row.columns:
                row = row.withColumn(f.name, F.lit(None).cast(f.dataType.simpleString()))
        names: set[str] = set()
        self.store._begin()
        publish(self, self.store, table, None, row.selectExpr(*[f"`{f.name}`" for f in schema], *[f"`{c}`" for c in row.columns if c not in {f.name for f in schema}]), names)
        self.store._end(sorted(names))

    # -- the whole store, and who may read

    def whole_store(self) -> tuple[str, T.StructType]:
        """All tables as one: ``pin_id`` (null in tables without a key), ``class_name`` and the union of their columns; columns of one name
        whose types differ are text. Each table's rows are those that this identity may read."""
        names = sorted(set(self.catalog.loaders) | set(self.catalog.tables))
        tables = [x for n in names if (x := self.catalog.table(n)) is not None]
        if self._whole is None or self._whole[0] not in {v.name for v in self.spark.catalog.listTables() if v.isTemporary}:
            kinds: dict[str, set[str]] = {}
            for x in tables:
                for f in x.schema:
                    kinds.setdefault(f.name.lower(), set()).add(f.dataType.simpleString())
            df = None
            for x in tables:
                one = self.spark.sql(self.guard(x)) if self.guard(x) else self.spark.table(x.view)
                one = one.select(*[F.col(f"`{c}`").cast("string") if len(kinds[c.lower()]) > 1 and c != x.key else F.col(f"`{c}`") for c in one.columns])
                key = F.col(x.key).cast("long") if x.key else F.lit(None).cast("long")
                one = one.withColumn("class_name", F.lit(x.name)).withColumn("pin_id", key)
                df = one if df is None else df.unionByName(one, allowMissingColumns=True)
            if df is None:
                raise LookupError("there are no tables")
            view = fresh("all")
            df.createOrReplaceTempView(view)
            self._whole = (view, df.schema)
        return self._whole

    def guard(self, table: Table) -> str | None:
        """SQL of a table's rows that this identity may read, or None where there is nothing to check."""
        names = {f.name for f in table.schema}
        conds = []
        if "_acl" in names and self.identity != "owner":
            conds.append(f"(_acl IS NULL OR exists(_acl, a -> a.who = '{self.identity}' AND contains(a.mode, 'r')))")
        if "_deleted" in names and not self.show_deleted:
            conds.append("NOT coalesce(_deleted, FALSE)")
        return f"SELECT * FROM {table.view} WHERE {' AND '.join(conds)}" if conds else None


_SHIPPED: set[str] = set()
_READY: set[str] = set()
#: Bytes of rows that go to a Python worker at a time, unless the session says so itself.
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def prepare(spark: SparkSession) -> None:
    """Register the functions that Spark lacks, once for each SparkSession."""
    key = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    if key in _READY:
        return
    ship(spark)
    linalg.register(spark)
    bits.register(spark)
    spark.udf.register("ls_stems", text.stem_udf)
    _READY.add(key)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, for the few functions that run in Python, and bound their batches by bytes."""
    import tempfile
    import zipfile
    from pathlib import Path

    if _ARROW[0] not in spark.conf.getAll:
        spark.conf.set(*_ARROW)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in top.rglob("*.py"):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def _typed_batch(batch: Callable, plain: Callable, kind: str):
    """A pandas UDF with as many arguments as the function has."""
    import inspect

    n = len(inspect.signature(plain).parameters)

    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return batch(a)

        return F.pandas_udf(one, kind)
    if n == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return batch(a, b)

        return F.pandas_udf(two, kind)
    if n == 3:

        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return batch(a, b, c)

        return F.pandas_udf(three, kind)
    raise TypeError("functions take one to three arguments; pass a pandas UDF for more")


def new_spark(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A SparkSession with the settings that the engine expects; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
