"""A store that can be changed: tables as parquet files under a manifest.

A table is a list of added row sets and a list of deleted identities, each with a sequence number; a row is there unless a
later entry deletes its identity. So a change writes the rows it changes and their identities, never the table. A transaction
is a copy of the manifest; commit writes it under the next number, and readers see one manifest throughout. ``compact``
rewrites a table as one row set.
"""

from __future__ import annotations

import copy
import datetime
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem
from lodestone.operators import paths
from lodestone.plans.changes import assignments
from lodestone.plans.resolve import Resolver, Scope, quote
from lodestone.sources.catalog import ClassDef, Unknown, fresh

SYSTEM = ("pin_id", "parent_id", "created", "createdBy", "updated", "updatedBy", "stamp", "_deleted")
_KINDS = {"pin_id": "bigint", "parent_id": "bigint", "created": "timestamp_ntz", "createdBy": "string", "updated": "timestamp_ntz", "updatedBy": "string", "stamp": "bigint", "_deleted": "boolean"}


def loose(fields) -> T.StructType:
    """A schema in which anything may be missing, also inside collections."""
    return T.StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


class Conflict(RuntimeError):
    """Another writer committed first, or a row is not what the caller expected."""


class Files:
    """Small files and renames through Hadoop, so that the store can be anywhere Spark can write."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """False if the file is there already; of several writers one succeeds, and the file appears whole.

        File systems rename a finished file to a name that must not exist; object stores, which show an object only once it is complete, create it
        on that condition.
        """
        p, fs = self._path(path)
        data = bytearray(text.encode())
        try:
            if fs.getScheme() not in ("file", "hdfs", "viewfs"):
                stream = fs.create(p, False)
                stream.write(data)
                stream.close()
                return True
            tmp, _ = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
            stream = fs.create(tmp, False)
            stream.write(data)
            stream.close()
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            how = self.gateway.new_array(rename, 1)
            how[0] = rename.NONE
            try:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(tmp, p, how)
            finally:
                if fs.exists(tmp):
                    fs.delete(tmp, False)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.toString():
                raise
            return False

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def make(self, path: str) -> None:
        p, fs = self._path(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        p, fs = self._path(path)
        fs.rename(p, self._path(to)[0])


class Store:
    def __init__(self, spark: SparkSession, path: str, name: str = "store"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.files = Files(spark)
        self.files.make(self.path)
        self.stack: list[dict] = []
        self.read_only = False
        self.manifest = self._latest()
        self.session = None
        self.depth = 0
        self.on_commit: list = []

    # -- manifests

    def _latest(self) -> dict:
        found = [int(n[9:-5]) for n in self.files.names(self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if not found:
            return {"version": 0, "seq": 0, "next": 1, "tables": {}}
        return json.loads(self.files.read(f"{self.path}/manifest-{max(found)}.json"))

    def attach(self, session) -> None:
        self.session = session
        for name in self.manifest["tables"]:
            self._publish(name)

    def _publish(self, name: str) -> None:
        """Let the session see the table as it is now."""
        info = self.manifest["tables"].get(name)
        if info is None:
            self.session.catalog.drop_table(name)
            return
        self.session.register(name, self.rows(name), "pin_id", info["refs"])

    def _save(self) -> None:
        m = {**self.manifest, "version": self.manifest["version"] + 1}
        if not self.files.write_new(f"{self.path}/manifest-{m['version']}.json", json.dumps(m)):
            raise Conflict("another writer committed first")
        self.manifest = m
        for f in self.on_commit:
            f(self)

    # -- reading

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest["tables"][name]["schema"]))

    def rows(self, name: str, deleted: bool = True) -> DataFrame:
        """All rows that are there, with soft-deleted ones unless not wanted."""
        info = self.manifest["tables"][name]
        schema = self.schema(name)
        out = None
        for path, seq in info["adds"]:
            one = self.spark.read.parquet(path).withColumn("_seq", F.lit(seq))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            out = self.spark.createDataFrame([], schema.add("_seq", "long"))
        for f in schema:
            if f.name not in out.columns:
                out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        gone = None
        for path, seq in info["dels"]:
            one = self.spark.read.parquet(path).select("pin_id", F.lit(seq).alias("_gone"))
            gone = one if gone is None else gone.unionByName(one)
        if gone is not None:
            gone = gone.groupBy("pin_id").agg(F.max("_gone").alias("_gone"))
            out = out.join(gone, "pin_id", "left").where(F.col("_gone").isNull() | (F.col("_seq") > F.col("_gone"))).drop("_gone")
        out = out.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in schema])
        return out if deleted else out.where("NOT coalesce(_deleted, FALSE)")

    # -- writing

    def create_table(self, name: str, schema: str | T.StructType, refs: dict[str, str] | None = None) -> None:
        """A table with the given properties; identity and audit columns are added."""
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        have = {f.name for f in schema}
        full = loose([*[f for f in self._system() if f.name not in have], *schema])
        self._begin()
        self.manifest["tables"][name] = {"schema": full.json(), "refs": refs or {}, "adds": [], "dels": []}
        self._end([name])

    def _system(self) -> list[T.StructField]:
        return list(T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in _KINDS.items())))

    def _begin(self) -> None:
        if self.read_only:
            raise PermissionError("the transaction only reads")
        self.stack.append(copy.deepcopy(self.manifest))

    def _end(self, names: list[str]) -> None:
        """The statement is done: outside a transaction that is a commit."""
        self.stack.pop()
        if not self.stack:
            try:
                self._save()
            except Conflict:
                self.manifest = self._latest()
                raise
        for n in names:
            self._publish(n)

    def _undo(self) -> None:
        self.manifest = self.stack.pop()
        for n in set(self.manifest["tables"]) | {x for x in self.session.catalog.tables if x not in self.manifest["tables"] and self._owns(x)}:
            self._publish(n)

    def _owns(self, name: str) -> bool:
        t_ = self.session.catalog.tables.get(name)
        return t_ is not None and t_.key == "pin_id"

    def _write(self, df: DataFrame, name: str, kind: str) -> str:
        path = f"{self.path}/data/{name}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _add(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows and returns them as written."""
        info = self.manifest["tables"][name]
        path = self._write(df, name, "add")
        self.manifest["seq"] += 1
        info["adds"].append([path, self.manifest["seq"]])
        schema = self.schema(name)
        have = {f.name for f in schema}
        for f in df.schema:
            if f.name not in have:  # a property the table has not seen
                schema = schema.add(f)
        info["schema"] = loose(schema).json()
        return self.spark.read.parquet(path)

    def _delete_ids(self, name: str, ids: DataFrame) -> None:
        self.manifest["seq"] += 1
        self.manifest["tables"][name]["dels"].append([self._write(ids.select("pin_id"), name, "del"), self.manifest["seq"]])

    def _replace(self, name: str, new: DataFrame) -> DataFrame:
        """Rows with new contents under their identities."""
        path = self._write(new, name, "add")
        written = self.spark.read.parquet(path)
        self._delete_ids(name, written)
        self.manifest["seq"] += 1
        info = self.manifest["tables"][name]
        info["adds"].append([path, self.manifest["seq"]])
        schema = self.schema(name)
        have = {f.name for f in schema}
        for f in written.schema:
            if f.name not in have:
                schema = schema.add(f)
        info["schema"] = loose(schema).json()
        return written

    def compact(self, name: str) -> None:
        """The table as one row set."""
        self._begin()
        path = self._write(self.rows(name), name, "add")
        self.manifest["seq"] += 1
        self.manifest["tables"][name].update(adds=[[path, self.manifest["seq"]]], dels=[])
        self._end([name])

    # -- statements

    def run(self, session, s: t.Node) -> int | None:
        if isinstance(s, t.Transaction):
            self._transaction(s)
            return None
        self._begin()
        try:
            if isinstance(s, t.Insert):
                n, names = self._insert(session, s)
            elif isinstance(s, t.Update):
                n, names = self._update(session, s)
            else:
                n, names = self._remove(session, s)
        except Exception:
            self._undo()
            raise
        self._end(names)
        return n

    def _transaction(self, s: t.Transaction) -> None:
        if s.kind == "START":
            self.stack.append(copy.deepcopy(self.manifest))
            self.read_only = s.read_only
            return
        if not self.stack:
            raise RuntimeError("no transaction is open")
        while self.stack:
            if s.kind == "ROLLBACK":
                self._undo()
            else:
                self.stack.pop()
            if not s.all:
                break
        if not self.stack:
            self.read_only = False
            if s.kind == "COMMIT":
                self._save()

    def _root(self, session, name: str) -> str:
        """The table a class lies over; a name that is nothing yet is a new table."""
        try:
            return session.catalog.root(name).name
        except Unknown:
            return name

    # -- insert

    def _insert(self, session, s: t.Insert) -> tuple[int, list[str]]:
        names: set[str] = set()
        target = self._root(session, s.into[0][0]) if s.into else "pins"
        mode = s.into[0][1] if s.into else None
        if s.query is not None:
            df = session.planner.frame(s.query)
            n = self._insert_frame(session, target, df, [c for c, _ in s.into], mode, names)
        else:
            n = self._insert_rows(session, target, s.rows, [c for c, _ in s.into], mode, names, None)
        return n, sorted(names)

    def _insert_rows(self, session, target: str, rows: list[t.Struct], into: list[str], mode: str | None, names: set[str], parent: int | None) -> int:
        """Rows given one by one; parts go first, references by ``@:n`` are known beforehand."""
        first = self.manifest["next"]
        self.manifest["next"] += len(rows)
        temps = {r.temp if r.temp is not None else i: first + i for i, r in enumerate(rows)}
        r = Resolver(session, Scope(session, []), session.planner.query)
        n, selects = 0, []
        for i, row in enumerate(rows):
            fields = []
            for key, v in row.fields:
                if isinstance(v, t.Sub) and isinstance(v.query, t.Insert):
                    child = v.query
                    where = self._root(session, child.into[0][0]) if child.into else target
                    at = self.manifest["next"]
                    n += self._insert_rows(session, where, child.rows, [c for c, _ in child.into], None, names, first + i if child.part else None)
                    fields.append(f"array({', '.join(f'{at + k}L' for k in range(len(child.rows)))}) AS {quote(key)}" if len(child.rows) > 1 else f"{at}L AS {quote(key)}")
                elif isinstance(v, t.Lit) and v.kind == "temp":
                    fields.append(f"{temps[v.value]}L AS {quote(key)}")
                else:
                    fields.append(f"{r.sql(v)} AS {quote(key)}")
            up = "CAST(NULL AS BIGINT)" if parent is None else f"{parent}L"
            selects.append((f"{first + i}L AS pin_id, {up} AS parent_id" + "".join(", " + f for f in fields), [k for k, _ in row.fields]))
        df = None
        for sql, _ in selects:
            one = self.spark.sql("SELECT " + sql)
            df = one if df is None else df.unionByName(one, allowMissingColumns=True)
        return n + self._insert_frame(session, target, df, into, mode, names)

    def _insert_frame(self, session, target: str, df: DataFrame, into: list[str], mode: str | None, names: set[str]) -> int:
        if target not in self.manifest["tables"]:
            have = set(df.columns)
            schema = loose([*self._system(), *[f for f in df.schema if f.name not in SYSTEM]])
            self.manifest["tables"][target] = {"schema": schema.json(), "refs": {}, "adds": [], "dels": []}
        known = {f.name: f.dataType for f in self.schema(target)}
        for c in df.columns:
            if c in known and df.schema[c].dataType != known[c]:
                df = df.withColumn(c, F.col(c).cast(known[c].simpleString()))
        user = [c for c in df.columns if c not in SYSTEM]
        if mode:
            old = self.rows(target, deleted=False)
            same = [F.col(f"n.{quote(c)}").eqNullSafe(F.col(f"o.{quote(c)}")) for c in user]
            cond = same[0]
            for c in same[1:]:
                cond = cond & c
            if mode == "UNIQUE":
                if not df.alias("n").join(old.alias("o"), cond, "left_semi").isEmpty():
                    raise Conflict(f"{target} has such a row")
            else:
                df = df.dropDuplicates(user).alias("n").join(old.alias("o"), cond, "left_anti")
        if "pin_id" not in df.columns:
            df = df.withColumn("pin_id", F.lit(self.manifest["next"]) + F.monotonically_increasing_id())
        now = F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        auto = {"parent_id": F.lit(None).cast("bigint"), "created": now, "createdBy": F.lit(session.identity), "updated": now, "updatedBy": F.lit(session.identity), "stamp": F.lit(self.manifest["seq"] + 1).cast("bigint"), "_deleted": F.lit(False)}
        for c, v in auto.items():
            if c not in df.columns:
                df = df.withColumn(c, v)
        written = self._add(target, df)
        n, top = written.agg(F.count("*"), F.max("pin_id")).first()
        self.manifest["next"] = max(self.manifest["next"], (top or 0) + 1)
        self._publish(target)
        names.add(target)
        for c in into:  # INTO asks that the rows belong to the class
            if isinstance(session.catalog.must(c), ClassDef):
                view = fresh("w")
                written.createOrReplaceTempView(view)
                if self._members(session, target, view, c).count() < n:
                    raise Conflict(f"a row does not belong to {c}")
        self._fire(session, target, None, written, names)
        return n

    def _members(self, session, target: str, view: str, cls: str) -> DataFrame:
        from lodestone.plans.resolve import Rel

        df = self.spark.table(view)
        for f in self.schema(target):
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        full = fresh("w")
        df.createOrReplaceTempView(full)
        rel = Rel("x", df.schema, "pin_id", {}, {}, target)
        cond = Resolver(session, Scope(session, [rel], f"{full} AS x"), session.planner.query).member(rel, cls)
        return self.spark.sql(f"SELECT x.* FROM {full} AS x WHERE {cond}")

    # -- update

    def _targets(self, session, source: t.Source) -> list[str]:
        if source.what == "*":
            return sorted(self.manifest["tables"])
        if isinstance(source.what, list):
            return [session.catalog.root(source.what[0].name).name]
        if isinstance(source.what, t.Object):
            return [session.catalog.root(session.catalog.named[source.what.name][0]).name]
        if isinstance(source.what, (t.Lit, t.Coll)):
            return sorted(self.manifest["tables"])
        raise SyntaxProblem("changes go to tables, classes or identities")

    def _ids(self, source: t.Source) -> list[t.Node] | None:
        if source.ids:
            return source.ids
        if isinstance(source.what, t.Lit):
            return [source.what]
        if isinstance(source.what, t.Coll):
            return source.what.items
        return None

    def _selected(self, session, name: str, source: t.Source, where: t.Node | None, match=(), only: DataFrame | None = None) -> tuple[DataFrame, object, str]:
        """The rows of a table that a change is about, as a named view: (rows, relation, view)."""
        what = source.what if isinstance(source.what, (list, t.Object)) else [t.ClassRef(name)]
        q = t.Select(None, t.Source(what, "x", self._ids(source)), where, list(match))
        session.memo = {}
        df = session.planner.frame(q)
        if only is not None:
            df = df.join(only.select("pin_id"), "pin_id", "left_semi")
        view = fresh("u")
        df.createOrReplaceTempView(view)
        from lodestone.plans.resolve import Rel

        refs = {k.lower(): v for k, v in self.manifest["tables"][name]["refs"].items()}
        return df, Rel("x", df.schema, "pin_id", refs, {}, name), view

    def _update(self, session, s: t.Update, only: DataFrame | None = None) -> tuple[int, list[str]]:
        names, total = set(), 0
        for name in self._targets(session, s.source):
            old, rel, view = self._selected(session, name, s.source, s.where, (), only)
            total += self._apply(session, name, s.changes, old, rel, view, names)
        return total, sorted(names)

    def _apply(self, session, name: str, changes: list[t.Change], old: DataFrame, rel, view: str, names: set[str]) -> int:
        r = Resolver(session, Scope(session, [rel], f"{view} AS x"), session.planner.query)
        cols = assignments(r, rel, changes)
        cols["updated"] = f"TIMESTAMP_NTZ '{datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None).isoformat(' ')}'"
        cols["updatedBy"] = f"'{session.identity}'"
        cols["stamp"] = f"{self.manifest['seq'] + 1}L"
        kept = [f.name for f in old.schema]
        items = [f"{cols.get(c, 'x.' + quote(c))} AS {quote(c)}" for c in kept] + [f"{v} AS {quote(c)}" for c, v in cols.items() if c not in kept]
        before = self._keep(old)
        before.createOrReplaceTempView(view)
        written = self._replace(name, self.spark.sql(f"SELECT {', '.join(items)} FROM {view} AS x"))
        n = written.count()
        self._publish(name)
        names.add(name)
        self._fire(session, name, before, written, names)
        return n

    def _keep(self, df: DataFrame) -> DataFrame:
        """The rows as they are before the change."""
        return self.spark.read.schema(df.schema).parquet(self._write(df, "_old", "old"))

    def modify(self, name: str, pin_id: int, values: dict, stamp: int | None = None) -> None:
        """Set properties of one row; with ``stamp``, only if nobody has changed it since: the update itself asks for the stamp, and the commit for the state that it read."""
        changes = [t.Change("=", k, self.session.as_node(v)) for k, v in values.items()]
        where = None if stamp is None else t.Binary("=", t.Name(["stamp"]), self.session.as_node(stamp))
        if not self.run(self.session, t.Update(t.Source([t.ClassRef(name)], ids=[t.Lit(pin_id, "pid")]), changes, where)):
            if self.rows(name).where(F.col("pin_id") == pin_id).isEmpty():
                raise LookupError(f"no row {pin_id} in {name}")
            raise Conflict(f"row {pin_id} has changed")

    # -- delete

    def _remove(self, session, s: t.Delete, only: DataFrame | None = None) -> tuple[int, list[str]]:
        names, total = set(), 0
        show, session.show_deleted = session.show_deleted, s.kind != "DELETE"
        try:
            for name in self._targets(session, s.source):
                rows, _, _ = self._selected(session, name, s.source, s.where, s.match, only)
                rows = self._keep(rows)
                total += self._with_parts(session, s.kind, name, rows, names)
        finally:
            session.show_deleted = show
        for n in names:
            self._publish(n)
        return total, sorted(names)

    def _with_parts(self, session, kind: str, name: str, rows: DataFrame, names: set[str]) -> int:
        """The rows and all their parts, in any table."""
        edges = None
        for other in self.manifest["tables"]:
            one = self.rows(other).where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("pin_id").alias("dst"))
            edges = one if edges is None else edges.unionByName(one)
        ids = rows.select("pin_id")
        if not edges.isEmpty():
            ids = paths.closure(edges, ids.select(F.col("pin_id").alias("start"))).select(F.col("node").alias("pin_id")).distinct()
        ids = self.spark.read.schema("pin_id long").parquet(self._write(ids, "_old", "ids"))
        total = 0
        for other in sorted(self.manifest["tables"]):
            hit = self.rows(other).join(ids, "pin_id", "left_semi")
            if kind != "PURGE":
                hit = hit.where(F.coalesce("_deleted", F.lit(False)) == (kind == "UNDELETE"))
            hit = self._keep(hit)
            n = hit.count()
            if not n:
                continue
            total += n
            names.add(other)
            if kind == "PURGE":
                self._delete_ids(other, hit)
            else:
                self._replace(other, hit.withColumn("_deleted", F.lit(kind == "DELETE")))
            self._publish(other)
            alive = hit.where("NOT coalesce(_deleted, FALSE)") if kind == "PURGE" else hit
            if kind == "UNDELETE":
                self._fire(session, other, None, hit, names)
            else:
                self._fire(session, other, alive, None, names)
        return total

    # -- actions

    def _fire(self, session, name: str, old: DataFrame | None, new: DataFrame | None, names: set[str]) -> None:
        from lodestone.streaming.events import publish

        if self.depth >= 16:
            raise RecursionError("actions set off actions more than 16 deep")
        self.depth += 1
        try:
            publish(session, self, name, old, new, names)
        finally:
            self.depth -= 1

    # -- whole stores

    def drop(self) -> None:
        self.files.remove(self.path)

    def move(self, to: str) -> Store:
        """The store under another path; paths in its manifest are as they were, so data files go along by copying first."""
        for name in list(self.manifest["tables"]):
            self.compact(name)
        out = Store(self.spark, to, self.name)
        out.session = self.session
        for name, info in self.manifest["tables"].items():
            out.manifest["tables"][name] = {**info, "adds": [], "dels": []}
            out._add(name, self.rows(name))
        out.manifest["next"], out.manifest["seq"] = self.manifest["next"], max(out.manifest["seq"], self.manifest["seq"])
        out._save()
        self.drop()
        return out


class Batch:
    """Rows collected on the driver and inserted together."""

    def __init__(self, session, into: str | None = None):
        self.session, self.into, self.rows = session, into, []

    def add(self, **values) -> Batch:
        self.rows.append(t.Struct([(k, self.session.as_node(v)) for k, v in values.items()], pin=True))
        return self

    def run(self) -> int:
        if not self.rows:
            return 0
        s = t.Insert([(self.into, None)] if self.into else [], self.rows)
        self.rows = []
        return self.session.store.run(self.session, s)
