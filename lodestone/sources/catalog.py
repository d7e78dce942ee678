"""What a session knows by name: tables, classes, enumerations, named rows, actions, machines."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.lang import tree as t

_COUNTER = itertools.count()


def shared_dir(spark) -> str:
    """The folder that all executors share, for written intermediate results; a cluster has to name one, local mode makes its own."""
    import re
    import tempfile

    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _LOCAL[spark.sparkContext.applicationId]


_LOCAL: dict[str, str] = {}


def fresh(label: str) -> str:
    """A view or alias name that no other has."""
    return f"ls_{label}_{next(_COUNTER)}"


@dataclass
class Table:
    """A class with a declared schema; ``refs``: reference property -> table it points to (by that table's key)."""

    name: str
    view: str
    schema: T.StructType
    key: str | None = None
    refs: dict[str, str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)


@dataclass
class ClassDef:
    """A predicate over other sources; parameters make it a family. ``event``: it is not kept, it only fires actions."""

    name: str
    query: t.Select
    event: bool = False
    actions: dict[str, list[t.Node]] = field(default_factory=dict)
    window: object = None

    @property
    def base(self) -> str | None:
        s = self.query.source
        if isinstance(s, t.Source) and isinstance(s.what, list) and len(s.what) == 1 and not s.path and not s.ids:
            return s.what[0].name
        return None

    @property
    def simple(self) -> bool:
        """Only a filter of its base."""
        q = self.query
        return self.base is not None and q.items is None and not (q.group or q.having or q.match or q.modes & {"DISTINCT", "FIRST"})


class Unknown(LookupError):
    """A name that the catalog does not have."""


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.loaders: dict[str, Callable[[], tuple[DataFrame, str | None, dict[str, str]]]] = {}
        self.classes: dict[str, ClassDef] = {}
        self.enums: dict[str, list[str]] = {}
        self.named: dict[str, tuple[str, object]] = {}
        self.stored: dict[str, str] = {}
        self.conditions: dict[str, t.Node] = {}
        self.actions: dict[str, list[t.Node]] = {}
        self.others: dict[str, dict[str, t.Create]] = {}
        self.rules: dict[str, t.Rule] = {}
        self.prefixes: dict[str, str] = {}

    # -- tables

    def add(self, name: str, df: DataFrame, key: str | None = None, refs: dict[str, str] | None = None) -> Table:
        """Name a DataFrame. Units are read from the columns' metadata (``{"unit": "km"}``)."""
        view = fresh("t")
        df.createOrReplaceTempView(view)
        units = {f.name: f.metadata["unit"] for f in df.schema if f.metadata and "unit" in f.metadata}
        self.tables[name.lower()] = out = Table(name, view, df.schema, key, dict(refs or {}), units)
        return out

    def lazily(self, name: str, load: Callable[[], tuple[DataFrame, str | None, dict[str, str]]]) -> None:
        """Name a table that is only looked at once a query names it."""
        self.loaders[name.lower()] = load

    def table(self, name: str) -> Table | None:
        low = name.lower()
        if low not in self.tables and low in self.loaders:
            df, key, refs = self.loaders[low]()
            self.add(name, df, key, refs)
        return self.tables.get(low)

    def drop_table(self, name: str) -> None:
        if got := self.tables.pop(name.lower(), None):
            self.spark.catalog.dropTempView(got.view)

    # -- classes

    def define(self, c: ClassDef) -> None:
        if self.table(c.name) is not None:
            raise ValueError(f"{c.name} is a table")
        self.classes[c.name.lower()] = c

    def get_class(self, name: str) -> ClassDef | None:
        return self.classes.get(name.lower())

    def must(self, name: str) -> Table | ClassDef:
        got = self.table(name) or self.get_class(name)
        if got is None:
            raise Unknown(f"no class {name}")
        return got

    def root(self, name: str) -> Table:
        """The table under a class, through its bases."""
        seen = set()
        while name.lower() not in seen:
            seen.add(name.lower())
            got = self.must(name)
            if isinstance(got, Table):
                return got
            if got.base is None:
                raise Unknown(f"{got.name} has no single base")
            name = got.base
        raise ValueError(f"{name} is its own base")

    def nested(self, name: str) -> list[ClassDef]:
        """The classes from the outermost base to ``name``."""
        out, got = [], self.must(name)
        while isinstance(got, ClassDef):
            out.append(got)
            got = self.must(got.base) if got.base else None
        return out[::-1]

    def listing(self, kind: str) -> DataFrame:
        """The registry of a kind, as rows (name, text)."""
        kind = kind.upper()
        if kind == "CLASSES":
            from lodestone.lang.render import render

            rows = [(c.name, render(c.query)) for c in self.classes.values()]
        elif kind == "ENUMERATIONS":
            rows = [(n, ",".join(v)) for n, v in self.enums.items()]
        elif kind == "NAMEDOBJECTS":
            rows = [(n, f"{c}:{i}") for n, (c, i) in self.named.items()]
        elif kind == "SERVICES":
            from lodestone.sources.services import BUILT_IN

            rows = [(n, type(x).__name__) for n, x in BUILT_IN.items()]
        elif kind == "STORES":
            rows = [(x.name, x.schema.simpleString()) for x in self.tables.values()]
        else:
            rows = [(n, "") for n in self.others.get(kind.removesuffix("S"), {})]
        return self.spark.createDataFrame(rows, "name string, text string")


#: Registries that can be named in FROM.
LISTINGS = ("CLASSES", "TIMERS", "LISTENERS", "LOADERS", "PACKAGES", "NAMEDOBJECTS", "ENUMERATIONS", "STORES", "SERVICES", "FSMS", "HANDLERS")
