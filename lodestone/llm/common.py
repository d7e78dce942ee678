"""Shared helpers: reading tables, cutting lineage, stable hashing, connected components."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at a time. (Spark 4.1 fails on arrays where the batches that come back are bounded as well.)
ARROW_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application, and bound Arrow batches by bytes unless the session does."""
    from lodestone.session import ship as send  # not imported in the executors

    send(spark)
    for k, v in ARROW_BYTES.items():
        if k not in spark.conf.getAll:
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode one is made here if none is named; a cluster has to name one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.conf.get("lodestone.checkpoint.dir", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.checkpoint.dir", own)
    return own


_CUTS = itertools.count(1)


def _trim(spark: SparkSession) -> None:
    """Let the driver's C library hand freed memory back to the system: hundreds of jobs, each on threads of its own, leave much of it behind.

    JVMs that don't know the command go on without it.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    of, kind = jvm.java.lang.Class.forName, jvm.java.lang.Class
    try:
        types = gateway.new_array(kind, 4)
        types[0], types[1], types[2], types[3] = of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, Py4JJavaError):
        pass


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages start from files that outlive any executor. The files go when the driver exits.
    """
    if next(_CUTS) % 8 == 0:
        _trim(df.sparkSession)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, label: str = "t") -> tuple[DataFrame, int]:
    """cut(), and how many rows were written, which the same job counts."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def discard(df: DataFrame) -> None:
    """Remove the files behind a table that cut() made, once nothing reads it any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles() if "/lodestone-" in x}:
        _remove(df.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table by alternating large-star and small-star steps.

    Returns (id, comp): every id that occurs in an edge, with the least id of its component. Each round is
    some aggregations with map-side combining; no neighbourhood is ever collected.
    """
    e, n = cut_counted(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    parts = n // 4096 + 1  # a round has no more edges than the one before
    while n and not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = cut(small.coalesce(parts), "edges")
        discard(e)
        e = small
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return cut(roots.unionByName(roots.select(F.col("comp").alias("id"), "comp")).distinct().coalesce(parts), "comp")


def _stars(e: DataFrame) -> bool:
    """Whether every edge leads straight to the least node of its component: no node has two edges down, or one up and one down."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not ends.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0]


def pieces(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in groups of up to ``chars`` characters; a longer text is a group of its own."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < chars):
            size += len(texts[end])
            end += 1
        yield texts[start:end]
        start = end


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns that ``df`` has none of, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        k = 0
        while (name := f"__{w}{k or ''}").lower() in taken:
            k += 1
        taken.add(name.lower())
        out.append(name)
    return out
