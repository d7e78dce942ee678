"""Streams: classes, windows and timers over Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.resolve import Rel, Resolver, Scope
from lodestone.sources.catalog import fresh


def members(session, stream: DataFrame, cls: str, *args) -> DataFrame:
    """The rows of a stream that belong to a class over the table the stream stands for."""
    view = fresh("s")
    stream.createOrReplaceTempView(view)
    root = session.catalog.root(cls).name
    rel = Rel("x", stream.schema, None, {}, {}, root)
    r = Resolver(session, Scope(session, [rel], f"{view} AS x"), session.planner.query)
    return session.spark.sql(f"SELECT x.* FROM {view} AS x WHERE {r.member(rel, cls, [session.as_node(a) for a in args])}")


def with_classes(session, stream: DataFrame, table: str) -> DataFrame:
    """A stream with ``classes``: the names of all plain classes that a row belongs to, in one projection."""
    view = fresh("s")
    stream.createOrReplaceTempView(view)
    rel = Rel("x", stream.schema, None, {}, {}, table)
    r = Resolver(session, Scope(session, [rel], f"{view} AS x"), session.planner.query)
    from lodestone.lang import tree as t

    return session.spark.sql(f"SELECT x.*, {r.value(t.Call('DATAEVENTS', [t.Self('row')])).sql} AS classes FROM {view} AS x")


def interval_counts(stream: DataFrame, ts: str, window: str, by: list[str], late: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Counts in windows of event time; rows later than ``late`` behind the newest are dropped, as watermarks need."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))


def last_n(stream: DataFrame, n: int, key: str, ts: str, value: str) -> DataFrame:
    """(key, values): after each micro-batch, the last n values of every key that had rows in it, oldest first."""
    ktype, vtype = stream.schema[key].dataType.simpleString(), stream.schema[value].dataType.simpleString()
    rows = stream.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(value).alias("v"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        us, vs = state.get if state.exists else ([], [])
        pairs = list(zip(us, vs, strict=True))
        for p in parts:
            pairs = sorted([*pairs, *zip(p["us"].tolist(), p["v"].tolist(), strict=True)], key=lambda x: x[0])[-n:]
        state.update(([a for a, _ in pairs], [b for _, b in pairs]))
        yield pd.DataFrame({"k": [k[0]], "values": [[b for _, b in pairs]]})

    out = rows.groupBy("k").applyInPandasWithState(step, f"k {ktype}, values array<{vtype}>", f"us array<long>, vs array<{vtype}>", "update", "NoTimeout")
    return out.withColumnRenamed("k", key)


def start_timer(session, name: str, on_error: Callable[[Exception], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a declared timer: its statements run once for each interval. With a checkpoint folder it goes on after a restart where it was, and a tick
    whose statements did not end runs again. A dropped timer's statements no longer run."""
    from lodestone.streaming.machines import _seconds

    timers = session.catalog.others["TIMER"]
    c = timers[name.lower()]
    ticks = session.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_rows: DataFrame, _epoch: int) -> None:
        if timers.get(name.lower()) is not c:
            return
        for s in c.body:
            try:
                session.run(s)
            except Exception as e:
                if on_error is None:
                    raise
                on_error(e)

    out = ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{_seconds(c.extra['interval'].value)} seconds")
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def on_members(session, stream: DataFrame, cls: str, f: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Calls ``f(rows, batch)`` with the rows of each micro-batch that belong to a class."""
    return members(session, stream, cls).writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
