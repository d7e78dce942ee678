"""State machines and event handlers.

Which transitions an event can take in each state is worked out by Spark: one expression gives the number of the first
transition that fits, for every state. What remains is to follow these numbers in order, key by key, with the state kept by
Structured Streaming.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.lang import tree as t
from lodestone.operators.paths import checkpoint_dir
from lodestone.plans.resolve import Rel, Resolver, Scope
from lodestone.sources.catalog import fresh, shared_dir


@dataclass
class Transition:
    what: str | None
    kinds: list[str]
    condition: t.Node | None
    actions: list[t.Node]
    next: str | None
    seconds: float | None = None


def _seconds(text: str) -> float:
    parts = [float(x) for x in text.lstrip("-").split(":")]
    return sum(x * f for x, f in zip(parts, (3600, 60, 1), strict=False))


def machine(c: t.Create) -> dict[str, list[Transition]]:
    """States with their transitions; the first state is where a machine starts."""
    out: dict[str, list[Transition]] = {}
    for state, body in c.body.items():
        out[state] = []
        for whens in body.values():
            if isinstance(whens, list):
                out[state] += [Transition(w["what"], w["kinds"], w["and"], w["actions"], w["next"], _seconds(w["interval"].value) if w["interval"] is not None else None) for w in whens]
    return out


def _test(session, rel: Rel, scope: Scope, tr: Transition, kind: str | None) -> str:
    r = Resolver(session, scope, session.planner.query)
    parts = []
    if tr.what and tr.what != "*":
        parts.append(f"coalesce({r.member(rel, tr.what)}, FALSE)")
    if tr.kinds and kind and rel.column(kind):
        parts.append(f"upper({rel.alias}.`{kind}`) IN ({', '.join(repr(k) for k in tr.kinds)})")
    if tr.condition is not None:
        parts.append(f"coalesce({r.condition(tr.condition)}, FALSE)")
    return " AND ".join(parts) or "TRUE"


def labelled(session, states: dict[str, list[Transition]], events: DataFrame, table: str, kind: str | None = None) -> DataFrame:
    """``events`` with ``fits``: for each state in order, the number of the first transition that fits, or -1."""
    view = fresh("e")
    events.createOrReplaceTempView(view)
    rel = Rel("x", events.schema, None, {}, {}, table)
    scope = Scope(session, [rel], f"{view} AS x")
    cols = []
    for trs in states.values():
        whens = "".join(f" WHEN {_test(session, rel, scope, tr, kind)} THEN {i}" for i, tr in enumerate(trs) if tr.seconds is None)
        cols.append(f"CASE{whens} ELSE -1 END" if whens else "-1")
    return session.spark.sql(f"SELECT x.*, array({', '.join(cols)}) AS fits FROM {view} AS x")


def follow(states: dict[str, list[Transition]], start: int, since: float | None, rows: list[tuple[float, list[int]]]) -> tuple[int, float | None, list[tuple[int, int, int]]]:
    """(state, since, [(from, to, transition)] of each row) after rows in order; ``since``: when the state was entered, in seconds.

    A transition by an interval is taken before the first row that comes later than it. The transition is -1 where none fits.
    """
    names = list(states)
    at, steps = start, []
    for ts, fits in rows:
        for _ in names:
            timed = next((tr for tr in states[names[at]] if tr.seconds is not None and since is not None and ts - since >= tr.seconds), None)
            if timed is None or timed.next is None:
                break
            at, since = names.index(timed.next), since + timed.seconds
        was = at
        n = fits[at]
        if n >= 0 and states[names[at]][n].next is not None:
            at, since = names.index(states[names[at]][n].next), ts
        elif since is None:
            since = ts
        steps.append((was, at, n))
    return at, since, steps


def _plain(states: dict[str, list[Transition]]) -> dict[str, list[Transition]]:
    """The transitions without their trees, for the executors."""
    return {s: [Transition(None, [], None, [], tr.next, tr.seconds) for tr in trs] for s, trs in states.items()}


def _known(session, name: str) -> dict[str, list[Transition]]:
    if name.lower() not in session.catalog.others.get("FSM", {}):
        raise LookupError(f"no machine {name}")
    return machine(session.catalog.others["FSM"][name.lower()])


def run_stream(session, name: str, events: DataFrame, key: str, ts: str, table: str, kind: str | None = None) -> DataFrame:
    """The events of a streaming DataFrame with ``was``, ``now`` and ``taken``: the machine's steps, a machine for each key.

    ``taken`` is the number of the transition in its state, or -1. The state of a key is two numbers, kept by the state store; events of a
    micro-batch are taken in order of time.
    """
    states = _known(session, name)
    names = list(states)
    rows = labelled(session, states, events, table, kind)
    rows = rows.select(F.col(key).alias("__k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"), F.col("fits").alias("__fits"), *[F.col(f"`{c}`") for c in events.columns])
    plain, cols = _plain(states), events.columns

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, since = state.get if state.exists else (0, None)
        every = pd.concat(list(parts), ignore_index=True).sort_values("__us", kind="stable")
        at, since, steps = follow(plain, at, since, [(us / 1e6, list(f)) for us, f in zip(every["__us"], every["__fits"], strict=True)])
        state.update((at, since))
        yield every[cols].assign(was=[names[a] for a, _, _ in steps], now=[names[b] for _, b, _ in steps], taken=[n for _, _, n in steps])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return rows.groupBy("__k").applyInPandasWithState(step, f"{kinds}, was string, now string, taken int", "at int, since double", "append", "NoTimeout")


def run_batch(session, name: str, events: DataFrame, key: str, ts: str, table: str, kind: str | None = None) -> DataFrame:
    """The same over a table; timed transitions need the stream.

    Events are put in order over all tasks, so a key's events may lie in several. Each task folds what it has of a key into a map of states, from where
    a machine might come in to where it would go out; these maps, one for each key and task, are composed in turn, and each
    task follows its events from the state that comes out. No key has to fit into a task.
    """
    states = _known(session, name)
    names, cols = list(states), events.columns
    checkpoint_dir(session.spark)
    rows = labelled(session, states, events, table, kind).select(F.col(key).alias("__k"), F.col(ts).alias("__ts"), F.col("fits").alias("__fits"), *[F.col(f"`{c}`") for c in cols])
    order = ["__k", "__ts", "__fits", "__tie"]
    rows = rows.withColumn("__tie", F.xxhash64(*[F.col(f"`{f.name}`") for f in events.schema if f.dataType.typeName() not in ("map", "variant")]))
    rows = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()).checkpoint()
    nexts = [[names.index(tr.next) if tr.next else i for tr in trs] for i, trs in enumerate(states.values())]
    start = list(range(len(names)))
    step = lambda at, fits: nexts[at][fits[at]] if fits[at] >= 0 else at
    ktype = rows.schema["__k"].dataType.simpleString()

    def fold(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, ends = None, None, None
        for b in blocks:
            done = []
            for k, p, fits in zip(b["__k"].tolist(), b["__part"].tolist(), b["__fits"], strict=True):
                if ends is None or (p, k) != (part, now) and not (p == part and k != k and now != now):
                    if ends is not None:
                        done.append((now, part, ends))
                    now, part, ends = k, p, start
                ends = [step(x, fits) for x in ends]
            yield pd.DataFrame(done, columns=["k", "part", "ends"])
        if ends is not None:
            yield pd.DataFrame([(now, part, ends)], columns=["k", "part", "ends"])

    ordered = rows.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    maps = ordered.select("__k", "__part", "__fits").mapInPandas(fold, f"k {ktype}, part int, ends array<int>")
    # As many maps for each key as tasks that its events lie in.
    chain = maps.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("m"))
    begins = F.expr("aggregate(m, named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<part: INT, at: INT>>)), (a, x) -> named_struct('at', x.ends[a.at], 'out', concat(a.out, array(named_struct('part', x.part, 'at', a.at)))), a -> a.out)")
    chain = chain.select("k", F.explode(begins).alias("b")).select("k", F.col("b.part").alias("part"), F.col("b.at").alias("__at")).checkpoint()
    placed = rows.join(chain, rows["__k"].eqNullSafe(chain["k"]) & (rows["__part"] == chain["part"])).drop("k", "part")
    placed = placed.repartition("__part", "__k").sortWithinPartitions("__part", *[F.col(c).asc_nulls_first() for c in order])

    def walk(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, 0
        for b in blocks:
            was, to, taken = [], [], []
            for k, p, begin, fits in zip(b["__k"].tolist(), b["__part"].tolist(), b["__at"].tolist(), b["__fits"], strict=True):
                if now is None or (p, k) != now and not (p == now[0] and k != k and now[1] != now[1]):
                    now, at = (p, k), begin
                n = fits[at]
                was.append(names[at])
                at = step(at, fits)
                to.append(names[at])
                taken.append(int(n))
            yield b[cols].assign(was=was, now=to, taken=taken)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return placed.mapInPandas(walk, f"{kinds}, was string, now string, taken int")


def run_actions(session, name: str, steps: DataFrame, table: str) -> None:
    """Runs the actions of the transitions in ``steps``, which run_batch() or a batch of run_stream() made: each as one statement for all events that took it."""
    states = _known(session, name)
    _act(session, steps, table, [(f"was = '{s}' AND taken = {i}", tr.actions) for s, trs in states.items() for i, tr in enumerate(trs) if tr.actions], ["was", "now", "taken"])


def _act(session, rows: DataFrame, table: str, work: list[tuple[str, list[t.Node]]], made: list[str]) -> None:
    from lodestone.streaming.events import act

    store, names = session.store, set()
    if store is None:
        raise RuntimeError("actions need a store to change")
    store._begin()
    try:
        for where, actions in work:
            hit = rows.where(where).drop(*made)
            if not hit.isEmpty():
                for action in actions:
                    act(session, store, table, action, hit, names)
    except Exception:
        store._undo()
        raise
    store._end(sorted(names))


@contextlib.contextmanager
def _staged(session, rows: DataFrame) -> Iterator[DataFrame]:
    """A micro-batch as a table of the session itself, written once, so that all its actions see the same rows."""
    path = f"{shared_dir(session.spark)}/batch-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield session.spark.read.schema(rows.schema).parquet(path)
    finally:
        session.store.files.remove(path)


def start_machine(session, name: str, events: DataFrame, key: str, ts: str, table: str, checkpoint: str, kind: str | None = None, **trigger) -> StreamingQuery:
    """Lets a machine that START has started follow a stream, and runs its actions after each micro-batch. The checkpoint keeps its states over restarts."""
    c = session.catalog.others.get("FSM", {}).get(name.lower())
    if c is None or not c.extra.get("started"):
        raise RuntimeError(f"the machine {name} is not started")
    steps = run_stream(session, name, events, key, ts, table, kind)

    def batch(rows: DataFrame, _number: int) -> None:
        with _staged(session, rows) as own:
            run_actions(session, name, own, table)

    return steps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _whens(session, name: str) -> list[Transition]:
    whens = session.catalog.others["HANDLER"][name.lower()].body
    return [Transition(w["what"], w["kinds"], w["and"], w["actions"], w["next"], _seconds(w["interval"].value) if w["interval"] is not None else None) for w in whens]


def handled(session, name: str, events: DataFrame, table: str, kind: str | None = None) -> DataFrame:
    """``events`` with ``handled_by``: the number of the first WHEN of an event handler that fits; others go."""
    out = labelled(session, {"h": _whens(session, name)}, events, table, kind)
    return out.withColumn("handled_by", F.col("fits")[0]).drop("fits").where("handled_by >= 0")


def handle(session, name: str, events: DataFrame, table: str, kind: str | None = None) -> DataFrame:
    """Runs the actions of an event handler for the events that it handles, each action as one statement; gives what handled() gives."""
    checkpoint_dir(session.spark)
    rows = handled(session, name, events, table, kind).checkpoint()
    _act(session, rows, table, [(f"handled_by = {i}", tr.actions) for i, tr in enumerate(_whens(session, name)) if tr.actions], ["handled_by"])
    return rows


def start_listener(session, listener: str, handler: str, table: str, checkpoint: str, kind: str | None = None, **trigger) -> StreamingQuery:
    """Runs an event handler's actions for what a listener (or communication object) with a streaming source receives."""
    from lodestone.sources import services

    def batch(rows: DataFrame, _number: int) -> None:
        with _staged(session, rows) as own:
            handle(session, handler, own, table, kind)

    return services.read(session, listener).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
