"""Streams, machines, services, builder."""

import pytest
from pyspark.sql import functions as F

from lodestone import Session
from lodestone.operators import paths, windows
from lodestone.sources import services
from lodestone.streaming import machines, streams

ROWS = [(1, "a", "view", 1.0, "2024-01-01 00:00:00"), (2, "a", "buy", 200.0, "2024-01-01 00:00:10"), (3, "b", "buy", 5.0, "2024-01-01 00:00:20"), (4, "a", "view", 300.0, "2024-01-01 00:05:00"), (5, "b", "view", 7.0, "2024-01-01 00:05:10")]


@pytest.fixture()
def s(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "event_id int, user string, event_type string, value double, at string").withColumn("ts", F.to_timestamp("at").cast("timestamp"))
    for i, part in enumerate((df.where("event_id <= 2"), df.where("event_id > 2"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = Session(spark)
    out.register("events", df, "event_id")
    out.execute("""CREATE CLASS views AS SELECT * FROM events WHERE event_type = 'view'; CREATE CLASS buys AS SELECT * FROM events WHERE event_type = 'buy'; CREATE CLASS dear AS SELECT * FROM events WHERE value > 100;
        CREATE FSM shop AS {idle:{t={WHEN views IS INSERTED -> looking}}, looking:{t={WHEN buys IS INSERTED AND value > 100 -> bought}}, bought:{t={WHEN INTERVAL '0:1:0' EXPIRES -> idle}}};
        CREATE EVENT HANDLER h AS {WHEN buys IS INSERTED AND value > 100 -> {SELECT 1}, WHEN views IS INSERTED -> {SELECT 2}}""")
    return out, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), df, tmp_path


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_classes_over_a_stream(s):
    session, stream, df, tmp = s
    got = drain(streams.members(session, stream, "dear").select("event_id"), tmp, "m1")
    assert sorted(r[0] for r in got) == [2, 4]
    got = drain(streams.with_classes(session, stream, "events").select("event_id", "classes"), tmp, "m2")
    assert {r[0]: sorted(r[1]) for r in got} == {1: ["views"], 2: ["buys", "dear"], 3: ["buys"], 4: ["dear", "views"], 5: ["views"]}


def test_windows_over_a_stream(s):
    session, stream, df, tmp = s
    got = drain(streams.interval_counts(stream, "ts", "1 minute", ["user"], "0 seconds").select(F.col("w.start").cast("string"), "user", "n"), tmp, "m3", "complete")
    assert {tuple(r) for r in got} == {("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:00", "b", 1), ("2024-01-01 00:05:00", "a", 1), ("2024-01-01 00:05:00", "b", 1)}
    got = drain(streams.last_n(stream, 2, "user", "ts", "event_id"), tmp, "m4", "update")
    assert {r["user"]: list(r["values"]) for r in got}["a"] in ([2, 4], [1, 2])
    assert sorted(r["event_id"] for r in windows.last_n(df, 2, "ts").collect()) == [4, 5]
    assert sorted(r["event_id"] for r in windows.last_interval(df, 10, "ts").collect()) == [4, 5]
    assert sorted(r["event_id"] for r in windows.last_interval(df, 10, "ts", ["user"]).collect()) == [4, 5]


def test_machine(s):
    session, stream, df, tmp = s
    got = drain(machines.run_stream(session, "shop", stream, "user", "ts", "events"), tmp, "m5")
    steps = sorted((r["user"], str(r["ts"]), r["was"], r["now"]) for r in got)
    assert [x[2:] for x in steps if x[0] == "a"] == [("idle", "looking"), ("looking", "bought"), ("idle", "looking")]
    assert [x[2:] for x in steps if x[0] == "b"] == [("idle", "idle"), ("idle", "looking")]
    batch = machines.run_batch(session, "shop", df, "user", "ts", "events").collect()
    assert [(r["was"], r["now"]) for r in sorted(batch, key=lambda r: (r["user"], r["ts"])) if r["user"] == "b"] == [("idle", "idle"), ("idle", "looking")]
    got = {r["event_id"]: r["handled_by"] for r in machines.handled(session, "h", df, "events").collect()}
    assert got == {1: 1, 2: 0, 4: 1, 5: 1}


def test_services(spark, s):
    session, _, df, tmp = s
    session.execute(f"CREATE COMMUNICATION box AS {{service={{'file', 'json'}}, address='{tmp}/box', format='text', schema='event_id int, user string'}}")
    services.write(session, "box", df.select("event_id", "user"))
    assert session.execute("SELECT COUNT(*) AS n FROM box WHERE user = 'a'").first()["n"] == 3
    session.execute(f"CREATE COMMUNICATION lines AS {{service={{'file', 'regex'}}, address='{tmp}/box', format='text', pattern='\"user\":\"(.)\"', fields={{'who'}}}}")
    assert sorted(r["who"] for r in session.execute("SELECT who FROM lines").collect()) == ["a", "a", "a", "b", "b"]
    key = "0123456789abcdef"
    e = services.EncryptionService()
    secret = e.write(session, spark.createDataFrame([("hello",)], "value string"), {"key": key})
    assert e.read(session, secret, {"key": key}).first()["value"] == "hello"
    assert services.StatementService().read(session, spark.createDataFrame([("select  a from b",)], "value string"), {}).first()["value"] == "SELECT a FROM b"


def test_builder(s):
    session = s[0]
    q = session.statement()
    q.add_variable("events", "e")
    q.add_output("user", "u").add_output("COUNT(*)", "n").add_condition("value > 4").set_group("user", having="COUNT(*) > 1").set_order("u DESC")
    assert [tuple(r) for r in q.execute().collect()] == [("b", 2), ("a", 2)]
    assert q.to_text().startswith("SELECT user AS u") and q.count() == 2 and q.exist()
    assert [tuple(r) for r in type(q).from_text(session, q.to_text()).execute().collect()] == [("b", 2), ("a", 2)]
    assert "HashAggregate" in q.analyze()
    p = session.statement()
    p.add_variable("events")
    p.add_condition("value > :low")
    assert p.is_satisfied({"value": 9.0}, {"low": 5}) and not p.is_satisfied({"value": 1.0}, {"low": 5})
    left, right = session.statement(), session.statement()
    left.add_variable("events")
    right.add_variable("events", where="value > 100")
    both = session.statement().set_op(left.add_output("event_id").add_condition("value < 6"), right.add_output("event_id"), "UNION")
    assert sorted(r[0] for r in both.execute().collect()) == [1, 2, 3, 4]


def test_session_api(s):
    session = s[0]
    assert session.execute_json("SELECT event_id FROM events WHERE event_id = 1") == '[{"event_id":1}]'
    assert session.execute_json("SELECT 1 AS a; SELECT 2 AS b") == '[[{"a":1}],[{"b":2}]]'
    assert session.value_json("{1, 2}") == "[1, 2]"
    done = []
    session.execute_async("SELECT COUNT(*) AS n FROM events", lambda df, e: done.append(e or df.first()["n"])).join(60)
    assert done == [5]
    session.execute("DROP CLASS dear")
    with pytest.raises(LookupError):
        session.execute("SELECT * FROM dear")
    session.execute("CREATE ENUMERATION color AS {'RED', 'BLUE'}; SET TRACE PLANS ON")
    assert session.execute("SELECT color.RED AS c, CAST('x' AS color) AS d").first() == ("RED", None)
    assert session.plans and "Project" in session.plans[0]


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (None, 1), (6, None)], "src long, dst long")
    got = {(r["start"], r["node"]): r["depth"] for r in paths.closure(edges, spark.createDataFrame([(1,), (5,), (9,), (None,)], "start long")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (5, 5): 0, (5, 6): 1, (9, 9): 0}
    got = {(r["start"], r["node"]) for r in paths.closure(edges, spark.createDataFrame([(1,)], "start long"), 2).collect()}
    assert got == {(1, 3), (1, 4)}
    assert paths.closure(edges, spark.createDataFrame([], "start long")).count() == 0


def test_machine_of_a_hot_key_spans_tasks(spark, s):
    """One user has nearly all events; their order over tasks gives the steps of a plain loop."""
    import random

    r = random.Random(2)
    rows = [(i, "hot" if r.random() < 0.9 else f"u{r.randrange(5)}", r.choice(["view", "buy", "other"]), float(r.randrange(300)), f"2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}") for i in range(3000)]
    rows += [(3000, None, "view", 1.0, "2024-01-01 10:00:00"), (3001, None, "buy", 200.0, "2024-01-01 10:00:01")]
    df = spark.createDataFrame(rows, "event_id int, user string, event_type string, value double, at string").withColumn("ts", F.to_timestamp("at")).repartition(4)
    session = s[0]
    session.execute("""CREATE CLASS others AS SELECT * FROM events WHERE event_type = 'other';
        CREATE FSM three AS {a:{t={WHEN views IS INSERTED -> b}}, b:{t={WHEN buys IS INSERTED AND value > 100 -> c, WHEN others IS INSERTED -> a}}, c:{t={WHEN views IS INSERTED -> a}}}""")
    got = machines.run_batch(session, "three", df, "user", "ts", "events")
    assert set(df.columns) <= set(got.columns)
    at, want = {}, {}
    for i, user, kind, value, _ in rows:
        was = at.get(user, "a")
        now = {("a", "view"): "b", ("b", "other"): "a", ("c", "view"): "a"}.get((was, kind), was)
        now = "c" if was == "b" and kind == "buy" and value > 100 else now
        at[user], want[i] = now, (was, now)
    assert {x["event_id"]: (x["was"], x["now"]) for x in got.collect()} == want
    assert machines.run_batch(session, "three", df.limit(0), "user", "ts", "events").count() == 0


def test_actions_of_machines_handlers_and_listeners(spark, s):
    from lodestone.sources.store import Store

    session, stream, df, tmp = s
    session.store = Store(spark, f"file://{tmp}/store")
    session.store.attach(session)
    session.execute("""CREATE FSM note AS {idle:{t={WHEN views IS INSERTED -> looking}}, looking:{t={WHEN buys IS INSERTED -> {INSERT INTO seen (what, how) VALUES (@self.event_id, 'machine')} -> idle}}};
        CREATE EVENT HANDLER n AS {WHEN buys IS INSERTED -> {INSERT INTO seen (what, how) VALUES (@self.event_id, 'handler')}}""")
    with pytest.raises(RuntimeError):
        machines.start_machine(session, "note", stream, "user", "ts", "events", f"{tmp}/c0")
    session.execute("START note")
    machines.start_machine(session, "note", stream, "user", "ts", "events", f"{tmp}/c1").awaitTermination()
    seen = lambda: sorted((r["how"], r["what"]) for r in session.execute("SELECT what, how FROM seen").collect())
    assert seen() == [("machine", 2)]
    machines.start_machine(session, "note", stream, "user", "ts", "events", f"{tmp}/c1").awaitTermination()  # goes on where it was
    assert seen() == [("machine", 2)]
    machines.handle(session, "n", df, "events")
    assert seen() == [("handler", 2), ("handler", 3), ("machine", 2)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    session.execute(f"CREATE LISTENER ear ON '{tmp}/in' AS {{service='file', format='parquet', stream=TRUE, file_schema='{schema}'}}")
    machines.start_listener(session, "ear", "n", "events", f"{tmp}/c2").awaitTermination()
    assert seen() == [("handler", 2)] * 2 + [("handler", 3)] * 2 + [("machine", 2)]
    with pytest.raises(LookupError):
        session.execute("START nothing")


def test_json_results(s):
    session = s[0]
    assert sorted(r["value"] for r in session.json("SELECT event_id FROM events WHERE event_id < 3").collect()) == ['{"event_id":1}', '{"event_id":2}']
    assert session.execute_json("SELECT event_id FROM events WHERE event_id < 3 ORDER BY event_id", most=2) == '[{"event_id":1},{"event_id":2}]'
    with pytest.raises(ValueError):
        session.execute_json("SELECT event_id FROM events", most=4)


def test_text_index_answers_match(spark):
    texts = ["The ringing bells", "a bell rang", "nothing here", "bells and whistles", None, "ring the bell", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for flags in ({}, {"all_words": True}, {"filter_stop_words": True}):
        s = Session(spark, **flags)
        s.register("d", df, "id")
        asked = ["'ring bell'", "'bells', 'ringing'", "'\"ring the bell\"'", "'the'", "'nothing'", "'whistle'"]
        plain = [sorted(r["id"] for r in s.execute(f"SELECT id FROM d MATCH (t) AGAINST ({q})").collect()) for q in asked]
        assert "w.word" not in s.sql("SELECT id FROM d MATCH (t) AGAINST ('ring')")
        s.index_text("d", "t")
        assert "w.word" in s.sql("SELECT id FROM d MATCH (t) AGAINST ('ring')")
        assert [sorted(r["id"] for r in s.execute(f"SELECT id FROM d MATCH (t) AGAINST ({q})").collect()) for q in asked] == plain
        s.register("d", df.where("id < 3"), "id")  # another table has no index yet
        assert "w.word" not in s.sql("SELECT id FROM d MATCH (t) AGAINST ('ring')")


def test_timers_stop_when_dropped(spark, s):
    import time

    session, _, _, tmp = s
    ticks = []
    session.register_function("tick", lambda x: x, "bigint")
    session.execute("CREATE TIMER t INTERVAL '0:0:1' AS ${SELECT 1}")
    run = session.run
    session.run = lambda x, *a: (ticks.append(x), run(x, *a))[1]
    q = streams.start_timer(session, "t", checkpoint=f"{tmp}/timer")
    end = time.time() + 40
    while not ticks and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert ticks and (tmp / "timer" / "offsets").exists()
