"""Changes, transactions, actions and parts."""

import pytest

from lodestone import Session
from lodestone.sources.store import Batch, Conflict, Store
from lodestone.streaming.events import listen


@pytest.fixture()
def s(spark, tmp_path):
    out = Session(spark, Store(spark, f"file://{tmp_path}/store"))
    out.execute("INSERT INTO person (name, age) VALUES ('ann', 30), ('bob', 17), ('cy', 45)")
    return out


def names(s, q="SELECT name FROM person"):
    return sorted(r[0] for r in s.execute(q).collect())


def test_insert_update_delete(spark, s):
    assert names(s) == ["ann", "bob", "cy"]
    assert s.execute("UPDATE person SET age += 1, note = 'n' || name WHERE age > 20").first()["n"] == 2
    assert [tuple(r) for r in s.execute("SELECT name, age, note FROM person ORDER BY name").collect()] == [("ann", 31, "nann"), ("bob", 17, None), ("cy", 46, "ncy")]
    s.execute("UPDATE person RENAME note = remark; UPDATE person DELETE age WHERE name = 'cy'")
    assert s.execute("SELECT remark, note, age FROM person WHERE name = 'cy'").first() == ("ncy", None, None)
    s.execute("DELETE FROM person WHERE name = 'ann'")
    assert names(s) == ["bob", "cy"]
    s.execute("UNDELETE FROM person WHERE name = 'ann'; PURGE FROM person WHERE name = 'bob'")
    assert names(s) == ["ann", "cy"]
    s.store.compact("person")
    again = Session(spark, Store(spark, s.store.path))
    assert names(again) == ["ann", "cy"]
    assert again.store.manifest["tables"]["person"]["dels"] == []


def test_collections_change_in_place(s):
    s.execute("UPDATE person SET tags = {'a', 'b', 'c'} WHERE name = 'ann'")
    tags = lambda: list(s.execute("SELECT tags FROM person WHERE name = 'ann'").first()[0])
    s.execute("UPDATE person ADD tags = 'd' WHERE name = 'ann'")
    assert tags() == ["a", "b", "c", "d"]
    s.execute("UPDATE person MOVE tags[3] BEFORE 0 DELETE tags[2] SET tags[:LAST] = 'z' WHERE name = 'ann'")
    assert tags() == ["d", "a", "z"]


def test_transactions(spark, s):
    s.execute("START TRANSACTION; DELETE FROM person WHERE name = 'ann'; START TRANSACTION; DELETE FROM person WHERE name = 'bob'")
    assert names(s) == ["cy"]
    assert names(Session(spark, Store(spark, s.store.path))) == ["ann", "bob", "cy"]  # others see what is committed
    s.execute("ROLLBACK")
    assert names(s) == ["bob", "cy"]
    s.execute("COMMIT")
    assert names(Session(spark, Store(spark, s.store.path))) == ["bob", "cy"]
    s.execute("START TRANSACTION READ ONLY")
    with pytest.raises(PermissionError):
        s.execute("DELETE FROM person WHERE name = 'bob'")
    s.execute("ROLLBACK ALL")


def test_conflicts(spark, s):
    other = Session(spark, Store(spark, s.store.path))
    s.execute("UPDATE person SET age = 1 WHERE name = 'ann'")
    with pytest.raises(Conflict):
        other.execute("UPDATE person SET age = 2 WHERE name = 'bob'")
    with pytest.raises(Conflict):
        s.execute("INSERT INTO person UNIQUE (name, age) VALUES ('bob', 17)")
    s.execute("INSERT INTO person IDEMPOTENT (name, age) VALUES ('bob', 17), ('new', 1)")
    assert names(s) == ["ann", "bob", "cy", "new"]
    row = s.execute("SELECT pin_id, stamp FROM person WHERE name = 'cy'").first()
    s.store.modify("person", row["pin_id"], {"age": 46}, row["stamp"])
    with pytest.raises(Conflict):
        s.store.modify("person", row["pin_id"], {"age": 47}, row["stamp"])


def test_parts_go_with_their_whole(s):
    s.execute("INSERT INTO person @{name='dad', kids=(INSERT PART INTO person @{name='k1'}, @{name='k2'})}; INSERT INTO person @:1 @{name='x', friend=@:2}, @:2 @{name='y', friend=@:1}")
    got = {r["name"]: r for r in s.execute("SELECT name, pin_id, parent_id, kids, friend FROM person").collect()}
    assert list(got["dad"]["kids"]) == [got["k1"]["pin_id"], got["k2"]["pin_id"]] and got["k1"]["parent_id"] == got["dad"]["pin_id"]
    assert got["x"]["friend"] == got["y"]["pin_id"] and got["y"]["friend"] == got["x"]["pin_id"]
    s.execute("DELETE FROM person WHERE name = 'dad'")
    assert names(s) == ["ann", "bob", "cy", "x", "y"]


def test_actions_and_listeners(s):
    seen = []
    s.execute("""CREATE CLASS adult AS SELECT * FROM person WHERE age >= 18 SET onEnter=${UPDATE @self SET note='hi'}, onLeave=${INSERT INTO log (what) VALUES (@self.name)};
        CREATE CLASS changed AS SELECT * FROM person WHERE ISCHANGED(age)""")
    listen(s, lambda kind, rows: seen.append((kind, sorted(r["name"] for r in rows.select("name").collect()))), "adult")
    s.execute("UPDATE person SET age = 20 WHERE name = 'bob'")
    assert s.execute("SELECT note FROM person WHERE name = 'bob'").first()[0] == "hi"
    s.execute("DELETE FROM person WHERE name = 'cy'")
    assert names(s, "SELECT what FROM log") == ["cy"]
    assert ("enter", ["bob"]) in seen and ("leave", ["cy"]) in seen
    with pytest.raises(Conflict):
        s.execute("INSERT INTO adult (name, age) VALUES ('kid', 3)")
    assert "kid" not in names(s)


def test_endless_actions_stop(s):
    s.execute("CREATE CLASS any AS SELECT * FROM loop WHERE n > 0 SET onEnter=${INSERT INTO loop (n) VALUES (@self.n + 1)}")
    s.store.depth = 14  # as if deep inside already
    with pytest.raises(RecursionError):
        s.execute("INSERT INTO loop (n) VALUES (1)")


def test_batches_and_access(spark, s):
    assert Batch(s, "person").add(name="dee", age=5).add(name="eve", age=6).run() == 2
    assert "eve" in names(s)
    df = spark.createDataFrame([(1, "pub", None), (2, "mine", [("guest", "r")]), (3, "other", [("someone", "rw")])], "id int, t string, _acl array<struct<who: string, mode: string>>")
    guest = Session(spark, identity="guest")
    guest.register("docs", df, "id")
    assert [r["t"] for r in guest.execute("SELECT t FROM docs ORDER BY id").collect()] == ["pub", "mine"]


def test_raw_windows_copies_and_messages(spark, s):
    s.execute("DELETE FROM person WHERE name = 'ann'")
    assert names(s, "SELECT RAW name FROM person") == ["ann", "bob", "cy"] and names(s) == ["bob", "cy"]
    s.execute("CREATE CLASS newest AS SELECT * FROM person WHERE age > 0 ORDER BY age SET window=1")
    assert names(s, "SELECT name FROM newest") == ["cy"]
    s.execute("CREATE CLASS recent AS SELECT * FROM person ORDER BY created SET window=INTERVAL '1:00:00'; CREATE CLASS old AS SELECT * FROM person ORDER BY created SET window=INTERVAL '-100000:00:00'")
    assert names(s, "SELECT name FROM recent") == ["bob", "cy"] == names(s, "SELECT name FROM old")
    s.execute("CREATE CLASS minor AS SELECT * FROM person WHERE age = 7 SET onEnter=${INSERT @self, @{age = 8}}")
    s.execute("INSERT INTO person (name, age) VALUES ('kid', 7)")
    assert [r["age"] for r in s.execute("SELECT age FROM person WHERE name = 'kid' ORDER BY age").collect()] == [7, 8]
    s.execute("CREATE CLASS bell AS SELECT * FROM person WHERE name = 'ring' SET onEnter=${INSERT INTO log (what) VALUES (@self.name)}")
    s.inject("person", name="ring", age=1)
    assert names(s, "SELECT what FROM log") == ["ring"] and "ring" not in names(s)


def test_stores_by_statement(spark, tmp_path):
    s = Session(spark)
    s.execute(f"CREATE STORE AS {{path='file://{tmp_path}/a', name='one'}}; INSERT INTO x (v) VALUES (1)")
    assert s.execute("SELECT CURRENT_STORE AS n, v FROM x").first() == ("one", 1)
    s.execute("CLOSE STORE")
    with pytest.raises(RuntimeError):
        s.execute("INSERT INTO x (v) VALUES (1)")
    s.execute(f"OPEN STORE 'file://{tmp_path}/a'")
    moved = s.store.move(f"file://{tmp_path}/b")
    assert Session(spark, Store(spark, moved.path)).execute("SELECT v FROM x").first()["v"] == 1
    assert s.execute("SELECT COUNT(*) AS n FROM services").first()["n"] > 5


def test_statement_service_reads_every_text(spark):
    from lodestone import Session
    from lodestone.sources.services import StatementService

    rows = spark.range(1500).selectExpr("concat('SELECT a FROM t WHERE b = ', id, IF(id = 7, '; SELECT c FROM u', '')) AS value")
    got = [x["value"] for x in StatementService().read(Session(spark), rows, {}).collect()]
    assert len(got) == 1501 and len(set(got)) == 1501
    assert StatementService().read(Session(spark), rows, {"most": 3}).count() in (3, 4)
    assert StatementService().read(Session(spark), rows.limit(0), {}).count() == 0
