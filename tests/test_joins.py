"""Plans of joins by collections and of positions in groups, and their results where elements repeat or groups tie."""

import pytest

from lodestone.session import Session


@pytest.fixture(scope="module")
def s(spark):
    out = Session(spark)
    out.register("a", spark.createDataFrame([(1, [1, 2, 2]), (2, [3]), (3, []), (4, None), (5, [9, None])], "id int, ks array<int>"), "id")
    out.register("b", spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (7, "w")], "k int, name string"))
    out.register("t", spark.createDataFrame([(1, "g", 5), (2, "g", 9), (3, "g", 9), (4, "h", None), (5, "h", 1), (6, None, 2)], "id int, g string, v int"), "id")
    return out


def rows(s, q):
    return sorted(tuple(r) for r in s.execute(q).collect())


def test_elements_are_join_keys(s):
    q = "SELECT a.id AS id, name FROM a JOIN b ON a.ks = k"
    assert rows(s, q) == [(1, "x"), (1, "y"), (1, "z")]
    assert rows(s, "SELECT a.id AS id, name FROM b JOIN a ON k = a.ks") == [(1, "x"), (1, "y"), (1, "z")]
    assert rows(s, "SELECT name FROM b SEMI JOIN a ON k = a.ks") == [("x",), ("y",), ("z",)]
    assert rows(s, "SELECT name FROM b ANTI JOIN a ON k = a.ks") == [("w",)]
    got = s.execute("SELECT name, a.id AS id FROM b LEFT JOIN a ON k = a.ks").collect()
    assert sorted((r["name"], r["id"]) for r in got if r["id"]) == [("x", 1), ("y", 1), ("z", 1)] and [r["name"] for r in got if r["id"] is None] == ["w"]
    assert len(s.execute("SELECT a.id AS id, name FROM a LEFT JOIN b ON a.ks = k").collect()) == 7
    for plan in (s.analyze(q), s.analyze("SELECT name FROM b SEMI JOIN a ON k = a.ks")):
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Generate" in plan


def test_positions_without_ordering_groups(s):
    q = "SELECT g, ARGMIN(v) AS lo, ARGMAX(v) AS hi, COUNT(*) AS n FROM t GROUP BY g"
    assert {tuple(r) for r in s.execute(q).collect()} == {("g", 0, 1, 3), ("h", 1, 1, 2), (None, 0, 0, 1)}
    assert rows(s, "SELECT ARGMAX(v) AS hi FROM t") == [(1,)]
    assert rows(s, "SELECT g FROM (SELECT g, ARGMAX(v) AS hi FROM t GROUP BY g HAVING ARGMAX(v) = 1) AS x WHERE g = 'g'") == [("g",)]
    assert rows(s, "SELECT ARGMAX(v) AS hi FROM t WHERE id > 100") == [(None,)]
    for plan in (s.analyze(q), s.analyze("SELECT ARGMAX(v) AS hi FROM t")):
        assert "Window" not in plan


def test_whole_store_has_tables_without_keys(s):
    assert rows(s, "SELECT class_name, COUNT(*) AS n FROM * GROUP BY class_name") == [("a", 5), ("b", 4), ("t", 6)]
    assert rows(s, "SELECT pin_id FROM * WHERE class_name = 'b'") == [(None,)] * 4


def test_shifts(s):
    assert s.execute("SELECT 5 << 40 AS a, 1 << 31 AS b, 1 << -1 AS c, 16 >> 2 AS d, -1 >>> 28 AS e").first() == (5 << 40, 1 << 31, 0, 4, 15)
