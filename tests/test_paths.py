"""Paths against plain walks: filters under repetition, cycles, diamonds, several references, depths."""

import itertools

import pytest

from lodestone.lang.parser import parse
from lodestone.lang.render import render
from lodestone.session import Session

#: id, name, next, many; a chain of ten, a cycle of three (11, 12, 13), a diamond (20 -> 21, 22 -> 23), a loop (30).
NODES = [(i, "part.b" if i % 2 else "t.x", i + 1 if i < 10 else None, None) for i in range(1, 11)]
NODES += [(11, "t.a", 12, [12]), (12, "part.b", 13, [13]), (13, "t.x", 11, [11, 20])]
NODES += [(20, "top", None, [21, 22]), (21, "left", None, [23]), (22, "right", None, [23, 99]), (23, "end", None, None), (30, "loop", 30, [30])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(NODES, "id long, name string, next long, many array<long>")


def session(spark, df, **flags):
    s = Session(spark, **flags)
    s.register("nodes", df, "id", {"next": "nodes", "many": "nodes"})
    s.execute("CREATE CLASS starts AS SELECT * FROM nodes WHERE id IN (1, 9, 11, 20, 30); CREATE CLASS odd AS SELECT * FROM nodes WHERE id % 2 = 1")
    return s


@pytest.fixture(scope="module")
def s(spark, df):
    return session(spark, df)


def walk(props, low, high, keep=lambda n: True, last=lambda n: True):
    """All ways from the starts, as the last node of each; no node twice on a way that repeats."""
    by = {n[0]: n for n in NODES}

    def out(n):
        refs = []
        if "next" in props and n[2] is not None:
            refs.append(n[2])
        if "many" in props:
            refs += n[3] or []
        return [by[r] for r in refs if r in by]

    found = []

    def go(way):
        if low <= len(way) - 1 and last(way[-1]):
            found.append((way[-1][0], len(way) - 1))
        if len(way) - 1 < high:
            for n in out(way[-1]):
                if (n not in way or low == high == 1) and keep(n):
                    go([*way, n])

    for k in (1, 9, 11, 20, 30):
        go([by[k]])
    return sorted(found)


def ids(s, q):
    return sorted(r["id"] for r in s.execute(q).collect())


@pytest.mark.parametrize("low,high,text", [(1, 1, "{1}"), (1, 2, "{1,2}"), (0, 3, "{0,3}"), (2, 4, "{2,4}"), (0, 1, "{?}"), (0, 2, "{*,2}"), (3, 9, "{3,9}")])
def test_bounded_repetition(s, low, high, text):
    for props in ("next", "many"):
        want = [n for n, _ in walk([props], low, high)]
        assert ids(s, f"SELECT id FROM starts.{props}{text} AS t") == want, (props, text)


def test_filters_under_repetition(s):
    """One before the repetition holds for all nodes on the way, one behind it for the last; names in it with dots are text."""
    good = lambda n: n[1] == "part.b"
    for low, high in ((1, 1), (1, 2), (2, 3), (0, 2)):
        rep = f"{{{low},{high}}}"
        for props in ("next", "many"):
            assert ids(s, f"SELECT id FROM starts.{props}[name = 'part.b']{rep} AS t") == [n for n, _ in walk([props], low, high, keep=good)]
            assert ids(s, f"SELECT id FROM starts.{props}{rep}[name = 'part.b'] AS t") == [n for n, _ in walk([props], low, high, last=good)]
    assert ids(s, "SELECT id FROM starts.next[name = 'part.b'] AS t") == [12]


def test_unbounded_repetition(s):
    """Each start reaches a node once; cycles and loops end."""
    for props, last in itertools.product(("next", "many"), (False, True)):
        want = set()
        for k in (1, 9, 11, 20, 30):
            for n, d in walk_from(k, props):
                if not last or NODES_BY[n][1] == "part.b":
                    want.add((k, n))
        q = f"SELECT id FROM starts.{props}{{*}}{'[name = ' + repr('part.b') + ']' if last else ''} AS t"
        assert ids(s, q) == sorted(n for _, n in want), q
    assert ids(s, "SELECT id FROM starts.many[id <> 22]{+} AS t") == sorted([12, 13, 20, 21, 23] + [21, 23])


NODES_BY = {n[0]: n for n in NODES}


def walk_from(k, props):
    seen, front, depth = {k: 0}, [k], 0
    while front:
        depth += 1
        new = []
        for n in front:
            for r in ([NODES_BY[n][2]] if props == "next" else NODES_BY[n][3] or []):
                if r in NODES_BY and r not in seen:
                    seen[r] = depth
                    new.append(r)
        front = new
    return list(seen.items())


def test_several_references_repeat(s):
    assert ids(s, "SELECT id FROM starts.{next, many}{1,2} AS t") == [n for n, _ in walk(["next", "many"], 1, 2)]
    assert ids(s, "SELECT id FROM starts.*{1,2} AS t") == [n for n, _ in walk(["next", "many"], 1, 2)]


def test_class_of_a_step(s):
    assert ids(s, "SELECT id FROM starts.next[@ IS A odd]{1,3} AS t") == [n for n, _ in walk(["next"], 1, 3, keep=lambda n: n[0] % 2 == 1)]
    assert ids(s, "SELECT id FROM starts.next{1,3}[@ IS A odd AND name = 'part.b'] AS t") == [n for n, _ in walk(["next"], 1, 3, last=lambda n: n[0] % 2 == 1 and n[1] == "part.b")]


def test_filter_follows_references(s):
    assert ids(s, "SELECT id FROM starts.next[next.name = 'part.b'] AS t") == [n for n, _ in walk(["next"], 1, 1, keep=lambda n: n[2] is not None and NODES_BY[n[2]][1] == "part.b")]


def test_elements_of_a_step(s):
    assert ids(s, "SELECT id FROM starts.many[:FIRST] AS t") == [12, 21, 30]
    assert ids(s, "SELECT id FROM starts.many[:LAST] AS t") == [12, 22, 30]
    assert ids(s, "SELECT id FROM starts.many[1] AS t") == [22]


def test_depth(spark, df):
    s = session(spark, df, path_depth=True)
    for text, low, high in (("{1,3}", 1, 3), ("{2,9}", 2, 9)):
        for props in ("next", "many"):
            got = sorted((r["id"], r["depth"]) for r in s.execute(f"SELECT id, depth FROM starts.{props}{text} AS t").collect())
            assert got == walk([props], low, high)
    got = sorted((r["id"], r["depth"]) for r in s.execute("SELECT id, depth FROM starts.next{*} AS t").collect())
    assert got == sorted(x for k in (1, 9, 11, 20, 30) for x in walk_from(k, "next"))


def test_paths_as_text():
    for q in ("SELECT id FROM a.b[(x = 1)]{1, 2} AS t", "SELECT id FROM a.b{+}[(x = 1)] AS t", "SELECT id FROM a.{b, c}{*}.d{?} AS t"):
        assert render(parse(render(parse(q)[0]))[0]) == render(parse(q)[0])
        assert parse(render(parse(q)[0]))[0] == parse(q)[0]
