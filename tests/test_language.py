"""Text to tree and back."""

import pytest

from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem, tokens
from lodestone.lang.parser import parse, parse_expression
from lodestone.lang.render import render

ROUND_TRIPS = [
    "SELECT * FROM a",
    "SELECT DISTINCT a, b + 1 AS c FROM x WHERE a <> 1 AND NOT b IN {1, 2} ORDER BY a DESC NULLS FIRST, b",
    "SELECT a FROM x LEFT JOIN y ON x.k = y.k RIGHT JOIN z USING (p, q)",
    "SELECT a FROM (SELECT b FROM c WHERE d) AS e, f(@[1, *], *) & g {@1F, @2!3} AS h",
    "SELECT COUNT(*), COUNT(DISTINCT a), SUM(b) FROM x GROUP BY c, d HAVING (COUNT(*) > 1)",
    "(SELECT a FROM b) UNION ALL ((SELECT a FROM c) INTERSECT (SELECT a FROM d)) ORDER BY a",
    "SELECT CASE WHEN a THEN 1 ELSE 2 END, CAST(b AS km), EXTRACT(YEAR FROM c), TRIM(LEADING 'x' FROM d)",
    "SELECT a FROM x.p[(q > 1)]{1, 3}.r{*}.s{+}.{u, v}[:FIRST] AS z MATCH (w) AGAINST ('one two', 'three')",
    "SELECT {1, 2}, {a = 1, b = 'x'}, {1 -> 2}, [1, [2, 3]], @[1, 9], x[:LAST], y[1, 2], 5.0km, X'0aff', INTERVAL '1:30', #obj",
    "SELECT a FROM b WHERE (c SIMILAR TO /^x(y+)$/i) AND (d > ALL(e)) AND EXISTS(SELECT * FROM f) AND (g IS NOT NULL) AND (h IS A k & l(1))",
    "INSERT INTO c UNIQUE @{a = 1, b = {1, 2}}, @{a = 2}",
    "UPDATE c SET a += 1 SET b = 'x' ADD t[BEFORE 0] = 'y' DELETE u RENAME v = w MOVE t[1] BEFORE 0 WHERE (a = 1)",
    "PURGE FROM c WHERE (a = 1)",
    "WITH p = 1 SELECT a FROM b WHERE (c = :p)",
    "START TRANSACTION READ ONLY",
    "ROLLBACK ALL",
    "DROP CLASS c",
]


@pytest.mark.parametrize("text", ROUND_TRIPS)
def test_round_trip(text):
    first = parse(text)[0]
    again = parse(render(first))[0]
    assert first == again
    assert render(again) == render(first)


@pytest.mark.parametrize(
    ("text", "same"),
    [
        ("a OR b AND c", "a OR (b AND c)"),
        ("NOT a = b", "NOT (a = b)"),
        ("a + b * c - d", "(a + (b * c)) - d"),
        ("a & b + c", "a & (b + c)"),
        ("a || b + c", "a || (b + c)"),
        ("a = b < c", "a = (b < c)"),
        ("-a * b", "(-a) * b"),
        ("a BETWEEN 1 + 1 AND 2 AND c", "(a BETWEEN (1 + 1) AND 2) AND c"),
        ("a IN @[1,2] OR b", "(a IN @[1,2]) OR b"),
        ("~a & b", "(~a) & b"),
    ],
)
def test_precedence(text, same):
    assert parse_expression(text) == parse_expression(same)


def test_tokens():
    kinds = [(x.kind, x.value) for x in tokens("SELECT 'it''s' \"q c\" 1.5km 3u :x :0 @1F @self p:q /* a /* b */ c */ -- end\n <>")]
    assert kinds == [("word", "SELECT"), ("string", "it's"), ("name", "q c"), ("number", 1.5), ("number", 3), ("param", "x"), ("param", 0), ("pid", 0x1F), ("self", "self"), ("name", "q"), ("op", "<>"), ("end", "")]


def test_neighbouring_strings_are_one():
    assert parse_expression("'a' 'b'") == t.Lit("ab", "string")


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM", "SELECT a b c FROM d", "'open", "/* open", "INSERT (a, b) VALUES (1)", "UPDATE c SET a", "SELECT a FROM b WHERE"])
def test_errors(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_definitions():
    got = parse(
        """CREATE CLASS c AS SELECT * FROM e WHERE v > :0(INT,DESC,NULLS FIRST) SET onEnter=${UPDATE @self SET n=1; INSERT a=2}, window=10;
        CREATE TIMER tm INTERVAL '0:0:5' AS INSERT a = 1; CREATE ENUMERATION en AS {'A', 'B'}; CREATE ACTION ac AS {INSERT a=1};
        CREATE EVENT HANDLER h AS {WHEN c IS INSERTED|UPDATED AND v > 1 -> {INSERT a=1}}; CREATE LISTENER l ON 'localhost:1' AS {service='sockets'};
        CREATE OPTIONAL LOADER ld AS 'nothing.here'; SET PREFIX q: 'http://x'; SET TRACE ALL QUERIES ON"""
    )
    assert [type(x).__name__ for x in got] == ["Create"] * 7 + ["Setting"] * 2
    assert got[0].body.where.b == t.Param(0, "INT", "DESC", "FIRST")
    assert len(got[0].props[0][1].body) == 2
    assert got[4].body[0]["kinds"] == ["INSERTED", "UPDATED"]
