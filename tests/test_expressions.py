"""Every operator and function on constants, missing values and collections."""

import datetime
import math

import pytest

from lodestone import Session
from lodestone.functions import units
from lodestone.functions.text import STOP_WORDS, stem, words
from lodestone.lang.lexer import SyntaxProblem
from lodestone.sources.catalog import Unknown


@pytest.fixture(scope="module")
def s(spark):
    out = Session(spark)
    rows = [(1, 10, 5, "ab", [1, 2, 3], ["x", "y"]), (2, None, 5, "AB", [4], None), (3, 10, None, None, [], ["y"]), (4, None, None, "b", None, [])]
    out.register("t", spark.createDataFrame(rows, "id int, a int, b int, s string, nums array<int>, tags array<string>"), "id")
    return out


def ids(s, cond):
    return sorted(r["id"] for r in s.execute(f"SELECT id FROM t WHERE {cond}").collect())


# Constants: one row, checked together so that one job does for many.
CONSTANTS = {
    "7 / 2": 3, "7.0 / 2": 3.5, "-7 % 3": -1, "2 + 3 * 4": 14, "ABS(-3)": 3, "-(5)": -5,
    "6 & 3": 2, "6 | 3": 7, "6 ^ 3": 5, "~6": -7, "1 << 4": 16, "16 >> 2": 4, "1 << -1": 0, "-1 >>> 28": 15, "SETBIT(0, 3)": 8, "RESETBIT(15, 0)": 14, "TESTBIT(5, 2)": True, "BITFIELD(44, 2, 2)": 3,
    "MIN(3, 1, 2)": 1, "MAX(3, 1, 2)": 3, "ARGMIN(3, 1, 2)": 1, "ARGMAX(3, 1, 2)": 0, "SUM(1, 2, 3)": 6, "COUNT(1, 2)": None, "AVG(1, 2)": 1.5,
    "EXP(0)": 1.0, "POWER(2, 10)": 1024.0, "SQRT(9)": 3.0, "SQRT(-1)": None, "ASIN(2)": None, "LN(1)": 0.0, "FLOOR(2.7)": 2.0, "CEIL(2.1)": 3.0, "FLOOR(5)": 5, "ATAN(0, 1)": 0.0,
    "'a' || 'b' || 1": "ab1", "CONCAT('a', 1, 'c')": "a1c", "LENGTH('é')": 2, "LENGTH({'ab', 'c'})": 3, "POSITION('héllo', 'l')": 3, "POSITION('abc', 'z')": -1,
    "SUBSTR('abcdef', 3)": "abc", "SUBSTR('abcdef', 2, 3)": "cde", "SUBSTR('ab', 1, 4)": "b   ", "SUBSTR('abc', -2, 4)": "  ab", "REPLACE('aXbX', 'X', '-')": "a-b-", "PAD('ab', 4, '*')": "ab**", "PAD('abcdef', 3)": "abcdef",
    "TRIM('  x ')": "x", "TRIM(LEADING 'ab' FROM 'ababxab')": "xab", "TRIM(TRAILING '.' FROM 'x..')": "x", "UPPER('aé')": "AÉ", "LOWER('AÉ')": "aé",
    "BEGINS('abc', 'ab')": True, "CONTAINS('abc', 'z')": False, "ENDS('abc', 'bc')": True, "'abc' SIMILAR TO /B/i": True,
    "CAST('12' AS INT)": 12, "CAST(3.9 AS INT)": 3, "CAST(1 AS STRING)": "1", "TONUM('1.5')": 1.5, "TONUM('x')": None, "TOINUM('7.9')": 7, "TONUM(TRUE)": 1, "COALESCE(NULL, 2)": 2,
    "CASE WHEN 1 > 2 THEN 'a' WHEN TRUE THEN 'b' END": "b", "CASE 3 WHEN 3 THEN 'x' ELSE 'y' END": "x",
    "EXTRACT(YEAR FROM TIMESTAMP '2024-02-29 13:14:15.250000')": 2024, "EXTRACT(WDAY FROM TIMESTAMP '2024-01-07 00:00:00')": 0, "EXTRACT(FRACTIONAL FROM TIMESTAMP '2024-02-29 13:14:15.25')": 250000, "EXTRACT(SECOND FROM TIMESTAMP '2024-02-29 13:14:15.25')": 15,
    "TIMESTAMP '2024-01-02 00:00:00' - TIMESTAMP '2024-01-01 00:00:00'": datetime.timedelta(days=1), "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '25:30'": datetime.datetime(2024, 1, 2, 1, 30), "INTERVAL '-1:00'": datetime.timedelta(hours=-1),
    "{1, 2, 3}[:SUM]": 6, "{4, 2}[:FIRST]": 4, "{4, 2}[:LAST]": 2, "{4, 2}[1]": 2, "{4, 2}[9]": None, "{'a', 'b'}[:CONCAT]": "ab", "{1, {2, 3}}[:MAX]": 3, "[[1, 2], [3, 4]][1, 0]": 3, "{1 -> 'x'}[1]": "x",
    "NORM([3, 4])": 5.0, "NORM([3.0, -4.0], 1)": 7.0, "TRACE([[1, 2], [3, 4]])": 5.0, "[1, 2] * [3, 4]": 11.0, "([1.0, 2.0] + [3.0, 4.0])[1]": 6.0, "DET([[2, 0], [0, 3]])": 6.0, "INV([[1, 2], [2, 4]])": None, "INV([[2, 0], [0, 4]])[1, 1]": 0.25, "RANK([[1, 2], [2, 4]])": 1, "([[1, 2], [3, 4]] * [1, 1])[1]": 7.0, "TRANSPOSE([[1, 2], [3, 4]])[0, 1]": 3, "([[2.0, 0.0], [0.0, 4.0]] / [[2.0, 0.0], [0.0, 2.0]])[1, 1]": 2.0,
    "2km + 500m": 2.5, "CAST(1mi AS m)": 1609.344, "CAST(100dC AS K)": 373.15, "1km > 900m": True, "10m / 2s": 5.0, "CAST(0.5 AS km)": 0.5,
    "VAR_POP(1, 2, 3, 4)": 1.25, "STDDEV_SAMP(1, 3)": math.sqrt(2), "X'0f' & X'ff'": b"\x0f", "X'0f' | X'f000'": b"\xff\x00", "HASH('a')": bytes.fromhex("ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"),
    "1 IN (1, 2)": True, "3 IN @[1, *]": True, "0 NOT BETWEEN 1 AND 2": True, "5 > ALL({1, 2})": True, "1 = ANY({1, 2})": True, "3 = SOME({1, 2})": False, "{1, 2} = 2": True, "{1, 2} < 2": False, "NULL IS NULL": True, "CURRENT_USER": "owner", "'a' 'b'": "ab",
}


def test_constants(s):
    items = {k: v for k, v in CONSTANTS.items() if k != "COUNT(1, 2)"}
    row = s.execute("SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(items))).first()
    for i, (e, want) in enumerate(items.items()):
        got = row[f"c{i}"]
        if isinstance(want, float):
            assert got == pytest.approx(want), e
        elif isinstance(want, bytes):
            assert bytes(got) == want, e
        else:
            assert got == want and isinstance(got, bool) == isinstance(want, bool), e


def test_missing_values(s):
    assert ids(s, "a = b") == []
    assert ids(s, "a <> b") == [1, 2, 3, 4]  # a missing operand differs
    assert ids(s, "NOT a = b") == [1, 2, 3, 4]
    assert ids(s, "a < b") == [] and ids(s, "NOT a < b") == [1, 2, 3, 4]
    assert ids(s, "NOT (a = 10 AND b = 5)") == [2, 3, 4]
    assert ids(s, "a NOT IN (1, 2)") == [1, 2, 3, 4] and ids(s, "a IN (10)") == [1, 3]
    assert ids(s, "a IS NULL") == [2, 4] and ids(s, "EXISTS(a)") == [1, 3] and ids(s, "NOT EXISTS(a)") == [2, 4]
    assert ids(s, "s NOT SIMILAR TO /a/") == [2, 3, 4]
    assert ids(s, "(a = 10) IS TRUE") == [1, 3] and ids(s, "(a = 10) IS NOT TRUE") == [2, 4]


def test_flags(spark, s):
    std = Session(spark, nulls_out=True)
    std.catalog = s.catalog
    assert ids(std, "a <> b") == [1]
    ci = Session(spark, case_insensitive=True)
    ci.catalog = s.catalog
    assert ids(ci, "s = 'ab'") == [1, 2]
    strict = Session(spark, strict_missing=True)
    strict.catalog = s.catalog
    assert len(strict.execute("SELECT a, COUNT(*) AS n FROM t GROUP BY a").collect()) == 1
    assert len(s.execute("SELECT a, COUNT(*) AS n FROM t GROUP BY a").collect()) == 2
    num = Session(spark, numeric_strings=True)
    assert num.execute("SELECT '10' > '9' AS x, 'a' > '9' AS y").first() == (True, True)
    with pytest.raises(TypeError):
        Session(spark, nonsense=True)


def test_collections_in_predicates(s):
    assert ids(s, "nums = 2") == [1]
    assert ids(s, "nums < 3") == [3]  # holds for all elements, also for none
    assert ids(s, "nums IN (4, 9)") == [2]
    assert ids(s, "BEGINS(tags, 'x')") == [1]
    assert ids(s, "nums[:SOME] > 2") == [1, 2]
    assert ids(s, "tags[:ALL] = 'y'") == [3, 4]
    assert ids(s, "SUM(nums) > 3") == [1, 2]
    assert ids(s, "COUNT(nums) = 0") == [3]


def test_groups_flatten_collections(s):
    r = s.execute("SELECT COUNT(nums) AS n, SUM(nums) AS s, AVG(nums) AS a, VAR_POP(nums) AS v, MIN(nums) AS lo, HISTOGRAM(id) AS h FROM t").first()
    assert (r["n"], r["s"], r["a"], r["v"], r["lo"]) == (4, 10, 2.5, pytest.approx(1.25), 1) and len(r["h"]) == 4


def test_mean_of_times_is_exact(spark):
    """The mean is of all microseconds and rounded, as in DuckDB, however many rows there are; a group without times has none."""
    s = Session(spark)
    rows = spark.range(200_000).selectExpr("id", "id % 2 = 0 AS even", "timestamp_micros(892683887040000 + (id % 2) * 3 + id * 1000000 - 99999500000) AS at", "CAST(NULL AS TIMESTAMP) AS none")
    s.register("moments", rows, "id")
    got = s.execute("SELECT AVG(at) AS mid, AVG(none) AS none FROM moments").selectExpr("unix_micros(mid) AS mid", "none").first()
    assert (got["mid"], got["none"]) == (892683887040002, None)  # 1.5 more than the middle
    got = s.execute("SELECT even, AVG(DISTINCT at) AS mid FROM moments WHERE id < 4 GROUP BY even").selectExpr("even", "unix_micros(mid) AS mid").collect()
    assert dict(got) == {True: 892583888540000, False: 892583889540003}


def test_errors(s):
    for q, e in [("SELECT nothing FROM t", Unknown), ("SELECT id FROM nowhere", Unknown), ("SELECT NOFUNCTION(1)", Unknown), ("SELECT CAST(1 AS NOTYPE)", SyntaxProblem), ("SELECT 1km + 1s", units.UnitMismatch), ("SELECT 5foo", SyntaxProblem), ("SELECT :missing", Unknown), ("SELECT id FROM t AS a, t AS b", Unknown)]:
        with pytest.raises(e):
            s.execute(q)


def test_text_analysis():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "adjustment": "adjust", "sensibility": "sensibl", "ab": "ab", "été": "été"}
    assert {k: stem(k) for k in pairs} == pairs
    assert words("Don't stop_here, 3rd x2 É!") == ["don't", "stop_here", "3", "rd", "x2", "é"]
    assert "the" in STOP_WORDS


def test_every_unit_converts_to_its_base_and_back():
    for u in units.UNITS.values():
        base = next(x for x in units.UNITS.values() if x.dims == u.dims and x.factor == 1 and x.shift == 0)
        there = eval(units.convert("7.0", u.name, base.name).replace("D", ""), {})  # noqa: S307  plain arithmetic
        back = eval(units.convert(repr(there), base.name, u.name).replace("D", ""), {})  # noqa: S307
        assert math.isclose(back, 7.0, rel_tol=1e-9)
