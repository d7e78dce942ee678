"""Queries of the language over the standard tables, each with the SQL that says the same."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import WORD
from lodestone.operators import text_search, windows
from lodestone.session import Session
from lodestone.sources import services
from lodestone.sources.catalog import shared_dir
from lodestone.sources.store import Batch, Conflict, Store
from lodestone.streaming import events as class_events
from lodestone.streaming import machines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The queries that bench.py times.
HEADLINE = ("pricing_summary", "join_three_way", "agg_distinct", "ft_any", "path_repeat_star", "window_count", "join_theta", "agg_histogram", "path_deref", "sort_multi", "vec_norm", "family_param")


def session(spark: SparkSession, sf_dir: str, **flags: bool) -> Session:
    return Session(spark, **flags).register_parquet(sf_dir)


def _text(name: str, dialect: str, duck: str, digits: dict[str, int] | None = None, setup: Callable[[Session], None] | None = None, **flags: bool) -> None:
    """``digits``: doubles whose last bits depend on the order of sums are rounded, on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, **flags)
        if setup:
            setup(s)
        df = s.execute(dialect)
        for c, d in (digits or {}).items():
            df = df.withColumn(c, F.round(c, d))
        return df

    QUERIES[name], ORACLE[name] = run, duck


def _code(name: str, duck: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if duck is not None:
            ORACLE[name] = duck
        return f

    return keep


# -- projection -----------------------------------------------------------------------------------------------------

_text(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price, COUNT(*) AS n FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_discount BETWEEN 0.02 AND 0.08 GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10 ORDER BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_discount BETWEEN 0.02 AND 0.08 GROUP BY ALL HAVING count(*) > 10""",
    {"sum_qty": 2, "avg_price": 4},
)
_text("proj_alias_arith", "SELECT o_orderkey, o_totalprice * 2.0 + 1.0 twice, o_custkey % 7 AS m FROM orders", "SELECT o_orderkey, o_totalprice * 2.0::DOUBLE + 1.0::DOUBLE AS twice, o_custkey % 7 AS m FROM orders")
_text("proj_augmented", "SELECT @, n_nationkey + 100 AS shifted FROM nation", "SELECT *, n_nationkey + 100 AS shifted FROM nation")
_text("proj_derived", "SELECT @{id = r_regionkey, label = UPPER(r_name)} FROM region", "SELECT r_regionkey AS id, upper(r_name) AS label FROM region")
_text("proj_ids", "SELECT @ AS pin FROM customer", "SELECT c_custkey AS pin FROM customer")
_text("proj_constant", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, 7 / 2 AS q", "SELECT 2::INTEGER AS two, 'ab' AS ab, 3::BIGINT AS q")
_text("proj_cast", "SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, CAST(o_orderkey AS STRING) AS label FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::INTEGER AS whole, o_orderkey::VARCHAR AS label FROM orders")
_text("proj_unnamed", "SELECT UPPER(n_name) FROM nation", "SELECT upper(n_name) AS value FROM nation")
_text("select_first", "SELECT FIRST n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 1")
_text("count_star", "SELECT COUNT(*) AS n FROM orders", "SELECT count(*) AS n FROM orders")
_text("stored_expression", "SELECT l_orderkey, l_linenumber, net(l_extendedprice, l_discount) AS paid FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS paid FROM lineitem", setup=lambda s: s.define_expression("net", ":0 * (1.0 - :1)"))
_text("select_star", "SELECT * FROM part", "SELECT * FROM part")

# -- sources --------------------------------------------------------------------------------------------------------

_text("range_source", "SELECT value, value * value AS sq FROM @[1,100]", "SELECT i AS value, i * i AS sq FROM range(1, 101) t(i)")
_text("coll_source", "SELECT value FROM {3, 1, 2} ORDER BY value", "SELECT unnest([1, 2, 3])::INTEGER AS value")
_text("struct_source", "SELECT a, b FROM {{a=1, b='x'}, {a=2, b='y'}}", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)")
_text("explicit_ids", "SELECT n_name FROM nation {@1, @A, @18}", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 10, 24)")
_text("named_object", "SELECT c_name, c_acctbal FROM #first", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 7", setup=lambda s: s.name_object("first", "customer", 7))
_text("subquery_source", "SELECT q.k AS k, q.n AS n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) AS q WHERE q.n > 1", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
_text("distinct_keys", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority", "SELECT DISTINCT o_orderpriority FROM orders")
_text("with_params", "WITH low = 1000, high = 2000 SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN :low AND :high", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000")
_text("whole_store", "SELECT class_name, COUNT(*) AS n FROM * GROUP BY class_name", " UNION ALL ".join(f"SELECT '{t}' AS class_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
_text("whole_store_rows", "SELECT pin_id, class_name, n_name, l_quantity FROM * WHERE class_name = 'nation' OR class_name = 'lineitem' AND l_orderkey < 50", "SELECT n_nationkey::BIGINT AS pin_id, 'nation' AS class_name, n_name, NULL::DOUBLE AS l_quantity FROM nation UNION ALL SELECT NULL, 'lineitem', NULL, l_quantity FROM lineitem WHERE l_orderkey < 50")

_text("listing", "SELECT name FROM CLASSES WHERE BEGINS(name, 'dear')", "SELECT * FROM (VALUES ('dear'), ('dearclicks')) t(name)", setup=lambda s: _classes(s))
_text("select_all", "SELECT ALL n_regionkey FROM nation", "SELECT n_regionkey FROM nation")
_text("enumeration", "SELECT n_nationkey, color.RED AS c FROM nation WHERE n_name <> color.BLUE", "SELECT n_nationkey, 'RED' AS c FROM nation WHERE n_name <> 'BLUE'", setup=lambda s: s.execute("CREATE ENUMERATION color AS {'RED', 'BLUE'}"))
_text("current_values", "SELECT r_name, CURRENT_USER AS u, CURRENT_TIMESTAMP > TIMESTAMP '2024-01-01 00:00:00' AS later FROM region", "SELECT r_name, 'owner' AS u, TRUE AS later FROM region")
_text("is_local", "SELECT o_orderkey FROM orders WHERE ISLOCAL(o_custkey) AND o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")


@_code("json_rows", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def _json_rows(spark, sf_dir):
    return session(spark, sf_dir).json("SELECT n_nationkey, n_name FROM nation")


@_code("json_value", """SELECT '["a", "b"]' AS j, '3' AS k""")
def _json_value(spark, sf_dir):
    s = session(spark, sf_dir)
    return spark.createDataFrame([(s.value_json("{'a', 'b'}"), s.value_json("1 + 2"))], "j string, k string")


@_code("access", "SELECT p_partkey FROM part WHERE p_size % 3 <> 1")
def _access(spark, sf_dir):
    """Parts that a guest may read: those without a list, and those whose list lets the guest read."""
    guest = Session(spark, identity="guest")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    who = F.when(F.col("p_size") % 3 == 1, "other").otherwise("guest")
    acl = F.when(F.col("p_size") % 3 > 0, F.array(F.struct(who.alias("who"), F.lit("rw").alias("mode"))))
    guest.register("part", part.withColumn("_acl", acl), "p_partkey")
    return guest.execute("SELECT p_partkey FROM part")


@_code("async_query", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def _async_query(spark, sf_dir):
    done = []
    session(spark, sf_dir).execute_async("SELECT n_name FROM nation WHERE n_regionkey = 2", lambda df, e: done.append((df, e))).join(600)
    if done[0][1] is not None:
        raise done[0][1]
    return done[0][0]


@_code("builder_required", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NOT NULL")
def _builder_required(spark, sf_dir):
    q = session(spark, sf_dir).statement()
    q.join(q.add_variable("customer"), q.add_variable("orders"), "c_custkey = o_custkey AND o_totalprice > 300000", "LEFT")
    return q.add_output("c_custkey").add_output("o_orderkey").add_required("o_orderkey").execute()


@_code("builder_set_op", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _builder_set_op(spark, sf_dir):
    s = session(spark, sf_dir)
    a, b = s.statement(), s.statement()
    a.add_variable("customer")
    b.add_variable("supplier", where="s_acctbal > 5000")
    return s.statement().set_op(a.add_output("c_nationkey", "k"), b.add_output("s_nationkey", "k"), "EXCEPT").execute()


@_code("builder_text", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand HAVING count(*) > 3")
def _builder_text(spark, sf_dir):
    """A statement to text and back."""
    s = session(spark, sf_dir)
    q = s.statement()
    q.add_variable("part")
    q.add_output("p_brand").add_output("COUNT(*)", "n").add_condition("p_size > :low").set_group("p_brand", having="COUNT(*) > 3")
    return type(q).from_text(s, q.to_text()).execute({"low": 10})


@_code("is_satisfied", "SELECT n_nationkey, n_nationkey % 2 = 1 AND n_regionkey > 1 AS ok FROM nation")
def _is_satisfied(spark, sf_dir):
    s = session(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()  # one row at a time is what this call is for
    return spark.createDataFrame([(r[0], s.is_satisfied("n_nationkey % 2 = :odd AND n_regionkey > 1", r.asDict(), {"odd": 1})) for r in rows], "n_nationkey int, ok boolean")


# -- predicates -----------------------------------------------------------------------------------------------------

_text("pred_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
_text("pred_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
_text("pred_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 3, 5)", "SELECT p_partkey FROM part WHERE p_size IN (1, 3, 5)")
_text("pred_in_range", "SELECT p_partkey FROM part WHERE p_size IN @[40, *]", "SELECT p_partkey FROM part WHERE p_size >= 40")
_text("pred_begins", "SELECT p_partkey FROM part WHERE BEGINS(p_type, 'S')", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')")
_text("pred_contains", "SELECT p_partkey FROM part WHERE CONTAINS(p_type, 'E')", "SELECT p_partkey FROM part WHERE contains(p_type, 'E')")
_text("pred_ends", "SELECT p_partkey FROM part WHERE ENDS(p_brand, '3')", "SELECT p_partkey FROM part WHERE ends_with(p_brand, '3')")
_text("pred_similar", "SELECT p_partkey, /1 AS digits FROM part WHERE p_brand SIMILAR TO /#([1-3]+)$/", "SELECT p_partkey, regexp_extract(p_brand, '#([1-3]+)$', 1) AS digits FROM part WHERE regexp_matches(p_brand, '#([1-3]+)$')")
_text("pred_is_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 WHERE o_orderkey IS NULL OR o_orderkey IS NOT NULL AND o_orderkey < 500", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 WHERE o_orderkey IS NULL OR o_orderkey < 500")
_text("pred_ne_missing", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus IS DISTINCT FROM 'F'")
_text("pred_ne_standard", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'", nulls_out=True)
_text("pred_not", "SELECT n_name FROM nation WHERE NOT (n_regionkey = 1 OR n_regionkey > 3)", "SELECT n_name FROM nation WHERE NOT (n_regionkey = 1 OR n_regionkey > 3)")
_text("pred_or_to_in", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)")
_text("pred_testbit", "SELECT p_partkey FROM part WHERE TESTBIT(p_size, 0)", "SELECT p_partkey FROM part WHERE p_size % 2 = 1")
_text("pred_case_insensitive", "SELECT n_name FROM nation WHERE UPPER(n_name) = UPPER('nation_7')", "SELECT n_name FROM nation WHERE upper(n_name) = 'NATION_7'")
_text("exists_property", "SELECT event_id FROM events WHERE EXISTS(value)", "SELECT event_id FROM events WHERE value IS NOT NULL")
_text("exists_subquery", "SELECT c_custkey FROM customer WHERE EXISTS(SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE EXISTS(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_text("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_text("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "SELECT c_custkey FROM customer WHERE NOT EXISTS(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_text("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) AS a FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_text("quantified_all", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL(SELECT s_acctbal FROM supplier)", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL(SELECT s_acctbal FROM supplier)")
_text("quantified_any", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY(SELECT r_regionkey FROM region)", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region)")

# -- joins ----------------------------------------------------------------------------------------------------------

_text("join_inner_on", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_text("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) AS x JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) AS y USING (k)", "SELECT n_nationkey AS k, n_name AS a, s_name AS b FROM nation JOIN supplier ON n_nationkey = s_nationkey")
_text("join_implicit", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_text("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_text("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
_text("join_full", "SELECT s_suppkey, c_custkey FROM supplier OUTER JOIN customer ON s_suppkey = c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
_text("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region AS a CROSS JOIN region AS b", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
_text("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_text("join_three_way", """SELECT n_name, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY n_name""", """SELECT n_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY n_name""", {"qty": 2})  # fmt: skip


@_code("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS(SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _join_semi(spark, sf_dir):
    q = session(spark, sf_dir).statement()
    q.join(q.add_variable("customer"), q.add_variable("orders"), "c_custkey = o_custkey")
    return q.add_output("c_custkey").execute()


_text("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE NOT EXISTS(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_text("join_theta_pure", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey < n_nationkey", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey < n_nationkey")
_text("join_collection", "SELECT g.k AS k, n_name FROM (SELECT 1 AS k, {1, 2, 3, 3} AS ids) AS g JOIN nation ON g.ids = n_nationkey", "SELECT 1::INTEGER AS k, n_name FROM nation WHERE n_nationkey IN (1, 2, 3)")

# -- aggregation ----------------------------------------------------------------------------------------------------

_text("agg_count", "SELECT o_orderstatus, COUNT(o_orderkey) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders GROUP BY ALL")
_text("agg_sum_avg", "SELECT l_returnflag, SUM(l_extendedprice) AS s, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY ALL", {"s": 2, "a": 6})
_text("agg_min_max", "SELECT p_brand, MIN(p_retailprice) AS low, MAX(p_retailprice) AS high FROM part GROUP BY p_brand", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL")
_text("agg_var_stddev", "SELECT p_brand, VAR_POP(p_size) AS vp, VAR_SAMP(p_size) AS vs, STDDEV_POP(p_size) AS sp, STDDEV_SAMP(p_size) AS ss FROM part GROUP BY p_brand", "SELECT p_brand, round(var_pop(p_size), 6) AS vp, round(var_samp(p_size), 6) AS vs, round(stddev_pop(p_size), 6) AS sp, round(stddev_samp(p_size), 6) AS ss FROM part GROUP BY ALL", dict.fromkeys(("vp", "vs", "sp", "ss"), 6))
_text("agg_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL")


def _flat_histogram(spark, sf_dir):
    got = session(spark, sf_dir).execute("SELECT l_returnflag, HISTOGRAM(l_linenumber) AS h, COUNT(*) AS total FROM lineitem GROUP BY l_returnflag")
    return got.select("l_returnflag", "total", F.explode("h").alias("e")).select("l_returnflag", "total", F.col("e.value").alias("v"), F.col("e.count").alias("n"))


_code("agg_histogram", "SELECT l_returnflag, sum(count(*)) OVER (PARTITION BY l_returnflag)::BIGINT AS total, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber")(_flat_histogram)
_text("agg_argmin_argmax", "SELECT n_regionkey, ARGMIN(n_name) AS lo, ARGMAX(n_name) AS hi FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, min_by(i, n_name)::INTEGER AS lo, max_by(i, n_name)::INTEGER AS hi FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY n_regionkey")
_POS = "SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders"
_text("agg_argmax_ties", "SELECT o_orderpriority, ARGMAX(o_orderstatus) AS hi, ARGMIN(o_totalprice) AS lo, COUNT(*) AS n FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 1", f"SELECT o_orderpriority, (SELECT min(i) FROM ({_POS}) x WHERE x.o_orderpriority = p.o_orderpriority AND x.o_orderstatus = max(p.o_orderstatus))::INTEGER AS hi, min_by(i, o_totalprice)::INTEGER AS lo, count(*) AS n FROM ({_POS}) p GROUP BY o_orderpriority HAVING count(*) > 1")
_text("agg_argmin_global", "SELECT ARGMIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)))::INTEGER AS lo, max(o_totalprice) AS hi FROM orders")
_text("agg_concat", "SELECT CONCAT({'a', 'b', 'c'}) AS abc, {'x', 'y'}[:CONCAT] AS xy", "SELECT 'abc' AS abc, 'xy' AS xy")
_text("group_expr", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)", "SELECT extract(year FROM o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL")
_text("group_keys_only", "SELECT FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_text("having", "SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING s > 1000000", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY ALL HAVING sum(o_totalprice) > 1000000", {"s": 2})
_text("global_agg_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
_text("agg_datetime_avg", "SELECT AVG(o_orderdate) AS mid FROM orders", "SELECT make_timestamp(avg(epoch_us(o_orderdate))::DECIMAL(38,3)::HUGEINT::BIGINT) AS mid FROM orders")
_text("agg_subquery", "SELECT r_name, COUNT(SELECT * FROM nation WHERE n_regionkey = 1) AS n FROM region GROUP BY r_name", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n FROM region")

# -- order, sets ----------------------------------------------------------------------------------------------------

_text("sort_multi", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey", "SELECT o_orderpriority, o_orderkey FROM orders")


def _cut_of_order(name: str, dialect: str, duck: str, n: int = 40, skip: int = 0, setup: Callable[[Session], None] | None = None, **flags: bool) -> None:
    """Which rows come first shows the order, which a comparison of whole results can't."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, **flags)
        if setup:
            setup(s)
        return s.execute(dialect, limit=n, skip=skip)

    QUERIES[name], ORACLE[name] = run, f"{duck} LIMIT {n} OFFSET {skip}"


_SOME = "FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"
_cut_of_order("sort_order", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
_cut_of_order("sort_nulls", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey DESC, c_custkey", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey DESC NULLS LAST, c_custkey")
_cut_of_order("sort_nulls_ascending", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey, c_custkey", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey NULLS LAST, c_custkey")
_cut_of_order("sort_nulls_first", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey DESC NULLS FIRST, c_custkey", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey DESC NULLS FIRST, c_custkey")
_cut_of_order("sort_upper", "SELECT p_partkey, p_type FROM part ORDER BY UPPER(p_type), SUBSTR(p_brand, 7), p_partkey DESC", "SELECT p_partkey, p_type FROM part ORDER BY upper(p_type), substr(p_brand, 1, 7), p_partkey DESC")
_cut_of_order("sort_strict", f"SELECT c_custkey, o_orderkey {_SOME} ORDER BY o_orderkey", f"SELECT c_custkey, o_orderkey {_SOME} WHERE o_orderkey IS NOT NULL ORDER BY o_orderkey", n=100_000, strict_missing=True)
_text("group_strict", f"SELECT o_orderkey, COUNT(*) AS n {_SOME} GROUP BY o_orderkey", f"SELECT o_orderkey, count(*) AS n {_SOME} WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey", strict_missing=True)


@_code("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _top_k(spark, sf_dir):
    return session(spark, sf_dir).execute("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", limit=10)


@_code("offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def _offset(spark, sf_dir):
    return session(spark, sf_dir).execute("SELECT o_orderkey FROM orders ORDER BY o_orderkey", limit=10, skip=20)


_text("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part", "SELECT DISTINCT p_brand, p_size FROM part")
_text("set_union", "(SELECT c_nationkey AS k FROM customer) UNION (SELECT s_nationkey AS k FROM supplier)", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_text("set_union_all", "(SELECT c_nationkey AS k FROM customer) UNION ALL (SELECT s_nationkey AS k FROM supplier)", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_text("set_intersect", "(SELECT c_nationkey AS k FROM customer) INTERSECT (SELECT s_nationkey AS k FROM supplier)", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_text("set_except", "(SELECT n_nationkey AS k FROM nation) EXCEPT (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_text("set_by_identity", "(SELECT * FROM nation WHERE n_regionkey < 3) INTERSECT (SELECT * FROM nation WHERE n_nationkey > 5)", "SELECT * FROM nation WHERE n_regionkey < 3 AND n_nationkey > 5")

# -- functions ------------------------------------------------------------------------------------------------------

_text("fn_arith", "SELECT l_orderkey, l_linenumber, l_orderkey / 3 AS d, l_orderkey % 5 AS m, -l_linenumber AS neg, ABS(l_linenumber - 4) AS a, l_quantity / 3.0 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 3 AS d, l_orderkey % 5 AS m, -l_linenumber AS neg, abs(l_linenumber - 4) AS a, l_quantity / 3.0::DOUBLE AS f FROM lineitem")
_text("fn_bits", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_partkey ^ 5 AS x, p_partkey << 2 AS l, p_size << 40 AS w, (-p_partkey) >>> 40 AS u, p_partkey >> 1 AS r, ~p_partkey AS n, SETBIT(p_partkey, 4) AS s, RESETBIT(p_partkey, 0) AS t, BITFIELD(p_partkey, 1, 3) AS b FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, p_partkey * 4 AS l, p_size::BIGINT * 1099511627776 AS w, CASE WHEN p_partkey = 0 THEN 0 ELSE 16777215 END::BIGINT AS u, p_partkey >> 1 AS r, ~p_partkey AS n, p_partkey | 16 AS s, p_partkey & ~1::BIGINT AS t, (p_partkey >> 1) & 7 AS b FROM part")
_text("fn_math", "SELECT p_partkey, LN(p_size) AS l, EXP(p_size / 50.0) AS e, POWER(p_size, 2) AS p, SQRT(p_size) AS s, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c FROM part", "SELECT p_partkey, round(ln(p_size), 9) AS l, round(exp(p_size / 50.0::DOUBLE), 9) AS e, pow(p_size, 2)::DOUBLE AS p, round(sqrt(p_size), 9) AS s, floor(p_retailprice) AS f, ceil(p_retailprice) AS c FROM part", {"l": 9, "e": 9, "s": 9})
_text("fn_trig", "SELECT p_partkey, SIN(p_size) AS s, COS(p_size) AS c, TAN(p_size) AS t, ASIN(1.0 / p_size) AS a, ACOS(1.0 / p_size) AS b, ATAN(p_size) AS d, ATAN(p_size, 2) AS e FROM part", "SELECT p_partkey, round(sin(p_size), 7) AS s, round(cos(p_size), 7) AS c, round(tan(p_size), 6) AS t, round(asin(1.0::DOUBLE / p_size), 7) AS a, round(acos(1.0::DOUBLE / p_size), 7) AS b, round(atan(p_size), 7) AS d, round(atan2(p_size, 2), 7) AS e FROM part", {"s": 7, "c": 7, "t": 6, "a": 7, "b": 7, "d": 7, "e": 7})
_text("fn_string", "SELECT p_partkey, p_brand || '-' || p_type AS j, LOWER(p_name) AS lo, UPPER(p_name) AS up, LENGTH(p_name) AS n, POSITION(p_name, 'a') AS p FROM part", "SELECT p_partkey, p_brand || '-' || p_type AS j, lower(p_name) AS lo, upper(p_name) AS up, strlen(p_name)::INTEGER AS n, (instr(p_name, 'a') - 1)::INTEGER AS p FROM part")
_text("fn_substr", "SELECT c_custkey, SUBSTR(c_name, 4) AS a, SUBSTR(c_name, 2, 3) AS b, SUBSTR(c_mktsegment, 5, 20) AS c FROM customer", "SELECT c_custkey, rpad(substr(c_name, 1, 4), 4, ' ') AS a, rpad(substr(c_name, 3, 3), 3, ' ') AS b, rpad(substr(c_mktsegment, 6, 20), 20, ' ') AS c FROM customer")
_text("fn_trim", "SELECT n_nationkey, TRIM(LEADING 'N' FROM n_name) AS a, TRIM(TRAILING '1' FROM n_name) AS b, TRIM(BOTH 'NA' FROM n_name) AS c, TRIM('  x ') AS d FROM nation", "SELECT n_nationkey, ltrim(n_name, 'N') AS a, rtrim(n_name, '1') AS b, regexp_replace(regexp_replace(n_name, '^(NA)+', ''), '(NA)+$', '') AS c, 'x' AS d FROM nation")
_text("fn_pad", "SELECT n_nationkey, PAD(n_name, 12, '*') AS p, PAD(n_name, 3) AS q FROM nation", "SELECT n_nationkey, CASE WHEN length(n_name) < 12 THEN rpad(n_name, 12, '*') ELSE n_name END AS p, CASE WHEN length(n_name) < 3 THEN rpad(n_name, 3, ' ') ELSE n_name END AS q FROM nation")
_text("fn_replace", "SELECT n_nationkey, REPLACE(n_name, 'NATION', 'N') AS r FROM nation", "SELECT n_nationkey, replace(n_name, 'NATION', 'N') AS r FROM nation")


@_code("fn_hash", "SELECT n_nationkey, sha256(n_name) AS h FROM nation")
def _fn_hash(spark, sf_dir):
    return session(spark, sf_dir).execute("SELECT n_nationkey, HASH(n_name) AS h FROM nation").withColumn("h", F.lower(F.hex("h")))


_text("fn_cast", "SELECT o_orderkey, TONUM('12.5') AS a, TOINUM('12.5') AS b, TONUM(o_orderkey > 10) AS c, CAST(o_orderkey AS DOUBLE) AS d, TONUM(o_orderdate) AS us FROM orders", "SELECT o_orderkey, 12.5::DOUBLE AS a, 12::BIGINT AS b, (o_orderkey > 10)::INTEGER AS c, o_orderkey::DOUBLE AS d, epoch_us(o_orderdate) AS us FROM orders")
_text("fn_coalesce", "SELECT c_custkey, COALESCE(o_orderstatus, 'none') AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, coalesce(o_orderstatus, 'none') AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_text("fn_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS c FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS c FROM part")
_text("fn_extract", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS mo, EXTRACT(DAY FROM ts) AS d, EXTRACT(WDAY FROM ts) AS w, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s FROM events", "SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, day(ts)::INTEGER AS d, dayofweek(ts)::INTEGER AS w, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS s FROM events")
_text("fn_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '36:30:00' AS later, o_orderdate - INTERVAL '1:00' AS before FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR + INTERVAL 30 MINUTE AS later, o_orderdate - INTERVAL 1 HOUR AS before FROM orders")
_text("fn_min_max_args", "SELECT p_partkey, MIN(p_size, 20, 30) AS lo, MAX(p_size, 20, 30) AS hi, ARGMAX(p_size, 20, 30) AS at, ARGMIN(p_size, 20, 30) AS least_at FROM part", "SELECT p_partkey, least(p_size, 20, 30) AS lo, greatest(p_size, 20, 30) AS hi, (list_position([p_size, 20, 30], greatest(p_size, 20, 30)) - 1)::INTEGER AS at, (list_position([p_size, 20, 30], least(p_size, 20, 30)) - 1)::INTEGER AS least_at FROM part")
_text("unit_convert", "SELECT p_partkey, CAST(CAST(p_size AS km) AS mi) AS miles, CAST(CAST(p_size AS dC) AS dF) AS f FROM part", "SELECT p_partkey, round(p_size * 1000.0::DOUBLE / 1609.344::DOUBLE, 9) AS miles, round((p_size + 273.15::DOUBLE - 255.3722222::DOUBLE) / 0.5555555555556::DOUBLE, 6) AS f FROM part", {"miles": 9, "f": 6})
_text("unit_arith", "SELECT 2km + 500m AS d, 10m / 2s AS v, 3m * 4m AS a", "SELECT 2.5::DOUBLE AS d, 5::DOUBLE AS v, 12::DOUBLE AS a")


def _user_parts(s: Session) -> None:
    s.register_function("double_it", lambda x: None if x is None else x * 2, "bigint")
    s.register_operator("+", lambda a, b: f"concat({a.sql}, {b.sql})" if a.kind is not None and a.kind.simpleString() == "string" else None)


_text("extension_points", "SELECT n_nationkey, double_it(n_nationkey) AS d, n_name + '!' AS e FROM nation", "SELECT n_nationkey, (n_nationkey * 2)::BIGINT AS d, n_name || '!' AS e FROM nation", setup=_user_parts)

# -- collections, structs, maps, vectors ----------------------------------------------------------------------------


def _baskets(s: Session) -> None:
    """Orders with their lines as collections."""
    lines = s.spark.table(s.catalog.table("lineitem").view)
    got = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("qty"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    s.register("basket", got.withColumn("info", F.struct(F.size("qty").alias("n"), F.element_at("qty", 1).alias("head"))).withColumn("attrs", F.create_map(F.lit("first"), F.element_at("flags", 1))), "l_orderkey")


_LINES = "(SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS qty, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_orderkey)"
_text("coll_elements", "SELECT l_orderkey, qty[:FIRST] AS f, qty[:LAST] AS l, qty[0] AS z, qty[:MIN] AS lo, qty[:MAX] AS hi, flags[:CONCAT] AS fl FROM basket", f"SELECT l_orderkey, qty[1] AS f, qty[-1] AS l, qty[1] AS z, list_min(qty) AS lo, list_max(qty) AS hi, array_to_string(flags, '') AS fl FROM {_LINES}", setup=_baskets)
_text("coll_quantifiers", "SELECT l_orderkey FROM basket WHERE 40 < ANY(qty) AND 45 > ALL(qty) AND flags = 'N'", f"SELECT l_orderkey FROM {_LINES} WHERE list_max(qty) > 40 AND list_max(qty) < 45 AND list_contains(flags, 'N')", setup=_baskets)
_text("coll_agg", "SELECT l_orderkey, qty[:SUM] AS s, qty[:AVG] AS a, qty[:COUNT] AS n FROM basket", f"SELECT l_orderkey, list_sum(qty) AS s, round(list_avg(qty), 9) AS a, len(qty)::INTEGER AS n FROM {_LINES}", {"a": 9}, setup=_baskets)
_text("coll_group_agg", "SELECT SUM(qty) AS s, COUNT(qty) AS n, MAX(qty) AS m FROM basket", "SELECT sum(l_quantity) AS s, count(l_quantity) AS n, max(l_quantity) AS m FROM lineitem", setup=_baskets)
_text("coll_universal", "SELECT l_orderkey FROM basket WHERE qty > 30", f"SELECT l_orderkey FROM {_LINES} WHERE list_min(qty) > 30", setup=_baskets)
_text("coll_count_cardinality", "SELECT l_orderkey, COUNT(@, qty) AS n, COUNT(@, flags) AS f FROM basket", f"SELECT l_orderkey, len(qty)::INTEGER AS n, len(flags)::INTEGER AS f FROM {_LINES}", setup=_baskets)
_cut_of_order("coll_sort_key", "SELECT l_orderkey FROM basket ORDER BY MAX(qty) DESC, SUM(qty), l_orderkey", f"SELECT l_orderkey FROM {_LINES} ORDER BY list_max(qty) DESC, list_sum(qty), l_orderkey", setup=_baskets)
_text("coll_group_key", "SELECT COUNT(*) AS n, MAX(l_orderkey) AS m FROM basket GROUP BY flags", f"SELECT count(*) AS n, max(l_orderkey) AS m FROM {_LINES} GROUP BY flags[1]", setup=_baskets)
_text("coll_scan", "SELECT value AS q, COUNT(*) AS n FROM basket.qty AS q GROUP BY value", "SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY l_quantity", setup=_baskets)
_text("struct_fields", "SELECT l_orderkey, info.n AS n, info.head AS h FROM basket", f"SELECT l_orderkey, len(qty)::INTEGER AS n, qty[1] AS h FROM {_LINES}", setup=_baskets)
_text("map_lookup", "SELECT l_orderkey, attrs['first'] AS f, {'a' -> 1, 'b' -> 2}['b'] AS b FROM basket", f"SELECT l_orderkey, flags[1] AS f, 2::INTEGER AS b FROM {_LINES}", setup=_baskets)
_text("vec_norm", "SELECT vec_id, NORM(embedding) AS n FROM embeddings", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS n FROM embeddings", {"n": 9})
_text("vec_add", "SELECT vec_id, (embedding + embedding)[0] AS a, (embedding - embedding)[1] AS b, (embedding * 2)[2] AS c FROM embeddings", "SELECT vec_id, embedding[1] + embedding[1] AS a, embedding[2] - embedding[2] AS b, (embedding[3] * 2::FLOAT)::DOUBLE AS c FROM embeddings")
_text("vec_dot", "SELECT vec_id, embedding * embedding AS d FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE)), 6) AS d FROM embeddings", {"d": 6})
_text("mat_det", "SELECT p_partkey, DET([[p_size, 1.0], [2.0, 3.0]]) AS d, TRACE([[p_size, 1.0], [2.0, 3.0]]) AS t, RANK([[p_size, 1.0], [2.0 * p_size, 2.0]]) AS r FROM part", "SELECT p_partkey, round(p_size * 3.0::DOUBLE - 2, 6) AS d, p_size + 3.0::DOUBLE AS t, 1::INTEGER AS r FROM part", {"d": 6})
_text("mat_inv", "SELECT p_partkey, INV([[p_size, 0.0], [0.0, 4.0]])[0,0] AS a, TRANSPOSE([[1.0, 2.0], [3.0, 4.0]])[0,1] AS b, ([[1.0, 2.0], [3.0, 4.0]] * [[0.0, 1.0], [1.0, 0.0]])[1,0] AS c FROM part", "SELECT p_partkey, round(1.0::DOUBLE / p_size, 9) AS a, 3.0::DOUBLE AS b, 4.0::DOUBLE AS c FROM part", {"a": 9})
_text("mat_solve", "SELECT p_partkey, ([[p_size, 0.0], [0.0, 4.0]] / [[2.0, 0.0], [0.0, 2.0]])[0,0] AS a, TRACE([[p_size, 1.0], [2.0, p_size]]) AS t, RANK([[p_size, 1.0], [2.0 * p_size, 3.0]]) AS r, TRANSPOSE([[p_size, 2.0], [3.0, 4.0]])[1,0] AS u FROM part", "SELECT p_partkey, round(p_size / 2.0::DOUBLE, 9) AS a, 2.0::DOUBLE * p_size AS t, 2::INTEGER AS r, 2.0::DOUBLE AS u FROM part", {"a": 9})

# -- paths ----------------------------------------------------------------------------------------------------------


def _turns(s: Session) -> None:
    """Turns of conversations as rows that refer to the next turn."""
    c = s.spark.table(s.catalog.table("conversations").view).groupBy("conv_id", "turn").agg(F.first("role").alias("role"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ident = lambda t: F.col("conv_id") * 100000 + t
    s.register("turns", c.join(last, "conv_id").select(ident(F.col("turn")).alias("id"), "conv_id", "turn", "role", F.when(F.col("turn") < F.col("last"), ident(F.col("turn") + 1)).alias("next")), "id", {"next": "turns"})
    s.execute("CREATE CLASS openings AS SELECT * FROM turns WHERE turn = 0")


_TURNS = "(SELECT conv_id * 100000 + turn AS id, turn, conv_id, CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN conv_id * 100000 + turn + 1 END AS next FROM (SELECT DISTINCT conv_id, turn FROM conversations))"
_text("path_deref", "SELECT o_orderkey, o_custkey.c_nationkey.n_name AS nation FROM orders WHERE o_custkey.c_nationkey.n_regionkey.r_name = 'ASIA'", "SELECT o_orderkey, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_text("path_filter", "SELECT r_name, COUNT(*) AS n FROM supplier.s_nationkey[n_nationkey > 5].n_regionkey AS r GROUP BY r_name", "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_nationkey > 5 JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_text("path_repeat_bounded", "SELECT id FROM openings.next{1,2} AS t", f"WITH t AS {_TURNS} SELECT b.id FROM t a JOIN t b ON a.next = b.id WHERE a.turn = 0 UNION ALL SELECT c.id FROM t a JOIN t b ON a.next = b.id JOIN t c ON b.next = c.id WHERE a.turn = 0", setup=_turns)
_text("path_repeat_star", "SELECT id FROM openings.next{*} AS t", f"WITH RECURSIVE t AS {_TURNS}, r(id) AS (SELECT id FROM t WHERE turn = 0 UNION SELECT t.next FROM r JOIN t USING (id) WHERE t.next IS NOT NULL) SELECT id FROM r", setup=_turns)
_text("path_repeat_filter", "SELECT id FROM openings.next[role <> 't.user' AND turn <> 2]{1,3} AS t", f"WITH t AS {_TURNS} SELECT b.id FROM t a JOIN t b ON a.next = b.id WHERE a.turn = 0 AND b.turn <> 2", setup=_turns)
_text("path_repeat_last", "SELECT id FROM openings.next{1,3}[turn <> 2] AS t", f"WITH t AS {_TURNS} SELECT b.id FROM t a JOIN t b ON a.next = b.id WHERE a.turn = 0 AND b.turn <> 2 UNION ALL SELECT c.id FROM t a JOIN t b ON a.next = b.id JOIN t c ON b.next = c.id WHERE a.turn = 0 AND c.turn <> 2 UNION ALL SELECT d.id FROM t a JOIN t b ON a.next = b.id JOIN t c ON b.next = c.id JOIN t d ON c.next = d.id WHERE a.turn = 0 AND d.turn <> 2", setup=_turns)
_text("path_depth", "SELECT depth, COUNT(*) AS n FROM openings.next{+} AS t GROUP BY depth", f"SELECT turn::INTEGER AS depth, count(*) AS n FROM {_TURNS} WHERE turn > 0 GROUP BY turn", setup=_turns, path_depth=True)
_text("path_class", "SELECT id FROM openings.next[@ IS A second]{1,2} AS t", f"SELECT id FROM {_TURNS} WHERE turn = 1", setup=lambda s: (_turns(s), s.execute("CREATE CLASS second AS SELECT * FROM turns WHERE turn = 1")))


def _grid(s: Session) -> None:
    """Nations as a graph with diamonds and cycles: each leads to the next one and to the one five further on, round and round."""
    n = s.spark.table(s.catalog.table("nation").view)
    to = lambda k: ((F.col("n_nationkey") + k) % 25).cast("long")
    s.register("grid", n.select(F.col("n_nationkey").cast("long").alias("id"), to(1).alias("a"), to(5).alias("b"), F.array(to(1), to(5)).alias("both")), "id", {"a": "grid", "b": "grid", "both": "grid"})
    s.execute("CREATE CLASS corner AS SELECT * FROM grid WHERE id IN (0, 7)")


_GRID = "(SELECT n_nationkey::BIGINT AS id, unnest([(n_nationkey + 1) % 25, (n_nationkey + 5) % 25])::BIGINT AS dst FROM nation)"
_text("path_diamond", "SELECT id, COUNT(*) AS n FROM corner.both{2,3} AS t GROUP BY id", f"WITH e AS {_GRID}, w AS (SELECT a.dst AS id FROM e s JOIN e a ON s.dst = a.id WHERE s.id IN (0, 7) UNION ALL SELECT b.dst FROM e s JOIN e a ON s.dst = a.id JOIN e b ON a.dst = b.id WHERE s.id IN (0, 7)) SELECT id, count(*) AS n FROM w GROUP BY id", setup=_grid)
_text("path_several", "SELECT id, COUNT(*) AS n FROM corner.{a, b}{1,2} AS t GROUP BY id", f"WITH e AS {_GRID}, w AS (SELECT dst AS id FROM e WHERE id IN (0, 7) UNION ALL SELECT a.dst FROM e s JOIN e a ON s.dst = a.id WHERE s.id IN (0, 7)) SELECT id, count(*) AS n FROM w GROUP BY id", setup=_grid)
_text("path_cycle_star", "SELECT id, COUNT(*) AS n FROM corner.both{*} AS t GROUP BY id", "SELECT n_nationkey::BIGINT AS id, 2::BIGINT AS n FROM nation", setup=_grid)
_text("path_element", "SELECT id FROM corner.both[:LAST] AS t", f"SELECT dst AS id FROM {_GRID} WHERE id IN (0, 7) AND dst - id = 5", setup=_grid)
_text("path_through", "SELECT id, a.b.id AS there FROM grid WHERE a.b.a.id > 20", "SELECT n_nationkey::BIGINT AS id, ((n_nationkey + 6) % 25)::BIGINT AS there FROM nation WHERE (n_nationkey + 7) % 25 > 20", setup=_grid)
_text("path_wildcard", "SELECT n_name, COUNT(*) AS n FROM supplier.* AS x GROUP BY n_name", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_text("path_values", "SELECT value, COUNT(*) AS n FROM basket.flags AS f GROUP BY value", f"SELECT value, count(*) AS n FROM (SELECT unnest(flags) AS value FROM {_LINES}) GROUP BY value", setup=_baskets)

# -- free text ------------------------------------------------------------------------------------------------------

_WORDS = f"regexp_extract_all(lower(text), '{WORD.replace(chr(39), chr(39) * 2)}')"
_any = lambda *ws: " OR ".join(f"starts_with(w, '{w}')" for w in ws)
_text("ft_any", "SELECT doc_id FROM documents MATCH (text) AGAINST ('thing thread')", f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda w: {_any('thing', 'thread')})) > 0")
_text("ft_all", "SELECT doc_id FROM documents MATCH (text) AGAINST ('thon thnt')", f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda w: {_any('thon')})) > 0 AND len(list_filter({_WORDS}, lambda w: {_any('thnt')})) > 0", all_words=True)
_text("ft_stems", "SELECT o_orderkey FROM orders MATCH (o_orderpriority) AGAINST ('specifying')", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
_text("ft_plurals", "SELECT p_partkey FROM part MATCH (p_name) AGAINST ('rings', 'smalls hots')", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring') AND (contains(p_name, 'small') OR contains(p_name, 'hot'))")
_text("ft_stop_words", "SELECT o_orderkey FROM orders MATCH (o_orderpriority) AGAINST ('not high')", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'", filter_stop_words=True)
_text("ft_stop_words_asked", "SELECT p_partkey FROM part MATCH (p_name) AGAINST ('small the')", "SELECT p_partkey FROM part WHERE contains(p_name, 'small')")


def _indexed(name: str, query: str) -> None:
    """The same answers from the index as from the texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        s.index_text("documents", "text")
        s.index_text("orders", "o_orderpriority")
        return s.execute(query)

    QUERIES[name] = run


for _name, _query, _duck in (
    ("ft_indexed", "SELECT doc_id FROM documents MATCH (text) AGAINST ('thing thread')", ORACLE["ft_any"]),
    ("ft_indexed_prefix", "SELECT doc_id FROM documents MATCH (text) AGAINST ('thth', 'ou')", None),
    ("ft_indexed_phrase", "SELECT doc_id FROM documents MATCH (text) AGAINST ('\"of the\"')", None),
    ("ft_indexed_stems", "SELECT o_orderkey FROM orders MATCH (o_orderpriority) AGAINST ('specifying urgently')", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '1-URGENT')"),
):
    _indexed(_name, _query)
    if _duck:
        ORACLE[_name] = _duck
_text("ft_prefix", "SELECT doc_id FROM documents MATCH (text) AGAINST ('thth', 'ou')", f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda w: {_any('thth')})) > 0 AND len(list_filter({_WORDS}, lambda w: {_any('ou')} AND w NOT IN ('ought', 'our', 'ours', 'ourselves', 'out'))) > 0")
_text("ft_phrase", "SELECT doc_id FROM documents MATCH (text) AGAINST ('\"of the\"')", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' of the ')")


ORACLE["ft_indexed_prefix"], ORACLE["ft_indexed_phrase"] = ORACLE["ft_prefix"], ORACLE["ft_phrase"]


@_code("ft_index", """SELECT stem AS word, o_orderkey AS key, 'o_orderpriority' AS prop, 1::BIGINT AS n FROM orders JOIN (VALUES ('1-URGENT', 'urgent'), ('2-HIGH', 'high'), ('3-MEDIUM', 'medium'), ('4-NOT SPECIFIED', 'specifi'), ('5-LOW', 'low')) v(p, stem) ON p = o_orderpriority""")
def _ft_index(spark, sf_dir):
    """Stems, without stop words and words of one sign."""
    return text_search.index(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_orderpriority")


@_code("ft_index_counts", f"SELECT w AS word, doc_id AS key, 'text' AS prop, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE regexp_matches(w, '^[0-9]{{2,}}$') GROUP BY ALL")
def _ft_index_counts(spark, sf_dir):
    """Counts of words in whole texts, of numbers, which have no stems."""
    return text_search.index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").where(F.col("word").rlike("^[0-9]{2,}$"))


@_code("ft_vocabulary", f"SELECT DISTINCT w AS word FROM (SELECT unnest({_WORDS}) AS w FROM documents) WHERE starts_with(w, 'the')")
def _ft_vocabulary(spark, sf_dir):
    return text_search.vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), "the", "text")


# -- classes, events ------------------------------------------------------------------------------------------------


def _classes(s: Session) -> None:
    s.execute("""CREATE CLASS clicks AS SELECT * FROM events WHERE event_type = 'click'; CREATE CLASS dear AS SELECT * FROM events WHERE value > 100;
        CREATE CLASS dearclicks AS SELECT * FROM clicks WHERE value > 100; CREATE CLASS priced AS SELECT * FROM orders WHERE o_custkey = :0 AND o_totalprice >= :1(DOUBLE,DESC)""")


_text("class_member", "SELECT event_id, value FROM dearclicks", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 100", setup=_classes)
_text("class_intersect", "SELECT event_id FROM clicks & dear", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 100", setup=_classes)
_text("is_a", "SELECT event_id FROM events AS e WHERE e IS A clicks AND NOT e IS A dear", "SELECT event_id FROM events WHERE event_type = 'click' AND NOT coalesce(value > 100, FALSE)", setup=_classes)
_text("family_param", "SELECT o_orderkey FROM priced(@[10, 100], 50000.0)", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 100 AND o_totalprice >= 50000", setup=_classes)
_text("family_any", "SELECT o_orderkey FROM priced(*, 250000.0)", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000", setup=_classes)
_text("dataevents", "SELECT event_id, CONCAT(DATAEVENTS(@)) AS c FROM events", "SELECT event_id, (CASE WHEN event_type = 'click' THEN 'clicks' ELSE '' END) || (CASE WHEN value > 100 THEN 'dear' ELSE '' END) || (CASE WHEN event_type = 'click' AND value > 100 THEN 'dearclicks' ELSE '' END) AS c FROM events", setup=_classes)


@_code("rule", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50")
def _rule(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("""CREATE CLASS buys AS SELECT * FROM events WHERE event_type = 'purchase'; CREATE CONDITION above AS value > :0; CREATE ACTION nothing AS SELECT 1; RULE big : buys AND above(50) -> nothing""")
    return s.execute("SELECT event_id FROM big")


@_code("window_count", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def _window_count(spark, sf_dir):
    return windows.last_n(session(spark, sf_dir).execute("SELECT event_id, user_id, ts FROM events"), 5, "ts", "event_id", by=["user_id"]).select("user_id", "event_id")


@_code("window_interval", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def _window_interval(spark, sf_dir):
    return windows.last_interval(session(spark, sf_dir).execute("SELECT event_id, ts FROM events"), 86400, "ts").select("event_id")


@_code("window_running", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n_window FROM events")
def _window_running(spark, sf_dir):
    return windows.running_count(session(spark, sf_dir).execute("SELECT event_id, user_id, ts FROM events"), 21600, "ts", ["user_id"]).select("event_id", "n_window")


@_code("timer_bucket", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL 1 HOUR AS tick, count(*) AS n FROM events GROUP BY ALL")
def _timer_bucket(spark, sf_dir):
    return windows.timer_buckets(session(spark, sf_dir).execute("SELECT ts FROM events"), 3600, "ts")


@_code("class_changes", """SELECT event_id, CASE WHEN value <= 100 AND value + 20 > 100 THEN 'enter' WHEN value > 100 THEN 'update' END AS kind FROM events WHERE value + 20 > 100""")
def _class_changes(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("CREATE CLASS dear AS SELECT * FROM events WHERE value > 100")
    old = s.execute("SELECT event_id, event_id AS pin_id, value FROM events")
    return class_events.changes(s, "events", old, old.withColumn("value", F.col("value") + 20)).select(F.col("pin_id").alias("event_id"), "kind")


@_code("fsm_batch", """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END) AS r FROM events),
    f(user_id, r, was, now) AS (SELECT user_id, r, 'idle', CASE WHEN event_type = 'view' THEN 'looking' ELSE 'idle' END FROM e WHERE r = 1
    UNION ALL SELECT e.user_id, e.r, f.now, CASE WHEN f.now = 'idle' AND event_type = 'view' THEN 'looking' WHEN f.now = 'looking' AND event_type = 'purchase' THEN 'bought' WHEN f.now = 'bought' AND event_type = 'view' THEN 'looking' ELSE f.now END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
    SELECT now, count(*) AS n FROM f GROUP BY now""")
def _fsm_batch(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("""CREATE CLASS views AS SELECT * FROM events WHERE event_type = 'view'; CREATE CLASS buys AS SELECT * FROM events WHERE event_type = 'purchase';
        CREATE FSM shop AS {idle:{t={WHEN views IS INSERTED -> looking}}, looking:{t={WHEN buys IS INSERTED -> bought}}, bought:{t={WHEN views IS INSERTED -> looking}}}""")
    steps = machines.run_batch(s, "shop", s.execute("SELECT * FROM events"), "user_id", "ts", "events")
    return steps.groupBy("now").agg(F.count("*").alias("n"))


# -- changes --------------------------------------------------------------------------------------------------------


def _changed(script: str, result: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
        s = Session(spark, store).register_parquet(sf_dir)
        s.execute("INSERT INTO land SELECT n_nationkey AS code, n_name AS label, n_regionkey AS area FROM nation")
        s.execute(script)
        return s.execute(result)

    return run


for _name, _script, _result, _duck in (
    ("update_set", "UPDATE land SET code += 100, label = 'x' || label WHERE area = 1", "SELECT code, label, area FROM land", "SELECT CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS code, CASE WHEN n_regionkey = 1 THEN 'x' || n_name ELSE n_name END AS label, n_regionkey AS area FROM nation"),
    ("update_add_elem", "UPDATE land SET tags = {'a', 'b'} WHERE area = 2; UPDATE land ADD tags[BEFORE 1] = 'z' WHERE area = 2", "SELECT code, CONCAT(tags) AS t FROM land", "SELECT n_nationkey AS code, CASE WHEN n_regionkey = 2 THEN 'azb' END AS t FROM nation"),
    ("delete_soft", "DELETE FROM land WHERE area > 2; UNDELETE FROM land WHERE area = 4", "SELECT code FROM land", "SELECT n_nationkey AS code FROM nation WHERE n_regionkey <= 2 OR n_regionkey = 4"),
    ("purge", "PURGE FROM land WHERE area > 2", "SELECT code FROM land", "SELECT n_nationkey AS code FROM nation WHERE n_regionkey <= 2"),
    ("insert_select", "INSERT INTO land SELECT r_regionkey AS code, r_name AS label, 99 AS area FROM region", "SELECT code, label, area FROM land", "SELECT n_nationkey AS code, n_name AS label, n_regionkey AS area FROM nation UNION ALL SELECT r_regionkey, r_name, 99 FROM region"),
    ("tx_rollback", "START TRANSACTION; DELETE FROM land WHERE area = 0; ROLLBACK; START TRANSACTION; DELETE FROM land WHERE area = 1; COMMIT", "SELECT code FROM land", "SELECT n_nationkey AS code FROM nation WHERE n_regionkey <> 1"),
    ("trigger_action", "CREATE CLASS far AS SELECT * FROM land WHERE code > 20 SET onEnter=${INSERT INTO seen (what) VALUES (@self.label)}; UPDATE land SET code += 10 WHERE area = 3", "SELECT what FROM seen", "SELECT n_name AS what FROM nation WHERE n_regionkey = 3 AND n_nationkey + 10 > 20 AND n_nationkey <= 20"),
    ("insert_values", "INSERT INTO land (code, label, area) VALUES (100, 'one', 9), (101, 'two', 9); INSERT INTO land @{code=102, label='three'}", "SELECT code, label, area FROM land", "SELECT n_nationkey AS code, n_name AS label, n_regionkey AS area FROM nation UNION ALL SELECT * FROM (VALUES (100, 'one', 9), (101, 'two', 9), (102, 'three', NULL)) t"),
    ("insert_idempotent", "INSERT INTO land IDEMPOTENT (code, label, area) VALUES (3, 'NATION_3', 3), (200, 'new', 1)", "SELECT code, label, area FROM land", "SELECT n_nationkey AS code, n_name AS label, n_regionkey AS area FROM nation UNION ALL SELECT * FROM (VALUES (200, 'new', 1)) t"),
    ("insert_parts", "INSERT INTO land @{label='whole', area=50, kids=(INSERT PART INTO land @{label='k1', area=51}, @{label='k2', area=51})}", "SELECT a.label AS part, b.label AS whole FROM land AS a JOIN land AS b ON a.parent_id = b.pin_id", "SELECT * FROM (VALUES ('k1', 'whole'), ('k2', 'whole')) t(part, whole)"),
    ("delete_parts", "INSERT INTO land @{label='whole', area=50, kids=(INSERT PART INTO land @{label='k1', area=51}, @{label='k2', area=51})}; DELETE FROM land WHERE area = 50 OR area = 0", "SELECT label FROM land", "SELECT n_name AS label FROM nation WHERE n_regionkey <> 0"),
    ("insert_references", "INSERT INTO pair @:1 @{name='x', friend=@:2}, @:2 @{name='y', friend=@:1}", "SELECT a.name AS a, b.name AS b FROM pair AS a JOIN pair AS b ON a.friend = b.pin_id", "SELECT * FROM (VALUES ('x', 'y'), ('y', 'x')) t(a, b)"),
    ("copy_with_override", "CREATE CLASS far AS SELECT * FROM land WHERE code > 30 SET onEnter=${INSERT @self, @{code = 5, area = 77}}; UPDATE land SET code += 20 WHERE area = 3", "SELECT code, label, area FROM land", "SELECT CASE WHEN n_regionkey = 3 THEN n_nationkey + 20 ELSE n_nationkey END AS code, n_name AS label, n_regionkey AS area FROM nation UNION ALL SELECT 5, n_name, 77 FROM nation WHERE n_regionkey = 3 AND n_nationkey + 20 > 30"),
    ("event_context", "CREATE CLASS far AS SELECT * FROM land WHERE code > 20 SET onEnter=${INSERT INTO seen (what, how, by) VALUES (@self.label, @event.kind || '/' || @event.class, @ctx.who)}, onLeave=${INSERT INTO seen (what, how) VALUES (@self.label, @event.kind)}; UPDATE land SET code += 10 WHERE area = 3; UPDATE land SET code = 0 WHERE area = 4", "SELECT what, how FROM seen", "SELECT n_name AS what, 'enter/far' AS how FROM nation WHERE n_regionkey = 3 AND n_nationkey + 10 > 20 AND n_nationkey <= 20 UNION ALL SELECT n_name, 'leave' FROM nation WHERE n_regionkey = 4 AND n_nationkey > 20"),
    ("is_changed", "CREATE CLASS moved AS SELECT * FROM land WHERE ISCHANGED(area) SET onEnter=${INSERT INTO seen (what) VALUES (@self.label)}; UPDATE land SET area = area % 3", "SELECT what FROM seen", "SELECT n_name AS what FROM nation WHERE n_regionkey > 2"),
    ("select_raw", "DELETE FROM land WHERE area > 2", "SELECT RAW code FROM land", "SELECT n_nationkey AS code FROM nation"),
    ("drop_class", "CREATE CLASS few AS SELECT * FROM land WHERE area = 1; DROP CLASS few; CREATE CLASS few AS SELECT * FROM land WHERE area = 2", "SELECT code FROM few", "SELECT n_nationkey AS code FROM nation WHERE n_regionkey = 2"),
    ("class_window_count", "CREATE CLASS last AS SELECT * FROM land WHERE area < 3 ORDER BY code SET window=4", "SELECT code FROM last", "SELECT n_nationkey AS code FROM nation WHERE n_regionkey < 3 ORDER BY code DESC LIMIT 4"),
    ("class_window_clock", "CREATE CLASS recent AS SELECT * FROM land ORDER BY created SET window=INTERVAL '-24:00:00'; UPDATE land SET area = 9 WHERE area = 1", "SELECT code FROM recent WHERE area <> 9", "SELECT n_nationkey AS code FROM nation WHERE n_regionkey <> 1"),
    ("rename_delete", "UPDATE land RENAME label = title WHERE area = 1; UPDATE land DELETE label WHERE area = 2", "SELECT code, label, title FROM land", "SELECT n_nationkey AS code, CASE WHEN n_regionkey NOT IN (1, 2) THEN n_name END AS label, CASE WHEN n_regionkey = 1 THEN n_name END AS title FROM nation"),
    ("rule_action", "CREATE CLASS north AS SELECT * FROM land WHERE area = 1; CREATE CONDITION above AS code > :0; CREATE ACTION note AS INSERT INTO seen (what) VALUES (@self.label); RULE big : north AND above(50) -> note; UPDATE land SET code += 40 WHERE code > 11", "SELECT what FROM seen", "SELECT n_name AS what FROM nation WHERE n_regionkey = 1 AND n_nationkey > 11 AND n_nationkey + 40 > 50"),
):
    _code(_name, _duck)(_changed(_script, _result))


def _store_session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark, Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")).register_parquet(sf_dir)
    s.execute("INSERT INTO land SELECT n_nationkey AS code, n_name AS label, n_regionkey AS area FROM nation")
    return s


@_code("batch_insert", "SELECT n_nationkey AS code, n_name AS label FROM nation UNION ALL SELECT * FROM (VALUES (70, 'dee'), (71, 'eve')) t")
def _batch_insert(spark, sf_dir):
    s = _store_session(spark, sf_dir)
    Batch(s, "land").add(code=70, label="dee").add(code=71, label="eve").run()
    return s.execute("SELECT code, label FROM land")


@_code("modify_stamp", "SELECT n_nationkey AS code, CASE WHEN n_nationkey = 7 THEN 'first' ELSE n_name END AS label FROM nation")
def _modify_stamp(spark, sf_dir):
    """Of two changes that go by the same stamp the second fails."""
    s = _store_session(spark, sf_dir)
    row = s.execute("SELECT pin_id, stamp FROM land WHERE code = 7").first()
    s.store.modify("land", row["pin_id"], {"label": "first"}, row["stamp"])
    with contextlib.suppress(Conflict):
        s.store.modify("land", row["pin_id"], {"label": "second"}, row["stamp"])
    return s.execute("SELECT code, label FROM land")


@_code("failing_action", "SELECT n_nationkey AS code, n_regionkey AS area FROM nation")
def _failing_action(spark, sf_dir):
    """An action that fails takes its statement back."""
    s = _store_session(spark, sf_dir)
    s.execute("CREATE CLASS bad AS SELECT * FROM land WHERE area = 99 SET onEnter=${INSERT INTO bad UNIQUE (code, area) VALUES (1, 1)}")
    with contextlib.suppress(Conflict):
        s.execute("UPDATE land SET area = 99 WHERE area = 1")
    return s.execute("SELECT code, area FROM land")


@_code("inject_message", "SELECT 'ring' AS what")
def _inject_message(spark, sf_dir):
    s = _store_session(spark, sf_dir)
    s.execute("CREATE CLASS bell AS SELECT * FROM land WHERE label = 'ring' SET onEnter=${INSERT INTO seen (what) VALUES (@self.label)}")
    s.inject("land", label="ring", code=1)
    return s.execute("SELECT what FROM seen")


@_code("notifications", "SELECT 'enter' AS kind, count(*) AS n FROM nation WHERE n_regionkey = 3 AND n_nationkey + 10 > 20 AND n_nationkey <= 20 UNION ALL SELECT 'update', count(*) FROM nation WHERE n_regionkey = 3 AND n_nationkey > 20")
def _notifications(spark, sf_dir):
    s, seen = _store_session(spark, sf_dir), []
    s.execute("CREATE CLASS far AS SELECT * FROM land WHERE code > 20")
    class_events.listen(s, lambda kind, rows: seen.append((kind, rows.count())), "far")
    s.execute("UPDATE land SET code += 10 WHERE area = 3")
    return spark.createDataFrame(seen, "kind string, n long")


@_code("handler_actions", "SELECT n_name AS what, CASE WHEN n_regionkey = 1 THEN 'north' ELSE 'rest' END AS how FROM nation WHERE n_nationkey < 20")
def _handler_actions(spark, sf_dir):
    s = _store_session(spark, sf_dir)
    s.execute("""CREATE CLASS north AS SELECT * FROM land WHERE area = 1;
        CREATE EVENT HANDLER h AS {WHEN north IS INSERTED AND code < 20 -> {INSERT INTO seen (what, how) VALUES (@self.label, 'north')}, WHEN * IS INSERTED AND code < 20 -> {INSERT INTO seen (what, how) VALUES (@self.label, 'rest')}}""")
    machines.handle(s, "h", s.execute("SELECT * FROM land"), "land")
    return s.execute("SELECT what, how FROM seen")


@_code("machine_actions", """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f(user_id, r, event_id, was, now) AS (SELECT user_id, r, event_id, 'idle', CASE WHEN event_type = 'view' THEN 'looking' ELSE 'idle' END FROM e WHERE r = 1
    UNION ALL SELECT e.user_id, e.r, e.event_id, f.now, CASE WHEN f.now = 'idle' AND event_type = 'view' THEN 'looking' WHEN f.now = 'looking' AND event_type = 'purchase' THEN 'idle' ELSE f.now END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
    SELECT event_id AS what FROM f WHERE was = 'looking' AND now = 'idle'""")
def _machine_actions(spark, sf_dir):
    """Every purchase that follows a view of the same user is written down by the machine."""
    s = _store_session(spark, sf_dir)
    s.execute("""CREATE CLASS views AS SELECT * FROM events WHERE event_type = 'view'; CREATE CLASS buys AS SELECT * FROM events WHERE event_type = 'purchase';
        CREATE FSM shop AS {idle:{t={WHEN views IS INSERTED -> looking}}, looking:{t={WHEN buys IS INSERTED -> {INSERT INTO seen (what) VALUES (@self.event_id)} -> idle}}}""")
    machines.run_actions(s, "shop", machines.run_batch(s, "shop", s.execute("SELECT * FROM events"), "user_id", "ts", "events"), "events")
    return s.execute("SELECT what FROM seen")


@_code("communication", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name FROM nation")
def _communication(spark, sf_dir):
    """Rows written through a stack of services, JSON and files, and read back."""
    s = session(spark, sf_dir)
    s.execute(f"CREATE COMMUNICATION box AS {{service={{'file', 'json'}}, address='{shared_dir(spark)}/box-{uuid.uuid4().hex}', format='text', schema='n_nationkey int, n_name string'}}")
    services.write(s, "box", s.execute("SELECT n_nationkey, n_name FROM nation"))
    return s.execute("SELECT n_nationkey, n_name FROM box")


@_code("regex_service", "SELECT regexp_extract(n_name, '([A-Z]+)_([0-9]+)', 1) AS word, regexp_extract(n_name, '([A-Z]+)_([0-9]+)', 2) AS number FROM nation")
def _regex_service(spark, sf_dir):
    s = session(spark, sf_dir)
    return services.RegexService().read(s, s.execute("SELECT n_name AS value FROM nation"), {"pattern": "([A-Z]+)_([0-9]+)", "fields": ["word", "number"]})


@_code("encryption_service", "SELECT n_name AS value, TRUE AS hidden FROM nation")
def _encryption_service(spark, sf_dir):
    s, service, key = session(spark, sf_dir), services.EncryptionService(), {"key": "0123456789abcdef"}
    secret = service.write(s, s.execute("SELECT n_name AS value, n_name FROM nation"), key).withColumn("hidden", ~F.contains(F.hex("value"), F.hex("n_name")))
    return service.read(s, secret, key).select("value", "hidden")


@_code("statement_service", "SELECT 'SELECT a FROM t WHERE (b = ' || n_nationkey || ')' AS value FROM nation")
def _statement_service(spark, sf_dir):
    s = session(spark, sf_dir)
    return services.StatementService().read(s, s.execute("SELECT 'select  a from t where b=' || n_nationkey AS value FROM nation"), {})
