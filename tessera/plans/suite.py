"""The registered queries of the engine and their SQL twins.

Most queries are texts in the engine's dialect: the engine runs them on Spark,
the oracle runs the same text. Queries that are built with the DataFrame
operators have an SQL twin of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..engine import Engine
from ..functions import scalars as S
from ..session import scratch
from .tpch import QUERIES as TPCH

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Small inline tables with nulls, as common table expressions.
_T = "t AS (SELECT * FROM (VALUES (1), (2), (3), (8), (CAST(NULL AS INTEGER))) AS v(x))"
_S = "s AS (SELECT * FROM (VALUES (2), (CAST(NULL AS INTEGER))) AS v(y))"
_ORD = "ord AS (SELECT * FROM (VALUES (1, 10, 100, 'east'), (2, 10, 50, 'east'), (3, 20, 30, 'west'), (4, 30, 70, 'west'), (5, 20, 25, 'east'), (6, 10, 0, 'north'), (7, 30, 12, 'south'), (8, 40, 200, 'west')) AS v(o_id, cust, amount, region))"
_CUS = "cus AS (SELECT * FROM (VALUES (10, 'alice', 1), (20, 'bob', 2), (30, 'carol', 1), (50, 'dave', 3)) AS v(c_id, name, tier))"
#: The same shape from whole tables: null and frequent keys, and keys without a partner on either side.
_ORDERS = "ord AS (SELECT o_orderkey AS o_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust, o_totalprice AS amount FROM orders)"
_CUSTOMERS = "cus AS (SELECT c_custkey + 100 AS c_id, c_name AS name, c_nationkey AS tier FROM customer)"
_TIER = "tiers AS (SELECT * FROM (VALUES (1, 'gold'), (2, 'silver'), (3, 'bronze')) AS v(t_id, label))"

SQL = {
    # projection, filter, limit, sort, top-n
    "projection": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity + 1 AS q1 FROM lineitem",
    "projection_constants": "SELECT o_orderkey, 7 AS seven, 'x' AS s, CAST(1.5 AS DOUBLE) + 0 AS d, TRUE AS yes FROM orders",
    "filter_comparisons": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderstatus <> 'F'",
    "filter_or_not": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "filter_in_list": "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 40) OR p_brand IN ('Brand#1', 'Brand#2')",
    "filter_large_in_list": "SELECT p_partkey FROM part WHERE p_partkey IN (" + ", ".join(str(i * 7) for i in range(300)) + ")",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_name NOT LIKE 'b%'",
    "filter_is_null": f"WITH {_T} SELECT x FROM t WHERE x IS NULL OR x > 2",
    "filter_distinct_from": f"WITH {_T} SELECT x, x IS DISTINCT FROM 2 AS other FROM t WHERE x IS NOT DISTINCT FROM NULL OR x IS DISTINCT FROM 3",
    "filter_never": "SELECT o_orderkey FROM orders WHERE 1 = 0",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    "sort_many_keys": "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 48 ORDER BY l_returnflag DESC, l_linestatus, l_orderkey, l_linenumber",
    "sort_nulls": f"WITH {_T} SELECT x FROM t ORDER BY x DESC",
    "sort_nulls_first": f"WITH {_T} SELECT x FROM t ORDER BY x NULLS FIRST LIMIT 2",
    "sort_expression": "SELECT n_nationkey FROM nation ORDER BY n_nationkey % 7 DESC, n_nationkey LIMIT 9",
    "top_n": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "top_n_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 7 OFFSET 100",
    "top_n_nulls": f"WITH {_T} SELECT x FROM t ORDER BY x DESC LIMIT 5",
    # aggregates
    "aggregate_grouped": "SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS k, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS lo, max(o_orderdate) AS hi, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus",
    "aggregate_global": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS lo, max(l_returnflag) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem",
    "aggregate_empty_global": "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, avg(l_quantity) AS a FROM lineitem WHERE l_quantity < 0",
    "aggregate_empty_grouped": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag",
    "aggregate_null_group": f"WITH {_T} SELECT CASE WHEN x > 2 THEN NULL ELSE x END AS g, count(*) AS n, count(x) AS k, CAST(sum(x) AS BIGINT) AS s FROM t GROUP BY CASE WHEN x > 2 THEN NULL ELSE x END",
    "aggregate_expression_key": "SELECT o_orderkey % 10 AS g, extract(year FROM o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_orderkey % 10, extract(year FROM o_orderdate)",
    "aggregate_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag",
    "aggregate_distinct_global": "SELECT count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, min(DISTINCT l_quantity) AS q FROM lineitem",
    "aggregate_distinct_mixed": "SELECT o_custkey % 5 AS g, count(*) AS n, count(DISTINCT o_custkey) AS c, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey % 5",
    "aggregate_keys_only": "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "aggregate_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000000",
    "aggregate_first": "SELECT n_regionkey, first(k) AS k FROM (SELECT n_regionkey, n_regionkey * 2 AS k FROM nation) AS d GROUP BY n_regionkey",
    "aggregate_decimal": "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS s, round(avg(CAST(l_discount AS DECIMAL(15,2))), 8) AS a, min(CAST(l_tax AS DECIMAL(15,2))) AS lo FROM lineitem GROUP BY l_returnflag",
    "aggregate_of_join": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name",
    "aggregate_twice": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS d GROUP BY n",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    "join_comma": "SELECT s_name, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "join_left": f"WITH {_ORD}, {_CUS} SELECT o_id, cust, name FROM ord LEFT JOIN cus ON cust = c_id",
    "join_right": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord RIGHT JOIN cus ON cust = c_id",
    "join_full": f"WITH {_ORD}, {_CUS} SELECT o_id, cust, c_id, name FROM ord FULL OUTER JOIN cus ON cust = c_id",
    "join_three": f"WITH {_ORD}, {_CUS}, {_TIER} SELECT label, CAST(sum(amount) AS BIGINT) AS total FROM ord JOIN cus ON cust = c_id JOIN tiers ON tier = t_id GROUP BY label",
    "join_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "join_semi_exists": "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "join_anti_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)",
    "join_not_in_null": f"WITH {_T}, {_S} SELECT x FROM t WHERE x NOT IN (SELECT y FROM s)",
    "join_mark": f"WITH {_T}, {_S} SELECT x, x IN (SELECT y FROM s) AS m FROM t",
    "join_mark_not_null": f"WITH {_T}, {_S} SELECT x, x IN (SELECT y FROM s WHERE y IS NOT NULL) AS m, x NOT IN (SELECT y FROM s WHERE y = 3) AS n FROM t",
    "join_residual": "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 5 AND l_quantity > 45",
    "join_left_residual": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord LEFT JOIN cus ON cust = c_id AND amount > tier * 40",
    "join_full_residual": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord FULL JOIN cus ON cust = c_id AND amount > 40",
    "join_semi_residual": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice)",
    "join_left_whole": f"WITH {_ORDERS}, {_CUSTOMERS} SELECT o_id, cust, name FROM ord LEFT JOIN cus ON cust = c_id AND amount > tier * 9000",
    "join_right_whole": f"WITH {_ORDERS}, {_CUSTOMERS} SELECT o_id, c_id, name FROM ord RIGHT JOIN cus ON cust = c_id",
    "join_full_whole": f"WITH {_ORDERS}, {_CUSTOMERS} SELECT o_id, cust, c_id, name FROM ord FULL OUTER JOIN cus ON cust = c_id AND amount > 50000",
    "join_theta_whole": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal > c_acctbal + 9800",
    "join_theta_left_whole": "SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN nation ON s_acctbal > n_nationkey * 400 AND s_nationkey < n_nationkey",
    "aggregate_error_guard": "SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity < 0 THEN CAST(error('a negative quantity') AS INTEGER) ELSE l_linenumber END) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    "join_or_condition": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord JOIN cus ON (cust = c_id AND amount > 60) OR (cust = c_id AND tier = 2)",
    "join_theta": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord JOIN cus ON amount < c_id",
    "join_theta_left": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord LEFT JOIN cus ON amount < c_id - 20",
    "join_theta_full": f"WITH {_ORD}, {_CUS} SELECT o_id, name FROM ord FULL JOIN cus ON amount > c_id * 3",
    "join_cross": "SELECT r_name, n_name FROM region, nation",
    "join_expression_key": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 1 = r_regionkey + 1",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_null_safe": f"WITH {_T}, {_S} SELECT x, y FROM t JOIN s ON x IS NOT DISTINCT FROM y",
    "join_null_keys": f"WITH {_T}, {_S} SELECT x, y FROM t LEFT JOIN s ON x = y",
    "join_two_keys": "SELECT l_orderkey, l_linenumber, round(m, 2) AS m FROM lineitem JOIN (SELECT l_partkey AS p, l_suppkey AS s, max(l_extendedprice) AS m FROM lineitem GROUP BY l_partkey, l_suppkey) AS d ON l_partkey = p AND l_suppkey = s WHERE l_extendedprice < m",
    # subqueries and common table expressions
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)",
    "subquery_scalar_select": "SELECT n_name, (SELECT max(r_name) FROM region) AS m FROM nation",
    "subquery_correlated": "SELECT l_orderkey, l_linenumber FROM lineitem AS a WHERE l_quantity > (SELECT 1.6 * avg(l_quantity) FROM lineitem AS b WHERE b.l_partkey = a.l_partkey)",
    "subquery_correlated_select": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "subquery_nested": "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50) AND l_quantity > 30)",
    "subquery_not_exists_unequal": "SELECT count(*) AS n FROM lineitem AS a WHERE NOT EXISTS (SELECT 1 FROM lineitem AS b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)",
    "derived_table": "SELECT k, n FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS d (k, n) WHERE n > 14",
    "cte_shared": "WITH v AS (SELECT l_suppkey AS k, round(sum(l_extendedprice), 2) AS r FROM lineitem GROUP BY l_suppkey) SELECT k, r FROM v WHERE r = (SELECT max(r) FROM v) OR r = (SELECT min(r) FROM v)",
    "cte_materialized_shape": "WITH v AS MATERIALIZED (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.k, b.n FROM v AS a JOIN v AS b ON a.k = b.k".replace(" MATERIALIZED", ""),
    "group_by_alias": "SELECT o_orderkey % 3 AS g, count(*) AS n FROM orders GROUP BY g",
    "from_trailing_comma": "SELECT count(*) AS n FROM nation AS a, region AS b, WHERE n_regionkey = r_regionkey",
    # expressions and scalar functions
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_no_else": f"WITH {_T} SELECT x, CASE WHEN x > 2 THEN x END AS y FROM t",
    "three_valued": f"WITH {_T} SELECT x, x > 2 AND x < 9 AS a, x > 2 OR NULL AS o, NOT (x > 2) AS n FROM t",
    "coalesce": f"WITH {_T} SELECT coalesce(x, -1) AS x FROM t",
    "casts": "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS i, CAST(l_quantity / 2 AS INTEGER) AS h, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS VARCHAR) AS s, CAST(l_shipdate AS DATE) AS day FROM lineitem",
    "cast_operator": "SELECT n_nationkey::VARCHAR AS s, (n_nationkey * 0.5)::INTEGER AS h FROM nation",
    "cast_rounding": "SELECT CAST(v AS INTEGER) AS i, CAST(CAST(v AS DOUBLE) AS INTEGER) AS d FROM (VALUES (2.5), (3.5), (-2.5), (-0.4)) AS d(v)",
    "try_cast": "SELECT TRY_CAST(v AS INTEGER) AS i, TRY_CAST(v AS DOUBLE) AS d FROM (VALUES ('12'), ('x'), ('')) AS d(v)",
    "divide_float": "SELECT n_nationkey, 7 / (n_nationkey + 1) AS q, round(n_nationkey / 4, 4) AS r FROM nation",
    "divide_by_zero": "SELECT a, a / 0 AS q, CAST(a / 0 AS VARCHAR) IS NULL AS n FROM (VALUES (1), (-1)) AS d(a)",
    "divide_integer": "SELECT n_nationkey, CAST(n_nationkey // 4 AS BIGINT) AS q, n_nationkey % 4 AS r, CAST(2 * n_nationkey // 3 AS BIGINT) AS p FROM nation",
    "functions_rounding": "SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(p_retailprice, 1) AS r, trunc(p_retailprice) AS t, abs(p_retailprice - 1000) AS a, sign(p_retailprice - 1000) AS s FROM part".replace("abs(p_retailprice - 1000)", "round(abs(p_retailprice - 1000), 4)"),
    "functions_negative": "SELECT v, floor(v) AS f, ceiling(v) AS c, trunc(v) AS t, round(v) AS r, sign(v) AS s FROM (VALUES (CAST(-1.5 AS DOUBLE)), (CAST(2.5 AS DOUBLE)), (CAST(0 AS DOUBLE))) AS d(v)",
    "functions_logarithms": "SELECT p_partkey, round(ln(p_retailprice), 6) AS a, round(log(p_retailprice), 6) AS b, round(log2(p_retailprice), 6) AS c, round(log10(p_retailprice), 6) AS d, round(log(2, p_retailprice), 6) AS e, round(exp(p_size / 50.0), 6) AS f FROM part",
    "functions_powers": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(cbrt(p_retailprice), 6) AS b, pow(p_size, 2) AS c, power(p_size, 3) AS d, p_size ** 2 AS e, p_size ^ 2 AS f FROM part",
    "functions_strings": "SELECT p_partkey, prefix(p_name, 'red') AS a, suffix(p_name, 'ring') AS b, contains(p_name, 'e') AS c, substring(p_name, 2, 3) AS d, substr(p_name, 4) AS e FROM part",
    "functions_substring": "SELECT substring(v, 0, 2) AS a, substring(v, 1, 2) AS b, substring(v, -2, 2) AS c, substring(v FROM 2 FOR 3) AS d FROM (VALUES ('hello'), ('é日x')) AS d(v)",
    "functions_like_operators": "SELECT p_partkey FROM part WHERE p_name ~~ '%red%' AND p_brand !~~ 'Brand#1_'",
    "functions_like_underscore": "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_' AND p_name LIKE '_e%'",
    "functions_dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, extract(month FROM o_orderdate) AS e FROM orders",
    "date_comparison": "SELECT count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-01-01' AND CAST(l_shipdate AS DATE) < CAST('1998-02-01' AS DATE)",
    "arithmetic": "SELECT n_nationkey, -n_nationkey AS m, n_nationkey - 30 AS s, n_nationkey * n_regionkey AS p, (n_nationkey + 2) % 5 AS r FROM nation",
    "decimal_arithmetic": "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(15,2)) * CAST(1.05 AS DECIMAL(5,2)) AS DECIMAL(18,4)) AS m, CAST(CAST(p_retailprice AS DECIMAL(15,2)) + CAST(0.01 AS DECIMAL(5,2)) AS DECIMAL(18,2)) AS a FROM part",
    "quoted_names": 'SELECT "n_name" AS "Nation Name", n_regionkey AS "select" FROM "nation"',
    "string_literals": "SELECT 'it''s' AS a, 'a\\b' AS b, '-- no comment' AS c /* 'comment' */ FROM region -- 'end",
    "values_inline": "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL)) AS v(a, b)",
    **TPCH,
}


def _engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    engine = Engine(spark)
    for t in TABLES:
        if t in text:
            engine.register(t, f"{sf_dir}/{t}.parquet")
    return engine


def _run(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, text).sql(text)


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _kind(kind: str, tables: tuple[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir, "".join(tables))
    a, b = engine.sql(f"WITH {tables[0]} SELECT * FROM ord"), engine.sql(f"WITH {tables[1]} SELECT * FROM cus")
    residual = (a["amount"] > 20) if kind in ("inner", "left", "semi", "anti") else None
    return O.join(a, b, [("cust", "c_id")], kind, residual)


_ON = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}


def _kind_sql(kind: str, tables: tuple[str, str]) -> str:
    cte = f"WITH {tables[0]}, {tables[1]} "
    if kind in _ON:
        return f"{cte}SELECT * FROM ord {_ON[kind]} cus ON cust = c_id" + (" AND amount > 20" if kind in ("inner", "left") else "")
    return cte + {
        "semi": "SELECT * FROM ord WHERE EXISTS (SELECT 1 FROM cus WHERE cust = c_id AND amount > 20)",
        "anti": "SELECT * FROM ord WHERE NOT EXISTS (SELECT 1 FROM cus WHERE cust = c_id AND amount > 20)",
        "right_semi": "SELECT * FROM cus WHERE c_id IN (SELECT cust FROM ord)",
        "right_anti": "SELECT * FROM cus WHERE NOT EXISTS (SELECT 1 FROM ord WHERE cust = c_id)",
        "single": "SELECT ord.*, cus.* FROM ord LEFT JOIN cus ON cust = c_id",
        "mark": "SELECT *, cust IN (SELECT c_id FROM cus) AS mark FROM ord",
    }[kind]


def _mark_large(spark, d):
    orders, customer = _read(spark, d, "orders", "customer")
    return O.mark_join(orders.select("o_orderkey", "o_custkey"), customer.filter("c_acctbal > 5000"), "o_custkey", "c_custkey", "rich")


def _aggregate_api(spark, d):
    (li,) = _read(spark, d, "lineitem")
    A = O.Aggregate
    out = O.aggregate(li, ["l_returnflag", F.year("l_shipdate").cast("bigint").alias("y")], [A("count_star", name="n"), A("sum", "l_linenumber", name="s"), A("avg", "l_quantity", name="a"), A("count", "l_suppkey", distinct=True, name="d"), A("max", "l_shipdate", name="hi")], having="n > 10")
    return out.withColumn("a", F.round("a", 6))


def _top_api(spark, d):
    (orders,) = _read(spark, d, "orders")
    return O.project(O.top_n(orders, [("o_totalprice", "desc"), "o_orderkey"], 12, 3), "o_orderkey", "o_orderdate")


def _scalars_api(spark, d):
    (part,) = _read(spark, d, "part")
    x = F.col("p_retailprice")
    return part.select("p_partkey", S.divide(x, F.col("p_size")).alias("q"), S.floor(x).alias("f"), S.trunc(x).alias("t"), S.sign(x - 1000).alias("s"), F.round(S.log(x), 6).alias("l"), S.substring(F.col("p_name"), 0, 3).alias("z"), S.resolve("prefix")(F.col("p_name"), F.lit("red")).alias("p"))


def _transfer(spark, d, kind="inner"):
    li, part = _read(spark, d, "lineitem", "part")
    small = part.filter("p_size = 7").select("p_partkey", "p_brand")
    out = O.filtered_join(li.select("l_orderkey", "l_linenumber", "l_partkey"), small, ("l_partkey", "p_partkey"), kind)
    return out.select("l_orderkey", "l_linenumber", *([] if kind == "semi" else ["p_brand"]))


def _transfer_bounds(spark, d):
    li, orders = _read(spark, d, "lineitem", "orders")
    build = orders.filter("o_totalprice > 300000").select("o_orderkey")
    return O.filtered_join(li.select("l_orderkey", "l_linenumber"), build, ("l_orderkey", "o_orderkey"), max_values=256).select("l_orderkey", "l_linenumber")


def _transfer_chain(spark, d):
    region, nation, customer = _read(spark, d, "region", "nation", "customer")
    r, n, c = O.chain([(region.filter("r_name = 'ASIA'"), None, "r_regionkey"), (nation, "n_regionkey", "n_nationkey"), (customer, "c_nationkey", None)])
    return O.join(O.join(r, n, [("r_regionkey", "n_regionkey")]), c, [("n_nationkey", "c_nationkey")]).select("c_custkey", "n_name")


def _transfer_empty(spark, d):
    li, part = _read(spark, d, "lineitem", "part")
    return O.filtered_join(li.select("l_orderkey", "l_partkey"), part.filter("p_size < 0").select("p_partkey"), ("l_partkey", "p_partkey")).select("l_orderkey")


def _file_in_from(spark, d):
    return Engine(spark).sql(f"SELECT n_name, r_name FROM '{d}/nation.parquet' AS n JOIN '{d}/region.parquet' r ON n_regionkey = r_regionkey" if "://" not in d else f"SELECT n_name, r_name FROM {d}/nation.parquet AS n JOIN {d}/region.parquet r ON n_regionkey = r_regionkey")


def _file_list(spark, d):
    return Engine(spark).sql(f"SELECT n_nationkey, count(*) AS n FROM ['{d}/nation.parquet', '{d}/nation.parquet'] AS twice GROUP BY n_nationkey")


def _file_remote(spark, d):
    return Engine(spark).sql(f"SELECT r_name FROM remote('{d}/region.parquet') WHERE r_regionkey > 1")


def _file_stems(spark, d):
    return Engine(spark).sql(f"SELECT count(*) AS n FROM remote(['{d}/nation.parquet']), '{d}/region.parquet' WHERE n_regionkey = r_regionkey")


def _through(format, spark, d):
    """A result that is written and then read as a file named in the query."""
    path = f"{scratch(spark, 'out')}.{format}"
    engine = _engine(spark, d, "nation customer")
    engine.write("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS seg, c_acctbal > 0 AS ok FROM customer, nation WHERE c_nationkey = n_nationkey", path, format)
    return Engine(spark).sql(f"SELECT seg, ok, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS k, round(sum(c_acctbal), 2) AS b, max(c_name) AS last FROM '{path}' AS f GROUP BY seg, ok")


_THROUGH_SQL = "SELECT CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS seg, c_acctbal > 0 AS ok, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS k, round(sum(c_acctbal), 2) AS b, max(c_name) AS last FROM customer GROUP BY ALL"


def _split(spark, d):
    (orders,) = _read(spark, d, "orders")
    split = O.hash_split(orders, 8, "o_custkey")
    return O.aggregate(split, ["o_custkey"], [O.Aggregate("count_star", name="n")])


def _gather(spark, d):
    (nation,) = _read(spark, d, "nation")
    return O.gather(O.aggregate(nation, ["n_regionkey"], [O.Aggregate("count_star", name="n")]))


def _sum_no_overflow(spark, d):
    (li,) = _read(spark, d, "lineitem")
    return O.aggregate(li, ["l_returnflag"], [O.Aggregate("sum_no_overflow", "l_linenumber", name="s")])


def _text(spark, d):
    """A result rendered as text, a row for each line."""
    text = _engine(spark, d, "nation").run("SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 3 THEN n_regionkey END AS region FROM nation")
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


def _constants(spark, d):
    t = O.constants(spark, [(1, "a"), (2, None)], "k int, v string")
    return O.cross(t, O.constants(spark, [(True,)], "b boolean"))


API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    **{f"api_join_{k}": (partial(_kind, k, (_ORD, _CUS)), _kind_sql(k, (_ORD, _CUS))) for k in O.KINDS},
    **{f"api_join_{k}_whole": (partial(_kind, k, (_ORDERS, _CUSTOMERS)), _kind_sql(k, (_ORDERS, _CUSTOMERS))) for k in O.KINDS},
    "api_gather": (_gather, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "api_sum_no_overflow": (_sum_no_overflow, "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "sink_text": (_text, "SELECT 'n_nationkey' || chr(9) || 'n_name' || chr(9) || 'region' AS line UNION ALL SELECT CAST(n_nationkey AS VARCHAR) || chr(9) || n_name || chr(9) || CASE WHEN n_regionkey > 3 THEN CAST(n_regionkey AS VARCHAR) ELSE 'NULL' END FROM nation"),
    "api_mark_join_large": (_mark_large, "SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS rich FROM orders"),
    "api_aggregate": (_aggregate_api, "SELECT l_returnflag, year(l_shipdate) AS y, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, count(DISTINCT l_suppkey) AS d, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, year(l_shipdate) HAVING count(*) > 10"),
    "api_top_n": (_top_api, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 3"),
    "api_scalars": (_scalars_api, "SELECT p_partkey, p_retailprice / p_size AS q, floor(p_retailprice) AS f, trunc(p_retailprice) AS t, sign(p_retailprice - 1000) AS s, round(log(p_retailprice), 6) AS l, substring(p_name, 0, 3) AS z, prefix(p_name, 'red') AS p FROM part"),
    "api_hash_split": (_split, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "api_constants": (_constants, "SELECT k, v, TRUE AS b FROM (VALUES (1, 'a'), (2, NULL)) AS t(k, v)"),
    "transfer_inner": (_transfer, "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7"),
    "transfer_semi": (partial(_transfer, kind="semi"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)"),
    "transfer_left": (partial(_transfer, kind="left"), "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size = 7"),
    "transfer_bounds": (_transfer_bounds, "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000"),
    "transfer_chain": (_transfer_chain, "SELECT c_custkey, n_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'"),
    "transfer_empty": (_transfer_empty, "SELECT l_orderkey FROM lineitem WHERE 1 = 0"),
    "source_file_in_from": (_file_in_from, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "source_file_list": (_file_list, "SELECT n_nationkey, CAST(2 AS BIGINT) AS n FROM nation"),
    "source_remote": (_file_remote, "SELECT r_name FROM region WHERE r_regionkey > 1"),
    "sink_csv": (partial(_through, "csv"), _THROUGH_SQL),
    "sink_parquet": (partial(_through, "parquet"), _THROUGH_SQL),
    "source_comma_list": (_file_stems, "SELECT count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: partial(_run, text) for name, text in SQL.items()}, **{name: f for name, (f, _) in API.items()}}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **{name: text for name, (_, text) in API.items()}}
