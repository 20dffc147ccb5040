import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera import operators as O
from tessera.engine import Engine
from tessera.functions import scalars
from tessera.functions.dialect import to_spark
from tessera.sources import scan, sinks
from tessera.sources.catalog import Catalog, stem
from tessera.sources.csv import read_csv, sniff
from tessera.types import describe, spark_type, type_name


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# dialect


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT a FROM t ORDER BY a DESC, b", "SELECT a FROM t ORDER BY a DESC NULLS LAST, b NULLS LAST"),
        ("SELECT a FROM t ORDER BY a NULLS FIRST LIMIT 1", "SELECT a FROM t ORDER BY a NULLS FIRST LIMIT 1"),
        ("SELECT x ** 2 ^ 3 FROM t;", "SELECT pow(pow(x, 2), 3) FROM t"),
        ("SELECT a FROM t, u, WHERE x", "SELECT a FROM t, u WHERE x"),
        ("SELECT '-- x // y' -- c", "SELECT '-- x // y'"),
        ("SELECT log(x), log(2, x)", "SELECT log10(x), log(2, x)"),
        ("SELECT a ~~ 'x', a !~~ 'y'", "SELECT a LIKE 'x', a NOT LIKE 'y'"),
        ('SELECT "a b"."c""d"', 'SELECT `a b`.`c"d`'),
        ("SELECT f(x) // g(y)", "SELECT ((f(x)) div (g(y)))"),
        ("SELECT (SELECT a FROM t ORDER BY a)", "SELECT (SELECT a FROM t ORDER BY a NULLS LAST)"),
    ],
)
def test_rewrites(text, want):
    assert to_spark(text) == want


@pytest.mark.parametrize("text", ["SELECT (1", "SELECT 1)", "SELECT 1 /", "SELECT \x01"])
def test_broken_text(text):
    with pytest.raises(errors.InvalidInput):
        to_spark(text)


def test_values(spark):
    e = Engine(spark)
    r = e.sql("SELECT 1 / 0 AS a, -1 / 0 AS b, 0 / 0 AS c, 7 // 2 AS d, CAST(2.5 AS INTEGER) AS e, CAST(CAST(2.5 AS DOUBLE) AS INTEGER) AS f, substring('hello', 0, 2) AS g, sign(-3) AS h, trunc(-1.7) AS i, 2 * 3 / 4 AS j").first()
    assert r.a == float("inf") and r.b == float("-inf") and r.c != r.c
    assert (r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (3, 3, 2, "h", -1, -1.0, 1.5)


# errors


def test_error_kinds(spark):
    e = Engine(spark)
    for text, kind in (("SELEC 1", errors.InvalidInput), ("SELECT * FROM no_such_table", errors.InvalidInput), ("", errors.InvalidInput), ("SELECT nope(1)", errors.InvalidInput)):
        with pytest.raises(kind):
            e.sql(text)
    with pytest.raises(errors.OutOfRange):
        e.run("SELECT 1 % x AS y FROM (VALUES (0)) AS v(x)")
    with pytest.raises(errors.NotSupported):
        scalars.resolve("soundex")
    assert errors.translate(RuntimeError("x")).code == -5
    with pytest.raises(errors.EngineError):
        e.run("SELECT (SELECT x FROM (VALUES (1), (2)) AS v(x)) AS y")


# types


def test_types():
    for name in ("BOOLEAN", "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "VARCHAR", "DATE", "DECIMAL(15,2)"):
        assert type_name(spark_type(name)) == name
    assert spark_type("hugeint").simpleString() == "decimal(38,0)"
    with pytest.raises(errors.NotSupported):
        spark_type("INTERVAL")


# files


def test_sniff():
    assert sniff(["1", "-2", "", None]) == "bigint"
    assert sniff(["1", "2.5", "1e3"]) == "double"
    assert sniff(["true", "FALSE"]) == "boolean"
    assert sniff(["1", "x"]) == "string"
    assert sniff(["", None]) == "string"
    assert sniff(["99999999999999999999"]) == "double"


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,amount,name,ok\n1,1.5,"x,y",true\n2,,z,\n3,oops\n' + "4,2,w,false\n" * 200)
    df = read_csv(spark, str(p))
    assert describe(df.schema)[0][:2] == ("id", "BIGINT")
    got = df.orderBy("id").limit(3).collect()
    assert tuple(got[0]) == (1, "1.5", "x,y", True)  # "oops" is in the sample: text
    assert tuple(got[1]) == (2, None, "z", None) and got[2]["name"] is None
    t = tmp_path / "b.tsv"
    t.write_text("1\t2\r\n3\t4\r\n")
    bare = read_csv(spark, str(t), header=False)
    assert bare.columns == ["col0", "col1"] and rows(bare) == [(1, 2), (3, 4)]


def test_late_misfit_is_null(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("v\n" + "7\n" * 150 + "x\n")
    assert read_csv(spark, str(p)).filter("v IS NULL").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 100), (2, None, None), (3, 'q"q', 5)], "region int, name string, amount int")
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    (part,) = (tmp_path / "c").glob("part-*.csv")
    assert part.read_text() == 'region,name,amount\n1,"a,b",100\n2,,\n3,"q""q",5\n'
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)
    import duckdb

    assert duckdb.sql(f"SELECT count(*) FROM '{tmp_path}/p/*.parquet'").fetchall() == [(3,)]
    assert sinks.render(df.limit(1)) == "region\tname\tamount\n1\ta,b\t100"
    with pytest.raises(errors.InvalidInput):
        sinks.write_parquet(df, str(tmp_path / "q"), compression="lzma")


def test_scan_rewrite(spark, tmp_path, sf_dir):
    c = Catalog(spark)
    n, r = f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"
    assert scan.rewrite(f"SELECT * FROM '{n}'", c) == "SELECT * FROM nation"
    assert scan.rewrite(f"SELECT * FROM {n} AS x, '{r}' y JOIN '{n}' z ON 1=1", c) == "SELECT * FROM nation AS x, region y JOIN nation z ON 1=1"
    assert scan.rewrite(f"SELECT * FROM (SELECT * FROM remote(['{n}', '{n}'])) d", c) == "SELECT * FROM (SELECT * FROM nation_1) d"
    same = "SELECT 'FROM ''x.parquet''', extract(year FROM d) FROM t -- FROM 'y.parquet'"
    assert scan.rewrite(same, c) == same
    other = tmp_path / "nation.parquet"
    spark.range(3).write.parquet(str(other))
    assert scan.rewrite(f"SELECT count(*) FROM '{other}'", c) == "SELECT count(*) FROM nation_2"
    assert c["nation_2"].rows() == 3 and c["nation"].rows() == 25
    assert c["nation"].stats("n_nationkey").high == 24
    for bad in ("SELECT * FROM remote()", f"SELECT * FROM ['{n}'", "SELECT * FROM 'http://x/y.parquet'"):
        with pytest.raises(errors.InvalidInput):
            scan.rewrite(bad, c)
    assert stem("/a/2024-x.parquet") == "_2024_x"


_NOT_IN = "WITH a AS (SELECT * FROM (VALUES (1, 1), (2, 2), (NULL, 3), (4, NULL)) AS v(x, k)), b AS (SELECT * FROM (VALUES (2, 1), (3, 2)) AS v(y, j)), n AS (SELECT * FROM (VALUES (2, 1), (NULL, 2)) AS v(y, j)), e AS (SELECT * FROM b WHERE y > 9) "


@pytest.mark.parametrize("sub", "bne")
@pytest.mark.parametrize(
    "where",
    [
        "x NOT IN (SELECT y FROM s)",
        "NOT x IN (SELECT y FROM s)",
        "NOT (x IN (SELECT y FROM s))",
        "NOT (x NOT IN (SELECT y FROM s))",
        "k = 1 OR x NOT IN (SELECT y FROM s)",
        "k BETWEEN 1 AND 3 AND (x NOT IN (SELECT y FROM s) AND x NOT IN (SELECT j FROM s))",
        "x + 1 NOT IN (SELECT y FROM s WHERE j = k)",
        "x NOT IN (SELECT y FROM s WHERE j < k)",
        "x NOT IN (SELECT max(y) FROM s WHERE j = k)",
        "x NOT IN (SELECT max(y) FROM s GROUP BY j)",
        "x NOT IN (SELECT y FROM s WHERE y NOT IN (SELECT x FROM a WHERE k = 1))",
        "(x, k) NOT IN (SELECT y, j FROM s)",
    ],
)
def test_not_in(spark, where, sub):
    import duckdb

    text = f"{_NOT_IN}SELECT x, k FROM a WHERE {where}".replace("FROM s", f"FROM {sub}")
    assert rows(Engine(spark).sql(text)) == sorted(duckdb.sql(text).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["join_anti_not_in", "tpch_q16"])
def test_not_in_sends_no_table_to_all(spark, sf_dir, name):
    from tessera.plans import suite

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suite.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "Broadcast" not in plan


def test_engine_files(spark, tmp_path, sf_dir):
    e = Engine(spark)
    e.write(f"SELECT n_regionkey, count(*) AS n FROM '{sf_dir}/nation.parquet' GROUP BY n_regionkey", str(tmp_path / "o.csv"), "csv", header=True)
    assert rows(e.sql(f"SELECT * FROM '{tmp_path}/o.csv'")) == [(i, 5) for i in range(5)]
    plan = e.compile(f"SELECT r_name FROM '{sf_dir}/region.parquet' WHERE r_regionkey > 1")
    assert "PushedFilters" in plan["plan"] and json.dumps(plan["schema"]) and plan["sources"]["region"]


# operators


@pytest.fixture(scope="module")
def pair(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (None, 30), (2, 40), (5, 50)], "k int, v int")
    b = spark.createDataFrame([(2, "x"), (None, "n"), (7, "y")], "j int, w string")
    return a, b


def test_join_kinds(pair):
    a, b = pair
    n = {k: O.join(a, b, [("k", "j")], k).count() for k in O.KINDS}
    assert n == {"inner": 2, "left": 5, "right": 4, "outer": 7, "semi": 2, "anti": 3, "single": 5, "mark": 5, "right_semi": 1, "right_anti": 2}
    assert O.join(a, b, [("k", "j")], "inner", null_safe=True).count() == 3
    mark = {r.v: r.mark for r in O.join(a, b, [("k", "j")], "mark").collect()}
    assert mark == {10: None, 20: True, 30: None, 40: True, 50: None}
    empty = {r.v: r.mark for r in O.join(a, b.filter("j > 99"), [("k", "j")], "mark").collect()}
    assert set(empty.values()) == {False}
    with pytest.raises(errors.InvalidInput):
        O.join(a, b, [("k", "j")], "asof")


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("kinds, block, cell_rows", [(("double", "double"), 1, 5), (("double", "double"), 1024, 50_000), (("int", "double"), 7, 20), (("bigint", "int"), 7, 5)])
def test_theta_join(spark, monkeypatch, op, kinds, block, cell_rows):
    import operator
    import random

    from tessera.operators import joins

    monkeypatch.setattr(joins, "CELL_ROWS", cell_rows)
    rnd = random.Random(repr((op, kinds, block)))

    def value(kind):
        if rnd.random() < 0.1:
            return None
        return rnd.choice([-0.0, 0.0, float("nan"), rnd.randrange(60) / 2]) if kind == "double" else rnd.randrange(30)

    a, b = ([(i, value(kind)) for i in range(n)] for kind, n in zip(kinds, (90, 130)))
    left, right = spark.createDataFrame(a, f"i int, x {kinds[0]}"), spark.createDataFrame(b, f"i int, y {kinds[1]}")
    of = lambda v: (v != v, 0 if v != v else v)  # NaN is above all and equal to itself
    test = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    got = O.theta_join(left, right, left["x"], op, right["y"], block)
    assert got.columns == ["i", "x", "i", "y"]
    assert sorted((r[0], r[2]) for r in got.collect()) == [(p, q) for p, x in a for q, y in b if None not in (x, y) and test(of(x), of(y))]
    assert O.theta_join(left.filter("i < 0"), right, left["x"], op, right["y"]).count() == 0


THETA = [
    "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal > c_acctbal + 3000",
    "SELECT * FROM supplier INNER JOIN customer ON (c_acctbal + 5000 <= s_acctbal) WHERE s_nationkey > 3 AND c_mktsegment <> 'it''s'",
    "SELECT count(*) AS n, max(c_name) AS m FROM supplier JOIN customer ON s_acctbal < c_acctbal AND c_nationkey <> s_nationkey AND c_nationkey BETWEEN 3 AND 15 WHERE s_suppkey > 3 OR c_custkey < 10",
    "SELECT s_nationkey, count(*) AS n FROM supplier JOIN customer ON c_custkey >= s_suppkey * 2 GROUP BY s_nationkey HAVING count(*) > 3 ORDER BY n DESC, s_nationkey LIMIT 3;",
]
NO_THETA = [
    "SELECT s_suppkey FROM supplier JOIN customer ON s_acctbal > c_acctbal + 3000 OR s_suppkey = c_custkey",
    "SELECT s_suppkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal",
    "SELECT s_suppkey FROM supplier LEFT JOIN customer ON s_acctbal > c_acctbal + 3000",
    "SELECT s_suppkey FROM supplier JOIN customer ON s_name > c_name",
    "SELECT s_suppkey FROM supplier JOIN nation ON s_acctbal > n_nationkey JOIN region ON TRUE",
    "WITH customer AS (SELECT 1 AS c_acctbal) SELECT s_suppkey FROM supplier JOIN customer ON s_acctbal > c_acctbal",
]


@pytest.mark.parametrize("text", THETA + NO_THETA)
def test_theta_join_in_sql(spark, sf_dir, text):
    import duckdb

    e, con = Engine(spark), duckdb.connect()
    for t in ("supplier", "customer", "nation", "region"):
        e.register(t, f"{sf_dir}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got, want = e.sql(text), con.sql(text)
    assert rows(got) == sorted(want.fetchall(), key=repr) and got.columns == want.columns and got.count()
    nested = "NestedLoop" in got._jdf.queryExecution().executedPlan().toString()
    assert not nested if text in THETA else True


def test_single_join_refuses_two(spark, pair):
    a, b = pair
    twice = b.union(spark.createDataFrame([(2, "z")], "j int, w string"))
    with pytest.raises(Exception, match="more than one row"):
        O.join(a, twice, [("k", "j")], "single").collect()


def test_sort_and_top(pair):
    a, _ = pair
    assert [r.v for r in O.sort(a, ("k", "desc"), "v").collect()] == [50, 20, 40, 10, 30]
    assert [r.v for r in O.top_n(a, [("k", "asc", "first"), "v"], 2, 1).collect()] == [10, 20]
    assert O.limit(a, 0).count() == 0
    with pytest.raises(errors.InvalidInput):
        O.limit(a, -1)


def test_aggregate(pair):
    a, _ = pair
    A = O.Aggregate
    assert rows(O.aggregate(a, ["k"], [A("sum", "v", name="s")])) == sorted([(1, 10), (2, 60), (None, 30), (5, 50)], key=repr)
    r = O.aggregate(a.filter("v < 0"), [], [A("count_star"), A("sum", "v"), A("avg", "v", distinct=True)]).first()
    assert tuple(r) == (0, None, None)
    assert O.aggregate(a, ["k"]).count() == 4
    with pytest.raises(errors.NotSupported):
        A("median", "v").column()


@pytest.mark.parametrize("kind", ["inner", "semi", "right", "left", "outer", "anti"])
@pytest.mark.parametrize("most", [0, 1, 256])
def test_transfer_changes_nothing(spark, kind, most):
    left = spark.createDataFrame([(i % 50 if i % 9 else None, i) for i in range(400)], "k int, v int")
    right = spark.createDataFrame([(i, str(i)) for i in (3, 7, 7, 60)] + [(None, "n")], "j int, w string")
    want = rows(O.join(left, right, [("k", "j")], kind))
    assert rows(O.filtered_join(left, right, ("k", "j"), kind, max_values=most)) == want


def test_filters_merge(spark):
    a, b = O.build(spark.range(5), "id"), O.build(spark.range(3, 300), "id")
    assert a.values == (0, 1, 2, 3, 4) and b.values is None
    m = a.merge(b)
    assert (m.low, m.high, m.values) == (0, 299, None)
    for union in (m, b.merge(a), b.merge(O.build(spark.range(1000, 1300), "id"))):
        held = {r.id for r in union.apply(spark.range(2000), "id").collect()}
        assert set(range(3, 300)) <= held and len(held) < 700
    assert {0, 1, 2} <= {r.id for r in m.apply(spark.range(2000), "id").collect()}
    none = O.build(spark.range(0), "id")
    assert none.merge(a) == a and none.apply(spark.range(9), "id").count() == 0
    assert O.transfer(spark.range(50), "id", spark.range(100), "id", domain=60).count() == 100  # lets too much pass


def test_useless_filter(spark):
    assert O.transfer(spark.range(960), "id", spark.range(1000), "id").count() == 1000  # 96 % would pass
    assert O.transfer(spark.range(800), "id", spark.range(1000), "id").count() < 850


def test_rendering_is_bounded(spark):
    assert sinks.render(spark.range(5), most=5).count("\n") == 5 and sinks.render(spark.range(9), 2, most=5).count("\n") == 2
    with pytest.raises(errors.InvalidInput):
        sinks.render(spark.range(6), most=5)
    assert len(list(sinks.lines(spark.range(6)))) == 7


def test_bloom(spark):
    keys = spark.createDataFrame([(i * 7,) for i in range(1000)] + [(None,)], "k int")
    wide = spark.range(7000).withColumn("s", F.col("id").cast("string"))
    b = O.BloomFilter.build(keys, "k", 1000)
    passed = {r.id for r in wide.filter(b.might_contain(wide, "id")).collect()}
    assert set(range(0, 7000, 7)) <= passed and len(passed) < 1200
    assert O.BloomFilter.build(keys, "k", 1000, max_bytes=100) is None
    other = O.BloomFilter.build(spark.createDataFrame([(1,), (2,)], "k int"), "k", 1000)
    both = b.merge(spark, other)
    assert {1, 2, 7} <= {r.id for r in wide.filter(both.might_contain(wide, "id")).collect()}
    with pytest.raises(errors.InvalidInput):
        b.might_contain(wide, "s")
    with pytest.raises(errors.InvalidInput):
        b.merge(spark, O.BloomFilter.build(keys, "k", 2000))
    f = O.build(keys, "k")
    assert f.values is None and f.bloom is not None and f.apply(wide, "id").count() < 1200


def test_in_list_reaches_the_scan(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size = 7")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = O.transfer(part, "p_partkey", li, "l_partkey").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(l_partkey" in plan.replace("IsNotNull(l_partkey), ", "")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_command_line(sf_dir):
    out = subprocess.run([sys.executable, "-m", "tessera", f"SELECT r_name FROM '{sf_dir}/region.parquet' ORDER BY r_name LIMIT 1"], capture_output=True, text=True, timeout=120)
    assert out.stdout.splitlines()[-2:] == ["r_name", "AFRICA"]
