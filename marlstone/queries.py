"""Queries that show each operator on the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.aggregates import MaxFn
from marlstone.functions.equality import typed_eq
from marlstone.operators import relational as R
from marlstone.plans import explain
from marlstone.scratch import scratch_root
from marlstone.session import Connection, Engine
from marlstone.sql.ast import Const, Field, Predicate, Term
from marlstone.types import Schema

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return R.table_scan(spark, f"{sf_dir}/{name}.parquet")


def database(spark: SparkSession, sf_dir: str, *tables: str, planner: str = "heuristic") -> Connection:
    """A new database with these tables registered."""
    connection = Engine(spark).connect(f"{scratch_root(spark)}/db-{uuid.uuid4().hex}", planner)
    for name in tables:
        connection.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return connection


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if oracle:
            _oracles[key] = oracle
        return f

    return add


def equal(left: str, right: str | int | bool) -> Predicate:
    return Predicate((Term(Field(left), Const(right)),))


# Operators


@query("SELECT * FROM nation")
def table_scan(spark, d):
    return table(spark, d, "nation")


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def select_const_str(spark, d):
    return R.select(table(spark, d, "orders"), equal("o_orderstatus", "F"))


@query("SELECT * FROM part WHERE p_size = 10")
def select_const_int(spark, d):
    return R.select(table(spark, d, "part"), equal("p_size", 10))


@query("SELECT * FROM lineitem WHERE l_linenumber = l_suppkey")
def select_field_eq_field(spark, d):
    return R.select(table(spark, d, "lineitem"), Predicate((Term(Field("l_linenumber"), Field("l_suppkey")),)))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def select_conjunction(spark, d):
    both = Predicate(equal("l_returnflag", "R").terms + equal("l_linestatus", "F").terms)
    return R.project(R.select(table(spark, d, "lineitem"), both), ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders WHERE o_orderdate::DATE = DATE '1995-01-01'")
def select_date_string(spark, d):
    dated = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return R.select(dated, equal("o_orderdate", "1995-01-01"))


@query("SELECT p_partkey, p_size FROM part WHERE FALSE")
def select_type_mismatch(spark, d):
    return R.project(R.select(table(spark, d, "part"), equal("p_size", "x")), ["p_partkey", "p_size"])


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') = substr(o_orderpriority, 1, 10)")
def select_date_eq_string_column(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.substring("o_orderpriority", 1, 10).alias("text"))
    return rows.filter(typed_eq(Field("day"), Field("text"), Schema.of(rows.schema))).select("o_orderkey")


@query("SELECT c_name, c_mktsegment FROM customer")
def project(spark, d):
    return R.project(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query("SELECT c_mktsegment FROM customer")
def project_keeps_repeats(spark, d):
    return R.project(table(spark, d, "customer"), ["c_mktsegment"])


@query("SELECT * FROM nation CROSS JOIN region")
def product(spark, d):
    return R.product(table(spark, d, "nation"), table(spark, d, "region"))


@query("SELECT s_suppkey, n_name FROM supplier CROSS JOIN nation")
def multibuffer_product(spark, d):
    return R.block_product(R.project(table(spark, d, "supplier"), ["s_suppkey"]), R.project(table(spark, d, "nation"), ["n_name"]))


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_select_product(spark, d):
    both = R.product(table(spark, d, "nation"), table(spark, d, "region"))
    return R.project(R.select(both, Predicate((Term(Field("n_regionkey"), Field("r_regionkey")),))), ["n_name", "r_name"])


@query("SELECT * FROM orders WHERE o_custkey = 7")
def index_select(spark, d):
    return R.index_select(table(spark, d, "orders"), "o_custkey", 7)


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def index_join(spark, d):
    return R.project(R.index_join(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey"), ["c_custkey", "c_name", "n_name"])


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def merge_join(spark, d):
    joined = R.merge_join(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    return R.project(joined, ["o_orderkey", "o_custkey", "l_linenumber", "l_quantity"])


@query("SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_suppkey")
def merge_join_widened_keys(spark, d):
    return R.project(R.merge_join(table(spark, d, "nation"), table(spark, d, "supplier"), "n_nationkey", "s_suppkey"), ["n_name", "s_suppkey"])


@query("SELECT n_name, r_name FROM nation, region WHERE FALSE")
def merge_join_mismatch(spark, d):
    """A number and a string are unequal, whatever they are."""
    return R.project(R.merge_join(table(spark, d, "nation"), table(spark, d, "region"), "n_nationkey", "r_name"), ["n_name", "r_name"])


@query("SELECT n_name, r_name FROM nation, region WHERE FALSE")
def index_join_mismatch(spark, d):
    return R.project(R.index_join(table(spark, d, "nation"), table(spark, d, "region"), "n_name", "r_regionkey"), ["n_name", "r_name"])


_DAYS = "SELECT o_orderkey, n_name FROM orders, (SELECT n_name, strftime(DATE '1995-01-01' + n_nationkey::INTEGER, '%Y-%m-%d') AS day FROM nation) WHERE strftime(o_orderdate, '%Y-%m-%d') = day"


def _days(spark, d):
    dated = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return dated, table(spark, d, "nation").select("n_name", F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyyy-MM-dd").alias("day"))


@query(_DAYS)
def merge_join_date_string(spark, d):
    return R.project(R.merge_join(*_days(spark, d), "date", "day"), ["o_orderkey", "n_name"])


@query(_DAYS)
def index_join_date_string(spark, d):
    return R.project(R.index_join(*_days(spark, d), "date", "day"), ["o_orderkey", "n_name"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def materialize(spark, d):
    kept = R.materialize(R.select(table(spark, d, "orders"), equal("o_orderstatus", "F")))
    return R.project(kept, ["o_orderkey", "o_totalprice"])


@query("SELECT c_nationkey, c_name FROM customer ORDER BY c_nationkey, c_name")
def sort_multi(spark, d):
    return R.sort(R.project(table(spark, d, "customer"), ["c_nationkey", "c_name"]), ["c_nationkey", "c_name"])


@query("SELECT o_custkey, max(o_totalprice) AS maxofo_totalprice FROM orders GROUP BY o_custkey")
def groupby_max(spark, d):
    return R.group_by(table(spark, d, "orders"), ["o_custkey"], [MaxFn("o_totalprice")])


@query("SELECT l_returnflag, l_linestatus, max(l_quantity) AS maxofl_quantity, max(l_discount) AS maxofl_discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
def groupby_max_multi(spark, d):
    return R.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [MaxFn("l_quantity"), MaxFn("l_discount")])


@query("SELECT c_nationkey, max(c_name) AS maxofc_name FROM customer GROUP BY c_nationkey")
def groupby_max_string(spark, d):
    return R.group_by(table(spark, d, "customer"), ["c_nationkey"], [MaxFn("c_name")])


@query("SELECT o_orderstatus, max(o_orderdate::DATE) AS maxofday FROM orders GROUP BY o_orderstatus")
def groupby_max_date(spark, d):
    return R.group_by(table(spark, d, "orders").select("o_orderstatus", F.col("o_orderdate").cast("date").alias("day")), ["o_orderstatus"], [MaxFn("day")])


@query("SELECT max(o_totalprice) AS maxofo_totalprice FROM orders")
def global_max(spark, d):
    return R.group_by(table(spark, d, "orders"), [], [MaxFn("o_totalprice")])


@query("SELECT DISTINCT o_custkey FROM orders")
def groupby_without_functions(spark, d):
    return R.group_by(table(spark, d, "orders"), ["o_custkey"], [])


# The SQL front end, with either planner

_STATEMENTS = {
    "select": (["part"], "SELECT p_name, p_size FROM part WHERE p_size = 10;"),
    "join2": (["nation", "region"], "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey;"),
    "join3": (["customer", "orders", "lineitem"], "SELECT c_name, o_orderkey, l_linenumber FROM customer, lineitem, orders WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING';"),
    "join4": (["customer", "orders", "lineitem", "nation"], "SELECT n_name, c_custkey, o_orderkey, l_quantity FROM customer, lineitem, nation, orders WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND o_orderstatus = 'F';"),
    "product": (["nation", "region"], "SELECT n_name, r_name FROM nation, region;"),
    "constant_false": (["nation"], "SELECT n_name FROM nation WHERE 1 = 2;"),
    "mismatch": (["nation"], "SELECT n_name FROM nation WHERE n_nationkey = '1';"),
}


def _through_sql(tables: list[str], text: str, planner: str) -> Query:
    return lambda spark, d: database(spark, d, *tables, planner=planner).query(text)


for _name, (_tables, _text) in _STATEMENTS.items():
    _oracle = "SELECT n_name FROM nation WHERE FALSE" if _name == "mismatch" else _text.rstrip(";")
    for _planner in ("basic", "heuristic"):
        query(_oracle, f"sql_{_name}_{_planner}")(_through_sql(_tables, _text, _planner))


@query("SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND o_custkey = 7 AND c_custkey = 7")
def sql_indexed(spark, d):
    c = database(spark, d, "customer", "orders")
    c.update("CREATE INDEX by_customer ON orders (o_custkey);")
    c.update("CREATE INDEX by_key ON customer (c_custkey);")
    return c.query("SELECT c_name, o_orderkey FROM orders, customer WHERE c_custkey = o_custkey AND o_custkey = 7 AND c_custkey = 7;")


@query("WITH v AS (SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1) SELECT n_name FROM v")
def view_select(spark, d):
    c = database(spark, d, "nation")
    c.update("CREATE VIEW v AS SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1;")
    return c.query("SELECT n_name FROM v;")


@query("WITH v AS (SELECT n_name, n_regionkey, r_name FROM nation, region WHERE n_regionkey = r_regionkey) SELECT n_name, r_name FROM v WHERE n_regionkey = 2")
def view_filtered(spark, d):
    c = database(spark, d, "nation", "region")
    c.update("CREATE VIEW v AS SELECT n_name, n_regionkey, r_name FROM nation, region WHERE n_regionkey = r_regionkey;")
    return c.query("SELECT n_name, r_name FROM v WHERE n_regionkey = 2;")


@query("WITH v AS (SELECT n_nationkey, n_name FROM nation) SELECT c_name, n_name FROM customer, v WHERE c_nationkey = n_nationkey")
def view_join_table(spark, d):
    c = database(spark, d, "nation", "customer")
    c.update("CREATE VIEW v AS SELECT n_nationkey, n_name FROM nation;")
    return c.query("SELECT c_name, n_name FROM customer, v WHERE c_nationkey = n_nationkey;")


@query("WITH v AS (SELECT n_name, n_regionkey FROM nation), w AS (SELECT n_name, r_name FROM v, region WHERE n_regionkey = r_regionkey) SELECT n_name FROM w WHERE r_name = 'ASIA'")
def view_nested(spark, d):
    c = database(spark, d, "nation", "region")
    c.update("CREATE VIEW v AS SELECT n_name, n_regionkey FROM nation;")
    c.update("CREATE VIEW w AS SELECT n_name, r_name FROM v, region WHERE n_regionkey = r_regionkey;")
    return c.query("SELECT n_name FROM w WHERE r_name = 'ASIA';")


# Changes, on registered tables, whose files stay as they are

_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"
_READ = "SELECT s_suppkey, s_name, s_nationkey FROM supplier;"


@query("SELECT 1::INTEGER AS id, 'joe'::VARCHAR AS name, DATE '2002-06-22' AS birth, true AS sex UNION ALL SELECT 2, 'o''hara', DATE '1999-01-02', false UNION ALL SELECT 0, 'max', DATE '2000-02-29', false")
def dml_insert(spark, d):
    c = database(spark, d)
    c.update("CREATE TABLE people (id INTEGER, name VARCHAR(10), birth DATE, sex BOOL);")
    c.update("INSERT INTO people (id, name, birth, sex) VALUES (1, 'joe', '2002-06-22', true);")
    c.update("INSERT INTO people (name, id, birth) VALUES ('o''hara', 2, '1999-01-02');")
    c.update("INSERT INTO people (name, birth) VALUES ('max', '2000-02-29');")
    return c.query("SELECT id, name, birth, sex FROM people;")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def dml_update_const(spark, d):
    c = database(spark, d, "orders")
    c.update("UPDATE orders SET o_orderpriority = 'done' WHERE o_orderstatus = 'F';")
    return c.query("SELECT o_orderkey, o_orderpriority FROM orders;")


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN p_brand ELSE p_type END AS p_type FROM part")
def dml_update_field(spark, d):
    c = database(spark, d, "part")
    c.update("UPDATE part SET p_type = p_brand WHERE p_size = 10;")
    return c.query("SELECT p_partkey, p_type FROM part;")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_orderstatus = 'F'")
def dml_delete(spark, d):
    c = database(spark, d, "orders")
    c.update("DELETE FROM orders WHERE o_orderstatus = 'F';")
    return c.query("SELECT o_orderkey, o_orderstatus FROM orders;")


@query(f"{_SUPPLIER} WHERE FALSE")
def dml_delete_all(spark, d):
    c = database(spark, d, "supplier")
    c.update("DELETE FROM supplier;")
    return c.query(_READ)


@query(f"SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name, s_nationkey FROM supplier WHERE s_nationkey <> 5 UNION ALL SELECT 0, 'new', 5")
def dml_sequence(spark, d):
    c = database(spark, d, "supplier")
    c.update("CREATE INDEX by_nation ON supplier (s_nationkey);")
    c.update("UPDATE supplier SET s_name = 'moved' WHERE s_nationkey = 3;")
    c.update("DELETE FROM supplier WHERE s_nationkey = 5;")
    c.update("INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (0, 'new', 5, 1);")
    return c.query(_READ)


# A table in a folder for each value of a column


def partitioned(spark: SparkSession, sf_dir: str) -> Connection:
    """Orders by status, each status in a folder of its own, registered as they lie."""
    path = f"{scratch_root(spark)}/orders-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    c = database(spark, sf_dir)
    c.register_parquet("orders", path)
    return c


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_scan(spark, d):
    return partitioned(spark, d).query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F';")


@query("SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND o_custkey <> 8")
def partitioned_changes(spark, d):
    c = partitioned(spark, d)
    c.update("DELETE FROM orders WHERE o_orderstatus = 'P';")
    c.update("UPDATE orders SET o_orderstatus = 'X' WHERE o_custkey = 7;")
    c.update("DELETE FROM orders WHERE o_custkey = 8;")
    return c.query("SELECT o_orderkey, o_orderstatus FROM orders;")


# The catalog and plans


def _cataloged(spark, d):
    c = database(spark, d)
    c.update("CREATE TABLE student (sid INTEGER, sname VARCHAR(10), grad_year SMALLINT, major_id INTEGER, birth DATE, sex BOOL);")
    c.update("CREATE TABLE dept (did INTEGER, dname VARCHAR(10));")
    c.update("CREATE INDEX student_major ON student (major_id);")
    c.update("CREATE VIEW major AS SELECT sname, dname FROM student, dept WHERE major_id = did AND dname = 'o''dd';")
    return c


@query("SELECT * FROM (VALUES ('tblcat', 28), ('fldcat', 56), ('viewcat', 128), ('idxcat', 64), ('student', 33), ('dept', 22)) AS t(tblname, slotsize)")
def catalog_tblcat(spark, d):
    return _cataloged(spark, d).query("SELECT tblname, slotsize FROM tblcat;")


@query(
    "SELECT * FROM (VALUES ('student', 'sid', 2, 0, 4), ('student', 'sname', 3, 10, 8), ('student', 'grad_year', 1, 0, 22), ('student', 'major_id', 2, 0, 24), "
    "('student', 'birth', 5, 0, 28), ('student', 'sex', 4, 0, 32)) AS t(tblname, fldname, type, length, offset_)".replace("offset_", '"offset"')
)
def catalog_fldcat(spark, d):
    return _cataloged(spark, d).query("SELECT tblname, fldname, type, length, offset FROM fldcat WHERE tblname = 'student';")


@query("SELECT 'major' AS viewname, 'SELECT sname, dname FROM student, dept WHERE major_id = did AND dname = ''o''''dd'';' AS viewdef")
def catalog_viewcat(spark, d):
    return _cataloged(spark, d).query("SELECT viewname, viewdef FROM viewcat;")


@query("SELECT 'student_major' AS indexname, 'student' AS tablename, 'major_id' AS fieldname")
def catalog_idxcat(spark, d):
    return _cataloged(spark, d).query("SELECT indexname, tablename, fieldname FROM idxcat;")


_EXPLAINED = "number::INTEGER AS number, depth::INTEGER AS depth, operation, name, reads::BIGINT AS reads, writes::BIGINT AS writes"


@query(
    f"SELECT {_EXPLAINED} FROM (VALUES (1, 0, 'PROJECT SCAN', '', 1, 5), (2, 1, 'SELECT SCAN', '', 1, 5), (3, 2, 'MULTIBUFFER PRODUCT SCAN', '', 1, 50), (4, 3, 'MATERIALIZE', '', 1, 2), "
    "(5, 4, 'SELECT SCAN', '', 1, 2), (6, 5, 'TABLE SCAN', 'region', 1, 5), (7, 3, 'TABLE SCAN', 'nation', 1, 25)) AS t(number, depth, operation, name, reads, writes)"
)
def explain_plan(spark, d):
    c = database(spark, d, "nation", "region")
    plan = c.create_statement("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA';").explain_plan()
    return spark.createDataFrame(explain.rows(plan), "number int, depth int, operation string, name string, reads long, writes long")


def _plan(connection: Connection, sql: str) -> DataFrame:
    rows = explain.rows(connection.create_statement(sql).explain_plan())
    return connection.store.spark.createDataFrame(rows, "number int, depth int, operation string, name string, reads long, writes long")


# The estimates as they are defined: V = 1 + R / 3 values of a column, R / V rows of an index, and its search cost.
_ESTIMATES = """
WITH o AS (SELECT count(*) AS r, 1 + count(*) // 3 AS v FROM orders), c AS (SELECT count(*) AS r, 1 + count(*) // 3 AS v FROM customer),
t AS (SELECT o.r AS r, o.v AS v, o.r // o.v AS hits, 1 + trunc(ln(greatest(1, o.r // 20)) / ln(20))::BIGINT AS search, c.r AS cr, c.v AS cv FROM o, c),
"""


@query(
    _ESTIMATES + f"""
p AS (SELECT 1 AS number, 0 AS depth, 'PROJECT SCAN' AS operation, '' AS name, search + hits AS reads, hits // greatest(1, v) AS writes FROM t
  UNION ALL SELECT 2, 1, 'SELECT SCAN', '', search + hits, hits FROM t
  UNION ALL SELECT 3, 2, 'INDEX SELECT SCAN BY o_custkey = 7', 'by_customer', search + hits, hits FROM t
  UNION ALL SELECT 4, 3, 'TABLE SCAN', 'orders', NULL, r FROM t)
SELECT {_EXPLAINED.replace("reads::BIGINT AS reads", "CASE WHEN number < 4 THEN reads END::BIGINT AS reads").replace("writes::BIGINT", "CASE WHEN number > 2 THEN writes END::BIGINT")} FROM p"""
)
def explain_index_select(spark, d):
    """Cost of an index and the rows it leaves. What the selection above it leaves isn't shown."""
    c = database(spark, d, "orders", "customer")
    c.update("CREATE INDEX by_customer ON orders (o_custkey);")
    shown = _plan(c, "SELECT o_orderkey FROM orders WHERE o_custkey = 7;")
    return shown.withColumn("reads", F.when(F.col("number") < 4, F.col("reads"))).withColumn("writes", F.when(F.col("number") > 2, F.col("writes")))


@query(
    "SELECT 1::BIGINT AS conditions, (SELECT count(*) FROM orders)::BIGINT // (1 + (SELECT count(*) FROM orders) // 3) AS records UNION ALL "
    "SELECT 2, (SELECT count(*) FROM orders)::BIGINT // ((1 + (SELECT count(*) FROM orders) // 3) ** 2)::BIGINT"
)
def explain_selectivity(spark, d):
    """How many rows one and two conditions are estimated to leave."""
    c = database(spark, d, "orders")
    left = [c.create_statement(f"SELECT o_orderkey FROM orders WHERE {where};").explain_plan().records for where in ("o_custkey = 7", "o_custkey = 7 AND o_orderstatus = 'F'")]
    return spark.createDataFrame(list(enumerate(left, 1)), "conditions long, records long")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
