import pytest
import university
from pyspark.sql import functions as F

from marlstone.errors import UnknownColumnError
from marlstone.functions.aggregates import MaxFn
from marlstone.operators import relational as R
from marlstone.plans.nodes import Config, GroupByNode, MaterializeNode, MergeJoinNode, SelectNode, SortNode, TableNode
from marlstone.sql.ast import Const, Field, Predicate, Term
from marlstone.types import Schema


@pytest.fixture(scope="module")
def student(spark):
    return spark.createDataFrame([r[:4] for r in university.ROWS["student"]], "sid int, sname string, grad_year smallint, major_id int")


@pytest.fixture(scope="module")
def dept(spark):
    return spark.createDataFrame(university.ROWS["dept"], "did int, dname string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_agree(student, dept):
    want = sorted((s[1], d[1]) for s in university.ROWS["student"] for d in university.ROWS["dept"] if s[3] == d[0])
    on = Predicate((Term(Field("major_id"), Field("did")),))
    for joined in (R.merge_join(student, dept, "major_id", "did"), R.index_join(student, dept, "major_id", "did"), R.select(R.product(student, dept), on)):
        assert sorted(tuple(r) for r in R.project(joined, ["sname", "dname"]).collect()) == want
    assert "SortMergeJoin" in plan_of(R.merge_join(student, dept, "major_id", "did"))
    assert R.block_product(student, dept).count() == 27 and "CartesianProduct" in plan_of(R.block_product(student, dept))


def test_broadcast_needs_a_small_side(student, dept, spark, monkeypatch):
    small = spark.range(3).selectExpr("cast(id * 10 as int) as did")
    assert "BroadcastHashJoin" in plan_of(R.index_join(student, small, "major_id", "did"))
    wide = spark.createDataFrame([("x" * 5000, i) for i in range(100)], "t string, did int")
    monkeypatch.setattr(R, "BROADCAST_BYTES", 100 * 5000)
    assert not R.small(wide) and R.small(wide.limit(90))  # as counted
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1)
    assert not R.small(small) and R.index_join(student, small, "major_id", "did").count() == 7


def test_widened_keys(student, spark):
    wide = spark.createDataFrame([(2020,)], "y long")
    assert R.merge_join(student, wide, "grad_year", "y").count() == 3


def test_types_that_never_equal(student, dept, spark):
    days = spark.createDataFrame([("2002-06-22",), ("x",)], "day string").select(F.expr("cast('2002-06-22' as date)").alias("date"), "day")
    for join in (R.merge_join, R.index_join):
        assert join(student, dept, "sid", "dname").count() == join(student, dept, "sname", "did").count() == 0
        assert join(days.select("date"), days.select("day"), "date", "day").count() == 2
        assert join(student, student.select(F.col("sname").alias("other")), "sname", "other").count() == 9


def test_sort_and_group(student):
    assert [r.sname for r in R.sort(student, ["grad_year", "sname"]).collect()] == ["pat", "amy", "bob", "kim", "art", "joe", "lee", "max", "sue"]
    out = R.group_by(student, ["major_id"], [MaxFn("grad_year")])
    assert out.schema["maxofgrad_year"].dataType == student.schema["grad_year"].dataType
    assert sorted(tuple(r) for r in out.collect()) == [(10, 2022), (20, 2022), (30, 2021)]
    assert R.group_by(student, [], [MaxFn("sname")]).first()[0] == "sue"
    assert sorted(tuple(r) for r in R.group_by(student, ["major_id"], []).collect()) == [(10,), (20,), (30,)]


def test_empty_inputs(student, dept):
    none, no_dept = student.limit(0), dept.limit(0)
    assert R.sort(none, ["sid"]).count() == R.group_by(none, ["sid"], [MaxFn("sid")]).count() == R.group_by(none, [], [MaxFn("sid")]).count() == 0
    for a, b in ((none, dept), (student, no_dept), (none, no_dept)):
        assert R.product(a, b).count() == R.block_product(a, b).count() == R.merge_join(a, b, "major_id", "did").count() == R.index_join(a, b, "major_id", "did").count() == 0


def test_materialize_and_index_select(student):
    twice = student.select("sid", "sname", F.col("sid") + F.lit(1), F.rand().alias("x"), F.col("sid"))
    kept = R.materialize(twice)
    assert kept.columns == twice.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.collect())) and "parquet" in plan_of(kept).lower()
    assert sorted(r.sname for r in R.index_select(student, "grad_year", 2020).collect()) == ["amy", "bob", "kim"]
    table = TableNode("student", student, Schema.of(student.schema), 9, Config())
    below = SelectNode(table, Predicate((Term(Field("grad_year"), Const(2020)),)))
    assert "parquet" in plan_of(MaterializeNode(below).frame()).lower() and MaterializeNode(table).frame() is student


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(R.project(R.index_select(R.table_scan(spark, f"{sf}/orders.parquet"), "o_custkey", 7), ["o_orderkey"]))
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_unknown_columns(student, dept):
    for use in (lambda: R.project(student, ["x"]), lambda: R.sort(student, ["x"]), lambda: R.group_by(student, ["x"], []), lambda: R.merge_join(student, dept, "x", "did"), lambda: R.select(student, Predicate((Term(Field("x"), Const(1)),)))):
        with pytest.raises(UnknownColumnError):
            use()


def test_costs(student, dept):
    s = TableNode("student", student, Schema.of(student.schema), 9, Config())
    d = TableNode("dept", dept, Schema.of(dept.schema), 3, Config())
    join = MergeJoinNode(s, d, "major_id", "did")
    assert (s.records, s.distinct("sid"), join.records) == (9, 4, 9 * 3 // 4)
    assert sorted(r.sname for r in join.frame().collect()) == sorted(r[1] for r in university.ROWS["student"])
    group = GroupByNode(s, ("major_id",), (MaxFn("grad_year"),))
    assert group.records == 4 and group.distinct("maxofgrad_year") == 4 and group.schema.names == ["major_id", "maxofgrad_year"]
    assert SortNode(s, ("sid",)).blocks == MaterializeNode(s).blocks == 1 and SortNode(s, ("sid", "sname")).operation == "SORT SCAN BY (sid,sname)"
