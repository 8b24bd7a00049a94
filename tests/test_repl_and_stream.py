import university

from marlstone.repl import run
from marlstone.session import Engine
from marlstone.streaming.ingest import append_stream


def test_repl(spark, tmp_path):
    c = university.build(Engine(spark).connect(f"file://{tmp_path}/db"))
    out = []
    say = lambda *lines: [run(c, line, out.append) for line in lines]
    assert all(say(":h", ":t student", ":t", ":v einstein", ":v", ":e SELECT sid FROM student;", ":e", ":e DELETE FROM t;", ":x", "", "SELECT sname, sex, birth FROM student WHERE sid = 1;", "DELETE FROM enroll;", "SELECT x FROM student;"))
    text = "\n".join(out)
    for part in (":e :explain SELECT", "sname                VARCHAR(10)", "idx_major_id", "einstein: SELECT sect_id", "PROJECT SCAN", "which table?", "which view?", "only queries have plans", "no command :x", "joe", "true", "2002-06-22", "Rows 1 (", "Affected 6 (", "UnknownColumnError: x"):
        assert part in text
    assert say(":q") == [False] and out[-1] == "closed"


def test_stream(spark, tmp_path):
    c = Engine(spark).connect(f"file://{tmp_path}/db")
    c.update("CREATE TABLE t (a INTEGER, b VARCHAR(5));")
    spark.range(20).selectExpr("cast(id as int) a", "'x' b").repartition(4).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("a int, b string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    append_stream(c, "t", rows, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    assert sorted(r.a for r in c.query("SELECT a FROM t;").collect()) == list(range(20))
    c.store.append_frame("t", spark.range(1).selectExpr("cast(id as int) a", "'x' b"), stream=f"{tmp_path}/checkpoint", batch=0)
    assert c.query("SELECT a FROM t;").count() == 20
