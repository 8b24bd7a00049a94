"""A generated university database: seeded, of the sizes that the published timings are for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import Connection


@dataclass(frozen=True)
class Scale:
    students: int
    depts: int
    courses: int
    sections: int
    profs: int
    enrolls: int
    years: int


# The sizes.
SCALES = {
    "tiny": Scale(20, 3, 5, 5, 10, 100, 4),
    "small": Scale(100, 5, 10, 20, 10, 1_000, 4),
    "medium": Scale(600, 5, 20, 50, 20, 10_000, 4),
    "large": Scale(1_200, 10, 80, 600, 50, 100_000, 6),
    "x-large": Scale(10_000, 20, 160, 1_200, 100, 10_000_000, 20),
}

# The schema, its indexes and the view.
SCHEMA = [
    "CREATE TABLE student (sid INTEGER, sname VARCHAR(10), grad_year SMALLINT, major_id INTEGER, birth DATE, sex BOOL);",
    "CREATE TABLE dept (did INTEGER, dname VARCHAR(10));",
    "CREATE TABLE course (cid INTEGER, title VARCHAR(16), dept_id INTEGER);",
    "CREATE TABLE section (sect_id INTEGER, course_id INTEGER, prof VARCHAR(10), year_offered INTEGER);",
    "CREATE TABLE enroll (eid INTEGER, student_id INTEGER, section_id INTEGER, grade VARCHAR(2));",
    "CREATE TABLE sex (sex_name VARCHAR(10), value BOOL);",
    "CREATE INDEX idx_grad_year ON student (grad_year);",
    "CREATE INDEX idx_major_id ON student (major_id);",
    "CREATE INDEX idx_sex ON student (sex);",
    "CREATE INDEX idx_prof ON section (prof);",
    "CREATE INDEX idx_student_id ON enroll (student_id);",
    "CREATE INDEX idx_grade ON enroll (grade);",
    "CREATE VIEW einstein AS SELECT sect_id, prof FROM section WHERE prof = 'einstein';",
]
GRADES = ["A+", "A", "A-", "B+", "B", "B-", "C", "D", "E", "F"]


def draw(seed: int, what: str, n: int) -> Column:
    """A uniform number below n for each id, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{what}"), F.col("id")), F.lit(n)).cast("int")


def build(connection: Connection, scale: Scale, seed: int = 1) -> Connection:
    spark = connection.store.spark
    for statement in SCHEMA:
        connection.update(statement)

    def rows(n: int, *columns: Column) -> DataFrame:
        return spark.range(1, n + 1).select(*columns)

    number = F.col("id").cast("int")
    year = 2020 + draw(seed, "year", scale.years)
    birth = F.make_date(year - 20, number % 12 + 1, number % 28 + 1)
    tables = {
        "student": rows(scale.students, number.alias("sid"), F.concat(F.lit("name-"), number).alias("sname"), year.alias("grad_year"), (10 * (1 + draw(seed, "major", scale.depts))).alias("major_id"), birth.alias("birth"), (draw(seed, "sex", 2) == 1).alias("sex")),
        "dept": rows(scale.depts, (10 * (1 + draw(seed, "dept", scale.depts))).alias("did"), F.concat(F.lit("dept-"), number).alias("dname")),
        "course": rows(scale.courses, number.alias("cid"), F.concat(F.lit("course-"), number).alias("title"), (10 * (number % scale.depts + 1)).alias("dept_id")),
        "section": rows(scale.sections, number.alias("sect_id"), (1 + draw(seed, "course", scale.courses)).alias("course_id"), F.concat(F.lit("prof-"), 1 + draw(seed, "prof", scale.profs)).alias("prof"), year.alias("year_offered")),
        "enroll": rows(scale.enrolls, number.alias("eid"), (1 + draw(seed, "student", scale.students)).alias("student_id"), (1 + draw(seed, "section", scale.sections)).alias("section_id"), F.element_at(F.array(*map(F.lit, GRADES)), draw(seed, "grade", len(GRADES)) + 1).alias("grade")),
        "sex": spark.createDataFrame([("male", True), ("female", False)], "sex_name string, value boolean"),
    }
    for name, df in tables.items():
        connection.load(name, df.coalesce(1) if scale.enrolls < 1_000_000 else df)
    return connection


# The published workload's statements, but for the one that its own grammar rejects.
STATEMENTS = [
    "SELECT sid, sname, dname, grad_year, birth FROM student, dept WHERE did = major_id;",
    "SELECT tblname, fldname, type, length FROM fldcat WHERE tblname = 'student';",
    "SELECT sname, grade, prof FROM student, enroll, section WHERE sid = student_id AND sect_id = section_id;",
    "SELECT sname, grade, prof, grad_year FROM student, enroll, einstein WHERE sid = student_id AND sect_id = section_id AND grad_year = 2022 AND grade = 'A+';",
    "SELECT sid, sname, dname, title, prof FROM student, dept, course, section WHERE did = major_id AND did = dept_id AND cid = course_id AND sname = 'name-2';",
    "SELECT sid, sname, dname, grad_year, birth, sex_name FROM student, dept, sex WHERE did = major_id AND sex = value;",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-5';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-7';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-1';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-3';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-6';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-2';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-9';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-4';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-8';",
    "UPDATE student SET birth = '1999-12-31' WHERE sname = 'name-2';",
    "UPDATE student SET birth = '1999-12-31' WHERE sname = 'name-4';",
    "UPDATE student SET birth = '1999-12-31' WHERE sname = 'name-6';",
    "UPDATE student SET birth = '1999-12-31' WHERE sname = 'name-8';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE birth = '1999-12-31';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-5';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-7';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-1';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-3';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-6';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-2';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-9';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-4';",
    "SELECT sid, sname, grad_year, birth FROM student WHERE sname = 'name-8';",
]


def run(connection: Connection, statement: str) -> int:
    """Executes a statement and fetches its rows. Returns how many there were, or were changed."""
    if statement.startswith("SELECT"):
        return len(connection.query(statement).collect())
    return connection.update(statement)
