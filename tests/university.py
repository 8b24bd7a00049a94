"""The textbook's example database as statements. Its tables, rows, indexes and views, for the results that
are known for it."""

TABLES = [
    "CREATE TABLE student (sid INTEGER, sname VARCHAR(10), grad_year SMALLINT, major_id INTEGER, birth DATE, sex BOOL);",
    "CREATE TABLE dept (did INTEGER, dname VARCHAR(10));",
    "CREATE TABLE course (cid INTEGER, title VARCHAR(16), dept_id INTEGER);",
    "CREATE TABLE section (sect_id INTEGER, course_id INTEGER, prof VARCHAR(10), year_offered INTEGER);",
    "CREATE TABLE enroll (eid INTEGER, student_id INTEGER, section_id INTEGER, grade VARCHAR(2));",
    "CREATE TABLE sex (sex_name VARCHAR(10), value BOOL);",
]
ROWS = {
    "student": [
        (1, "joe", 2021, 10, "2002-06-22", True), (2, "amy", 2020, 20, "2001-09-13", False), (3, "max", 2022, 10, "2000-11-09", True), (4, "sue", 2022, 20, "2000-03-01", False), (5, "bob", 2020, 30, "2001-04-19", True),
        (6, "kim", 2020, 20, "2001-08-31", False), (7, "art", 2021, 30, "2002-10-10", True), (8, "pat", 2019, 20, "2000-07-23", False), (9, "lee", 2021, 10, "2002-12-29", True),
    ],
    "dept": [(10, "compsci"), (20, "math"), (30, "drama")],
    "course": [(12, "db systems", 10), (22, "compilers", 10), (32, "calculus", 20), (42, "algebra", 20), (52, "acting", 30), (62, "elocution", 30)],
    "section": [(13, 12, "turing", 2018), (23, 12, "turing", 2016), (33, 32, "newton", 2017), (43, 32, "einstein", 2018), (53, 62, "brando", 2017)],
    "enroll": [(14, 1, 13, "A"), (24, 1, 43, "C"), (34, 2, 43, "B+"), (44, 4, 33, "B"), (54, 4, 53, "A"), (64, 6, 53, "A")],
    "sex": [("male", True), ("female", False)],
}
INDEXES = ["CREATE INDEX idx_grad_year ON student (grad_year);", "CREATE INDEX idx_major_id ON student (major_id);", "CREATE INDEX idx_sex ON student (sex);"]
VIEWS = ["CREATE VIEW einstein AS SELECT sect_id FROM section WHERE prof = 'einstein';", "CREATE VIEW name_dep AS SELECT sname, dname, grad_year, major_id FROM student, dept WHERE major_id = did;"]


def literal(value):
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def insert(table, columns, row):
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join(map(literal, row))});"


def build(connection, tables=tuple(ROWS)):
    for statement in TABLES:
        if statement.split()[2] in tables:
            connection.update(statement)
    for table in tables:
        columns = connection.table_schema(table).names
        for row in ROWS[table]:
            assert connection.update(insert(table, columns, row)) == 1
    for statement in INDEXES + VIEWS:
        if len(tables) == len(ROWS):
            assert connection.update(statement) == 0
    return connection
