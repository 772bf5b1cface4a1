"""Columns found in SQL by scope."""

import pytest

from sparkweft.sources.columns import column_mentions, sql_columns


@pytest.mark.parametrize(
    "sql,want",
    [
        ('CREATE TABLE "S"."T" (a int, `b` decimal(1, 2) DEFAULT f(1, 2), [c] text, constraint x check (z > 0), PRIMARY KEY (a))', {("creates", "t.a"), ("creates", "t.b"), ("creates", "t.c")}),
        ("-- CREATE TABLE g (a int);\n/* ALTER TABLE g ADD b int; */ ALTER TABLE ONLY t ADD COLUMN IF NOT EXISTS a int, ADD b text, ADD CONSTRAINT c UNIQUE (d), DROP COLUMN e", {("defines", "t.a"), ("defines", "t.b")}),
        ("UPDATE t SET a = 1, x.b = (SELECT c FROM u WHERE d = 'e, f = 1'), g = h WHERE i = 1", {("uses", "t.a"), ("uses", "t.b"), ("uses", "t.g"), ("uses", "u.c")}),
        ("SELECT a, count(b), *, c + 1, d AS e, f g, 'h', null FROM t", {("uses", "t.a"), ("uses", "t.d"), ("uses", "t.f")}),
        ("SELECT x.a, t.b, u.c, y.d, e FROM s.t LEFT JOIN u AS x ON x.i = t.i, v y WHERE q = 1", {("uses", "u.a"), ("uses", "t.b"), ("uses", "v.d"), ("uses", "t.e"), ("uses", "u.e"), ("uses", "v.e")}),
        ("SELECT z.a, x.b FROM (SELECT c FROM t) z JOIN u x USING (k) WHERE EXISTS (SELECT x.d FROM w WHERE 1 = 1)", {("uses", "u.b"), ("uses", "t.c"), ("uses", "u.d")}),
        ("SELECT DISTINCT a FROM t UNION ALL SELECT b FROM u; SELECT 1", {("uses", "t.a"), ("uses", "u.b")}),
        ("", set()), (")))(((", set()), ("SELECT FROM", set()), ("CREATE TABLE", set()), ("UPDATE SET", set()), ("ALTER TABLE t ADD", set()), ("select a from t where 'open", {("uses", "t.a")}),
    ],
)
def test_sql(sql, want):
    assert set(sql_columns(sql)) == want


def test_long_and_deep():
    assert len(sql_columns("CREATE TABLE t (" + ", ".join(f"c{i} int" for i in range(20000)) + ")")) == 20000
    assert sql_columns("SELECT a FROM t WHERE " + "(" * 20000 + "SELECT b FROM u") == [("uses", "t.a"), ("uses", "u.b")]


def test_files(spark):
    rows = [("a.py", "x = 'SELECT a FROM t'\ny = \"\"\"UPDATE u SET b = 1\"\"\"\nselect = a", "python", 1), ("b.sql", "CREATE TABLE t (a int)", "sql", 1), ("c.sql", None, "sql", 1), ("d.py", "", None, 1), ("b.sql", "CREATE TABLE t (a int)", "sql", 1)]
    found = column_mentions(spark.createDataFrame(rows, "path string, text string, language string, role int"))
    assert sorted(tuple(r) for r in found.collect()) == sorted([("a.py", "column", "uses", "t.a"), ("a.py", "column", "uses", "u.b"), ("b.sql", "column", "creates", "t.a"), ("b.sql", "column", "creates", "t.a")])
