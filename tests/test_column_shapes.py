"""Files that differ in numbers only are parsed once, and give what each gives by itself."""

import random

from sparkweft.sources import columns as c

SQL = [
    "CREATE TABLE a{0}.t{1} (id{2} int, name_{0} varchar({1}), CHECK (id > {3})); ALTER TABLE t{1} ADD COLUMN x{3}y{0} int, DROP COLUMN z;",
    "SELECT a{0}.x{1}, b.y AS p{2}, z{3}, {0} + {1}, count(*) FROM t{0} a{0} JOIN s.t{2} AS b ON a{0}.id = {3} WHERE 'it{1}''s' = b.q{0} -- t{2}\n AND id IN (SELECT k{1} FROM u{3})",
    "UPDATE t{0} SET c{1} = {2}, c{2} = 0{0} WHERE id = {3}",
    "create {0} {1} {2} {3} table t{0} (id int)",
    "SELECT é{0}, t٣{1}.x FROM t٣{1}, [q {2}]; select {{x{3}}}",
]


def test_shapes_give_what_each_file_gives():
    rng = random.Random(5)
    number = lambda: "".join(rng.choice("0123456789") for _ in range(rng.choice((1, 1, 2, 3))))
    for _ in range(400):
        text = rng.choice(SQL).format(*(number() for _ in range(4)))
        for whole, language in ((text, "sql"), (f'q{number()} = "{text}"\nr = \'{text}\'', "python"), (text * 40, "sql")):
            assert c.column_lines(whole, language) == "\n".join(map(" ".join, c.file_columns(whole, language)))


def test_one_parse_for_all_of_a_shape(monkeypatch):
    asked = []
    monkeypatch.setattr(c, "sql_columns", lambda t, real=c.sql_columns: asked.append(t) or real(t))
    c._shape.cache_clear()
    got = {c.column_lines(f'q = "SELECT a.id, b_{k} FROM t{k} a"', "python") for k in range(100, 999)}
    assert len(got) == 899 and "uses t512.b_512" in "\n".join(got) and len(asked) == 1
