from sparkweft.operators.graph import blast_radius
from sparkweft.sources import extract as x
from sparkweft.sources.tree import guarded, scan

FILES = {
    "pkg/a.py": "import os\nfrom . import b\nfrom pkg.c import d as e\n\n@deco\nclass A(Base):\n    def m(self, x, y=1, *, k, **kw):\n        return helper(x)\n\nos.environ.get('DATABASE_URL')\n",
    "bad.py": "def (:\n",
    "web/app.ts": "import { q } from './q'\n// fetch('/no')\nexport const load = async () => { return fetch(`/api/users/${id}`) }\nclass View {}\nnew Queue('mail')\n",
    "web/w.ts": "new Worker('mail', run)\n",
    "srv/main.py": "@app.get('/api/users/{id}')\ndef user(id):\n    cur.execute('SELECT name FROM users WHERE id = 1')\n",
    "db/1.sql": "CREATE TABLE IF NOT EXISTS public.users (id int);\nCREATE INDEX i ON users (id);\n",
    "conf/app.env": "DATABASE_URL=x\nname=y\n",
    "m/main.tf": 'resource "aws_s3_bucket" "logs" {}\nresource "aws_x" "y" { b = aws_s3_bucket.logs.id }\n',
    "s.proto": "message User {}\nservice Mail {}\n",
    "spec.json": '{"openapi": "3.0", "paths": {"/u": {"get": {"operationId": "getU"}, "post": {}}}, "components": {"schemas": {"U": {}}}}',
    "package.json": '{"scripts": {"build": "x"}}',
    "ci/w.yaml": "run: npm run build\n",
}


def test_python_shapes():
    nodes, edges = x.python_file("pkg/a.py", FILES["pkg/a.py"])
    a, m = nodes
    assert (a["name"], a["start_line"], a["end_line"]) == ("A", 5, 8)
    assert (m["param_names"], m["kwonly_names"], m["required_arity"], m["optional_arity"], m["has_varargs"], m["has_kwargs"]) == (["self", "x", "y"], ["k"], 2, 1, False, True)
    assert {("calls", n) for n in ("deco", "Base", "helper", "get")} <= {e[1:3] for e in edges}
    assert {e[2:] for e in edges if e[1] == "imports"} == {("os", None), (".b", "member"), ("pkg.c", None), ("pkg.c.d", "member")}


def test_tree_to_graph(spark, tmp_path):
    for name, text in FILES.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = guarded(scan(spark, str(tmp_path))).cache()
    nodes, edges = x.code_graph(files)
    got = {(r.path, r.kind, r.name, r.analysis_status) for r in nodes.collect()}
    assert ("bad.py", "file", "bad.py", "failed") in got and ("web/app.ts", "def", "load", None) in got and ("web/app.ts", "class", "View", None) in got
    assert sum(k == "file" for _, k, _, _ in got) == len(FILES)
    assert ("web/app.ts", "imports", "./q") in {(r.src, r.kind, r.dst) for r in edges.collect()}
    assert blast_radius(nodes.where("kind <> 'file'").select("path", "name"), edges.where("kind = 'calls'")).count() == 0
    found = x.mentions(files)
    have = {tuple(r) for r in found.collect()}
    assert {
        ("db/1.sql", "table", "defines", "users"), ("srv/main.py", "table", "uses", "users"), ("srv/main.py", "route", "defines", "/api/users/{id}"), ("web/app.ts", "route", "uses", "/api/users/${id}"),
        ("conf/app.env", "config", "defines", "DATABASE_URL"), ("pkg/a.py", "config", "uses", "DATABASE_URL"), ("web/app.ts", "queue", "uses", "mail"), ("web/w.ts", "queue", "defines", "mail"),
        ("m/main.tf", "terraform", "defines", "aws_s3_bucket.logs"), ("m/main.tf", "terraform", "uses", "aws_s3_bucket.logs"), ("s.proto", "proto", "defines", "Mail"), ("spec.json", "openapi", "defines", "getU"),
        ("spec.json", "openapi", "defines", "POST /u"), ("package.json", "script", "defines", "build"), ("ci/w.yaml", "script", "uses", "build"),
    } <= have
    links = {(r.src, r.kind, r.dst): (r.reference_status, r.incomplete) for r in x.link_contracts(found, spark.createDataFrame([("config",)], "substrate string")).collect()}
    assert links["srv/main.py", "queries", "table::users"] == (None, False)
    assert links["pkg/a.py", "reads_config", "config::DATABASE_URL"] == (None, True)


def test_selectors(spark):
    s = spark.createDataFrame([("s1", "d", "n", {"app": "x"}), ("s2", "d", "n", {"app": "x", "t": "1"}), ("s3", "d", "o", {"app": "x"}), ("s4", "d", "n", {})], "selector_id string, dir string, namespace string, selector map<string,string>")
    w = spark.createDataFrame([("w", "d", "n", {"app": "x", "z": "1"})], "workload_id string, dir string, namespace string, labels map<string,string>")
    assert [tuple(r) for r in x.selector_matches(s, w).collect()] == [("s1", "w")]
