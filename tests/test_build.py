"""The graph of a small tree in one call."""

import random

from pyspark.sql import functions as F

from sparkweft.sources import build

FILES = {
    "pkg/__init__.py": "", "pkg/a.py": "from pkg import b\nimport requests\nprint(b.run())\nq = 'SELECT x FROM users JOIN orders ON 1'\n", "pkg/b.py": "def run(x, *, y):\n    return x\n", "bad.py": "def (",
    "db/1.sql": "CREATE TABLE users (id int);\nALTER TABLE orders ADD c int;", "db/2.sql": "ALTER TABLE users ADD c int; CREATE TABLE orders (id int)", "db/3.sql": "CREATE TABLE orders (id int)",
    "go/internal/auth/a.go": "package auth\nfunc Login() {}\n", "go/internal/auth/b.go": "package auth\nfunc Logout() {}\n", "go/main.go": "package main\nimport \"example.org/x/go/internal/auth\"\n",
    "packages/ui/package.json": '{"name": "@o/ui"}', "packages/ui/src/index.ts": "export class Button {}\n", "web/app.ts": "import { Button } from '@o/ui'\nimport x from '@o/other'\nfetch(`/api/users/${id}`)\n", "srv/u.py": "@app.get('/api/users/{id}')\ndef user(id):\n    return 1\n",
    "crates/m/Cargo.toml": '[package]\nname = "grep-matcher"\n', "crates/m/src/lib.rs": "pub struct Matcher {}\n", "crates/n/src/main.rs": "use grep_matcher::Matcher;\n", "conf/x.json": "{broken",
    "App/Core/S.cs": "public class S { }\n", "App/Main.cs": "using App.Core;\n",
}


def tree(spark, files):
    rows = [(p, t.encode(), len(t.encode())) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, content binary, length long")


def test_graph_of_a_tree(spark):
    g = build.build_graph(tree(spark, FILES))
    edges = {(e.src, e.kind, e.dst): e.reference_status for e in g.edges.collect()}
    for known in [
        ("pkg/a.py", "imports", "pkg/b.py"), ("pkg/a.py", "imports", "requests"), ("pkg/a.py", "queries", "table::users"), ("go/main.go", "imports", "go/internal/auth/a.go"), ("go/main.go", "imports", "go/internal/auth/b.go"),
        ("web/app.ts", "imports", "packages/ui/src/index.ts"), ("web/app.ts", "imports", "@o/other"), ("web/app.ts", "imports", "srv/u.py"), ("crates/n/src/main.rs", "imports", "crates/m/src/lib.rs"), ("db/2.sql", "alters", "table::users"),
        ("App/Main.cs", "imports", "App/Core/S.cs"), ("pkg/b.py", "contains", "pkg/b.py::run"), ("pkg/a.py", "calls", "run"),
    ]:
        assert edges[known] is None, known
    for doubted in [("pkg/a.py", "queries", "table::orders"), ("db/1.sql", "alters", "table::orders"), ("db/3.sql", "alters", "table::orders")]:
        assert edges[doubted] == "ambiguous"
    status = {n.path: n.analysis_status for n in g.nodes.where("kind = 'file'").collect()}
    assert len(status) == len(FILES) and status["bad.py"] == status["conf/x.json"] == "failed"
    assert status["web/app.ts"] == "incomplete"  # bad.py may have defined its route
    assert status["pkg/a.py"] == "ambiguous" and status["pkg/b.py"] is None
    assert {(n.kind, n.id) for n in g.nodes.collect()} >= {("class", "packages/ui/src/index.ts::Button"), ("table", "table::users")}
    # the same graph from other partitions and another order
    again = list(FILES.items())
    random.Random(3).shuffle(again)
    other = build.build_graph(tree(spark, dict(again)).repartition(7))
    assert other.hash.first().hash == g.hash.first().hash


def test_losses(spark):
    files = spark.createDataFrame([("sql", True), ("rust", False), ("env", True), ("markdown", True)], "language string, lost boolean")
    assert {r.substrate for r in build.lost_substrates(files).collect()} == {"table", "config"}


def test_empty_tree(spark):
    g = build.build_graph(tree(spark, FILES).where(F.lit(False)))
    assert g.nodes.count() == g.edges.count() == g.metrics.count() == 0
