"""Imports that name packages, on small trees worked out by hand."""

from sparkweft.operators import packages as p


def frame(spark, rows, *names):
    return spark.createDataFrame([(r,) if isinstance(r, str) else r for r in rows], ", ".join(f"{n} string" for n in names))


def edges(df):
    return sorted((r.src, r.module, r.dst, r.reference_status) for r in df.collect())


def test_go_directories(spark):
    files = frame(spark, ["internal/auth/a.go", "internal/auth/b.go", "internal/auth/a_test.go", "auth/x.go", "build/main.go", "top.go", "internal/auth/c.py"], "path")
    imports = frame(spark, [("m.go", "github.com/o/r/internal/auth"), ("internal/auth/a.go", "x/internal/auth"), ("m.go", "y/other/auth"), ("m.go", "fmt"), ("m.go", "go.uber.org/zap"), ("build/main.go", "x/build"), ("m.go", None), ("m.go", "y/other/auth")], "src", "module")
    assert edges(p.go_packages(imports, files)) == sorted([
        ("m.go", "github.com/o/r/internal/auth", "internal/auth/a.go", None), ("m.go", "github.com/o/r/internal/auth", "internal/auth/b.go", None), ("internal/auth/a.go", "x/internal/auth", "internal/auth/b.go", None),
        ("m.go", "y/other/auth", "auth/x.go", None), ("m.go", "fmt", "fmt", None), ("m.go", "go.uber.org/zap", "go.uber.org/zap", None),
    ])


def test_csharp_namespaces(spark):
    files = frame(spark, ["A.B/C/x.cs", "A.B/C/y.cs", "src/Old/E/s.cs", "lib/Old/E/s.cs", "Old.E/z.cs", "tests/A/Q/t.cs"] + [f"p{i}/Big/N/f{i}.cs" for i in range(9)], "path")
    imports = frame(spark, [("m.cs", x) for x in ("A.B.C", "B.C", "Old.E", "B.C.y", "B.C.none", "System", "Json.Net", "A.Q", "Big.N")] + [("A.B/C/x.cs", "A.B.C")], "src", "module")
    assert edges(p.csharp_namespaces(imports, files)) == sorted([
        ("m.cs", "A.B.C", "A.B/C/x.cs", None), ("m.cs", "A.B.C", "A.B/C/y.cs", None), ("m.cs", "B.C", "A.B/C/x.cs", None), ("m.cs", "B.C", "A.B/C/y.cs", None), ("m.cs", "Old.E", "Old.E/z.cs", None), ("m.cs", "B.C.y", "A.B/C/y.cs", None),
        ("m.cs", "B.C.none", "B.C.none", None), ("m.cs", "System", "System", None), ("m.cs", "Json.Net", "Json.Net", None), ("m.cs", "A.Q", "A.Q", None), ("m.cs", "Big.N", "Big.N", "ambiguous"), ("A.B/C/x.cs", "A.B.C", "A.B/C/y.cs", None),
    ], key=lambda e: tuple(map(str, e)))
    two = frame(spark, ["src/Old/E/s.cs", "lib/Old/E/s.cs"], "path")
    assert edges(p.csharp_namespaces(frame(spark, [("m.cs", "Old.E"), ("m.cs", "Old.E.s")], "src", "module"), two)) == sorted(("m.cs", m, f"{d}/Old/E/s.cs", "ambiguous") for m in ("Old.E", "Old.E.s") for d in ("src", "lib"))


def test_workspaces_and_crates(spark):
    named = frame(spark, [("@o/a", "packages/a"), ("@o/a/deep", "packages/deep"), ("@o/b", "packages/b")], "name", "root")
    files = frame(spark, ["packages/a/src/index.ts", "packages/a/index.ts", "packages/a/src/u.ts", "packages/a/u.ts", "packages/a/v/index.tsx", "packages/deep/w.ts", "packages/b/x.ts"], "path")
    imports = frame(spark, [("m.ts", x) for x in ("@o/a", "@o/a/u", "@o/a/v", "@o/a/deep/w", "@o/a/deep", "@o/b", "@o/b/x", "@o/ab", "@o/c/x", "rx")] + [("packages/b/x.ts", "@o/b/x")], "src", "module")
    assert edges(p.workspace_imports(imports, named, files)) == sorted([
        ("m.ts", "@o/a", "packages/a/src/index.ts", None), ("m.ts", "@o/a/u", "packages/a/src/u.ts", "ambiguous"), ("m.ts", "@o/a/u", "packages/a/u.ts", "ambiguous"), ("m.ts", "@o/a/v", "packages/a/v/index.tsx", None),
        ("m.ts", "@o/a/deep/w", "packages/deep/w.ts", None), ("m.ts", "@o/a/deep", "@o/a/deep", "unresolved"), ("m.ts", "@o/b", "@o/b", "unresolved"), ("m.ts", "@o/b/x", "packages/b/x.ts", None),
        ("m.ts", "@o/ab", "@o/ab", None), ("m.ts", "@o/c/x", "@o/c/x", None), ("m.ts", "rx", "rx", None),
    ])
    crates = frame(spark, [("grep_matcher", "crates/matcher")], "name", "root")
    rust = frame(spark, ["crates/matcher/src/lib.rs", "crates/matcher/src/a/mod.rs", "crates/matcher/src/b.rs"], "path")
    asked = frame(spark, [("m.rs", x) for x in ("grep_matcher/Matcher", "grep_matcher/a/Type", "grep_matcher/b", "grep_matcher", "serde/Serialize")], "src", "module")
    assert edges(p.workspace_imports(asked, crates, rust, entries=("lib", "main", "mod"), members=True)) == sorted([
        ("m.rs", "grep_matcher/Matcher", "crates/matcher/src/lib.rs", None), ("m.rs", "grep_matcher/a/Type", "crates/matcher/src/a/mod.rs", None), ("m.rs", "grep_matcher/b", "crates/matcher/src/b.rs", None),
        ("m.rs", "grep_matcher", "crates/matcher/src/lib.rs", None), ("m.rs", "serde/Serialize", "serde/Serialize", None),
    ])


def test_empty(spark):
    none, two = frame(spark, [], "path"), frame(spark, [], "src", "module")
    assert p.go_packages(two, none).count() == p.csharp_namespaces(two, none).count() == p.workspace_imports(two, frame(spark, [], "name", "root"), none).count() == 0
