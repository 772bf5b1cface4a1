import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import cochange
from sparkweft.sources import history, tree
from sparkweft.streaming import claims


def test_tree_guards(spark, tmp_path):
    for name, raw in {"a.py": b"x = 1\n", "b.bin.py": b"p\0q", "c.ts": b"y" * 250_001, "node_modules/d.js": b"z", "e/f.go": b"package e\n" * 3, "g.sql": b"s"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    rows = {r.path: r for r in tree.guarded(tree.scan(spark, str(tmp_path))).collect()}
    assert {p: (r.language, r.guard) for p, r in rows.items()} == {"a.py": ("python", None), "b.bin.py": ("python", "binary"), "c.ts": ("typescript", "long_line"), "e/f.go": ("go", None), "g.sql": ("sql", None)}
    assert rows["a.py"].blob == hashlib.sha1(b"blob 6\0x = 1\n").hexdigest()


def test_generated(spark):
    rules = tree.generated_rules("# c\ngen/** linguist-generated\n*.snap linguist-generated=true\ngen/keep.py -linguist-generated\nx text\n")
    want = {"gen/a/b.py": True, "gen/keep.py": False, "a/b.snap": True, "src/a.py": False, "vendor/x.go": True, "a.min.js": True}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", tree.is_generated(F.col("p"), rules).alias("g")).collect()
    assert {r.p: r.g for r in rows} == want


def test_log_and_renames(spark):
    lines = ["commit aa", "M\tx.py", "R100\told.py\tnew.py", "commit bb", "M\told.py", "R90\tfirst.py\told.py", "commit cc", "A\tfirst.py"]
    log = history.parse_log(spark.createDataFrame(list(enumerate(lines)), "position long, value string"))
    touch = log.select("commit_id", "path")
    got = {(r.commit_id, r.path) for r in history.fold_renames(touch, log).collect()}
    assert got == {("aa", "x.py"), ("aa", "new.py"), ("bb", "new.py"), ("cc", "new.py")}
    assert history.parse_log(spark.createDataFrame(list(enumerate(lines)), "position long, value string"), 2).select("commit_id").distinct().count() == 2


@pytest.mark.parametrize(
    ("renames", "want"),
    [
        ([("a", "b"), ("b", "a")], {"a": "b", "b": "a"}), ([("a", "c"), ("a", "b")], {"a": "b"}), ([("a", "b"), ("b", "c"), ("c", "a")], {"a": "c", "b": "a", "c": "b"}),
        ([(f"n{i}", f"n{i + 1}") for i in range(9)], {f"n{i}": "n9" for i in range(9)}), ([], {}),
    ],
)
def test_latest_names(spark, renames, want):
    rows = [(i, old, new) for i, (old, new) in enumerate(renames)]
    got = history.latest_names(spark.createDataFrame(rows, "nth long, old_path string, path string")).collect()
    assert {r.path: r.latest for r in got} == want


def test_several_logs(spark):
    rows = [(r, i, v) for r in ("x", "y") for i, v in enumerate([f"commit {r.encode().hex()}1", "M\ta", f"commit {r.encode().hex()}2", f"M\t{r}"])]
    log = history.parse_log(spark.createDataFrame(rows, "repo string, position long, value string"))
    assert {(r.repo, r.commit_id, r.nth, r.path) for r in log.collect()} == {("x", "781", 1, "a"), ("x", "782", 2, "x"), ("y", "791", 1, "a"), ("y", "792", 2, "y")}


def test_push_payload(spark):
    body = {"repository": {"full_name": "o/r"}, "ref": "refs/heads/main", "commits": [{"id": "c1", "added": ["a"], "modified": ["b"], "removed": None}, {"id": "", "added": [], "modified": ["b"], "removed": ["z"]}]}
    rows = history.push_touches(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()
    assert {(r.repo, r.branch, r.path) for r in rows} == {("o/r", "main", p) for p in "abz"}
    assert {r.commit_id for r in rows if r.path == "z"} == {hashlib.sha1(b"1\nb\nz").hexdigest()}


T0 = dt.datetime(2024, 1, 1)
EVENTS = [
    (1, "p", "A", "declare", 0), (2, "p", "B", "declare", 1), (3, "p", "C", "declare", 2), (4, "p", "A", "declare", 3), (5, "p", "A", "land", 5), (6, "p", "B", "declare", 40), (7, "p", "C", "release", 41), (8, "q", "A", "declare", 0),
]


def events(spark):
    return spark.createDataFrame([(i, p, c, k, T0 + dt.timedelta(minutes=m)) for i, p, c, k, m in EVENTS], "event_id long, path string, change_id string, kind string, at timestamp")


def test_claim_replay(spark):
    out = [(r.path, r.change_id, r.action) for r in claims.claim_replay(events(spark)).orderBy("path", "at").collect()]
    said = [x[1:] for x in out if x[0] == "p"]
    assert said[:5] == [("A", "active"), ("B", "waiting"), ("C", "waiting"), ("A", "heartbeat"), ("A", "landed")]
    assert sorted(said[5:]) == sorted([("B", "promoted"), ("B", "expired"), ("B", "waiting"), ("C", "promoted"), ("C", "released"), ("B", "promoted")])


def test_claim_stream_equals_replay(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).write.parquet(src)
    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    q = claims.claim_stream(stream).writeStream.format("memory").queryName("claims_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = {(r.path, r.change_id, r.action, r.at) for r in claims.claim_replay(events(spark)).collect()}
    assert want <= {(r.path, r.change_id, r.action, r.at) for r in spark.table("claims_out").collect()}


@pytest.mark.parametrize("runs", [1, 2])
def test_cochange_sink_equals_batch(spark, tmp_path, runs):
    rows = [(f"{c:02}f", f"p{(c * k) % 5}") for c in range(30) for k in (1, 2, 3)]
    touch = spark.createDataFrame(rows, "commit_id string, path string")
    fold = claims.cochange_sink(str(tmp_path / "state"))
    for batch, part in enumerate((touch.where("commit_id < '15'"), touch.where("commit_id >= '10'"))):
        for _ in range(runs):
            fold(part, batch)
    got = spark.read.parquet(str(tmp_path / "state/pairs")).groupBy("path_a", "path_b").agg(F.sum("co").alias("co"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cochange.pair_counts(cochange.baskets(touch)).collect()))


def test_coalesced_pushes_batch(spark):
    rows = [("r", "b", "s1", T0), ("r", "b", "s2", T0 + dt.timedelta(seconds=20)), ("r", "b", "s3", T0 + dt.timedelta(minutes=3))]
    out = claims.coalesced_pushes(spark.createDataFrame(rows, "repo string, branch string, commit_sha string, at timestamp")).orderBy("start").collect()
    assert [(r.commit_sha, r.full) for r in out] == [("s2", True), ("s3", False)]
