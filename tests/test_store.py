"""The graph store: compare-and-set, replays, stale ingests, and two writers of whom one loses."""

import pytest

from sparkweft.operators import cochange
from sparkweft.operators.store import GraphStore, LostRace

VERSION = "coordinate string, commit string, captured_at string, base_commit string, base_revision long"


def rows(spark, schema, *data):
    df = spark.createDataFrame(list(data), schema)
    return df.withColumn("captured_at", df.captured_at.cast("timestamp_ntz")) if "captured_at" in df.columns else df


def nodes(spark, *data):
    return rows(spark, "coordinate string, id string, path string", *data)


def edges(spark, *data):
    return rows(spark, "coordinate string, src string, dst string, kind string, reference_status string", *[(*d, "imports", None) for d in data])


def outcome(df):
    return {r.coordinate: r.outcome for r in df.collect()}


def test_ingest_and_patch(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/g")
    graph = lambda *d: rows(spark, "coordinate string, commit string, captured_at string", *d)
    assert outcome(s.ingest(graph(("r", "c1", "2024-01-02"), ("q", "d1", "2024-01-02")), nodes(spark, ("r", "a", "a"), ("r", "b", "b"), ("r", "c", "c"), ("q", "a", "a")), edges(spark, ("r", "a", "b"), ("r", "c", "b"), ("r", "b", "c"), ("q", "a", "b")))) == {"r": "stored", "q": "stored"}
    assert outcome(s.ingest(graph(("r", "c1", "2024-01-02")), nodes(spark), edges(spark))) == {"r": "unchanged"}
    assert outcome(s.ingest(graph(("r", "c0", "2024-01-01")), nodes(spark), edges(spark))) == {"r": "stale"}
    patch = rows(spark, VERSION, ("r", "c2", "2024-01-03", "c1", 1))
    paths = spark.createDataFrame([("r", "a", False), ("r", "b", True)], "coordinate string, path string, removed boolean")
    fresh = nodes(spark, ("r", "a", "a")), edges(spark, ("r", "a", "c"))
    assert outcome(s.patch(patch, paths, *fresh)) == {"r": "stored"}
    want = {("r", "a", "c"), ("q", "a", "b")}
    assert {(e.coordinate, e.src, e.dst) for e in s.table("edge").collect()} == want
    assert {(n.coordinate, n.path) for n in s.table("node").collect()} == {("r", "a"), ("r", "c"), ("q", "a")}
    assert outcome(s.patch(patch, paths, *fresh)) == {"r": "unchanged"}
    for base in (("c1", 2), ("c2", 1)):
        assert outcome(s.patch(rows(spark, VERSION, ("r", "c3", "2024-01-04", *base)), paths, *fresh)) == {"r": "conflict"}
    assert outcome(s.patch(rows(spark, VERSION, ("new", "c3", "2024-01-04", "c2", 2)), paths, *fresh)) == {"new": "conflict"}
    assert {(e.coordinate, e.src, e.dst) for e in s.table("edge").collect()} == want
    assert {(v.coordinate, v.commit, v.revision) for v in s.table("version").collect()} == {("r", "c2", 2), ("q", "d1", 1)}
    assert s.manifest()[0] == 2


def test_two_writers(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/g")
    number, manifest = s.manifest()
    one = nodes(spark, ("r", "a", "a"))
    bucket = [b for b in range(64)]
    assert s.commit(number, manifest, {"node": one}, bucket) == 1
    with pytest.raises(LostRace):
        s.commit(number, manifest, {"node": nodes(spark, ("r", "z", "z"))}, bucket)
    assert [n.path for n in s.table("node").collect()] == ["a"]


def test_pairs_in_any_order(spark):
    schema = "repo string, path_a string, path_b string, co long, n_a long, n_b long, n_total long"
    data = [("r", "b", "a", 3, 9, 4, 20), ("r", "a", "b", 5, 4, 8, None), ("r", "a", "a", 1, 1, 1, 1), ("r", "c", None, 1, 1, 1, 1), ("r", "d", "e", -2, 0, 0, 0)]
    want = [("a", "b", 5, 5, 9, 20, 1.0, 5 * 20 / 45), ("d", "e", 0, 0, 0, 0, 0.0, 0.0)]
    for some in (data, data[::-1], data + data[:2]):
        got = cochange.canonical_pairs(spark.createDataFrame(some, schema)).orderBy("path_a").collect()
        assert [tuple(r)[1:] for r in got] == want
    assert {(r.path, r.n) for r in cochange.seed_counters(cochange.canonical_pairs(spark.createDataFrame(data[:2], schema))).collect()} == {("a", 5), ("b", 9)}
