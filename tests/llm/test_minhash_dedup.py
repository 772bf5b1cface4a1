import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkweft.llm import minhash_dedup as m
from sparkweft.llm.components import connected_components
from sparkweft.llm.shared import WordHash, id_filter, join_counted, shingle_sequence
from tests.llm.conftest import frame, odd_texts, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                where[x].append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for j, n in Counter(j for x in s for j in where[x] if j != k).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=str)


def got(df, **more):
    return sorted((tuple(r) for r in m.near_duplicates(df, **more).collect()), key=str)


def test_odd_texts(spark, odd):
    assert got(odd) == brute(odd_texts(), 85)


def test_empty(spark, none):
    assert got(none) == []


def test_chunked_parts_lose_no_link(spark):
    """Near copies of one text whose links go through it, a chain of neighbours and strangers with a common half, compared chunk by chunk."""
    base = words(5, 200).split()
    rows = [(1000, " ".join(base))]
    for k in range(40):
        t = base.copy()
        for j in range(4):
            t[(k * 5 + j * 47) % 200] = f"x{k}y{j}"
        rows.append((k, " ".join(t)))
    half, text = words(6, 120), words(9, 150).split()
    rows += [(2000 + k, f"{half} {words(100 + k, 70 + k)}") for k in range(9)]
    for k in range(12):
        rows.append((3000 - k, " ".join(text)))
        text = text[8:] + words(200 + k, 8).split()
    df = frame(spark, rows, "doc_id long, text string")
    want = brute(rows, 80)
    assert got(df, percent=80) == want
    assert got(df, percent=80, group_rows=3) == want
    assert len({r[2] for r in want}) < 41 + 21


def test_signature_estimates_similarity():
    cache = WordHash()
    a, b = words(7, 400).split(), words(8, 400).split()
    x, y = np.unique(shingle_sequence(" ".join(a), cache)), np.unique(shingle_sequence(" ".join(a[:300] + b[:100]), cache))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((m.signature(x) == m.signature(y)).mean() - true) < 0.16
    for n in (1, 2, 7, 30):
        assert (m.signature(x[:n]) != m.EMPTY).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14), st.integers(60, 95))
def test_link_forest_joins_what_links(pairs, percent):
    sets = [np.arange(i * 40, i * 40 + 60 + a + b, dtype=np.uint64) if i % 3 else np.arange(a, a + 70 + b, dtype=np.uint64) for i, (a, b) in enumerate(pairs)]
    if len(sets) < 2:
        return

    def parts(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if x in (ra, rb) else x for x in root]
        return root

    every = [(i, j) for i in range(len(sets)) for j in range(i) if m.linked(sets[i], sets[j], percent)]
    assert parts(m.link_forest(np.arange(len(sets)), sets, percent)) == parts(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50 + i, 50) for i in range(1, 20)] + [(7, 7), (None, 3)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(31)} | {50 + i: 50 for i in range(20)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_duplicates(spark, odd):
    out = m.without_duplicates(odd, 85)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 11, 12, 13, 14, 15, 3, 4, 5, 6, 8, None]


def test_rows_of_one_id_are_judged_by_their_text(spark):
    a, b = words(1, 90), words(2, 90)
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, a.upper(), 4), (4, b + " tail", 5), (5, b, 7), (5, b, 6), (1, a, 0), (6, "", 8), (6, None, 9), (6, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int").withColumns({"_id": F.lit(7), "_key": F.lit("k")})
    out = m.without_duplicates(docs, 80)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"] or "", r["x"]) for r in out.collect())
    assert got == [(1, a, 0), (2, b, 3), (6, "", 9), (6, "", 10)] or got == [(1, a, 0), (2, b, 3), (6, "", 8), (6, "", 9)]
    assert {r["_id"] for r in out.collect()} == {7}
    assert got == sorted((r["doc_id"], r["text"] or "", r["x"]) for r in m.without_duplicates(docs.repartition(5), 80).collect())


def test_joins_split_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("y"))
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table.drop("n"), "k", how).select("k", "x", "y").collect()))
        assert sorted(map(str, join_counted(rows, table, "k", 3000, how).select("k", "x", "y").collect())) == want


def test_id_filter_passes_all_its_ids(spark):
    passes = id_filter(spark.range(500).selectExpr("id * 7 as doc_id"))
    hit = {r["id"] for r in spark.range(5000).where(passes(F.col("id"))).collect()}
    assert {7 * i for i in range(500)} <= hit and len(hit) < 1500


def test_id_filter_stays_out_of_plan_texts(spark):
    passes = id_filter(spark.range(0, 100_000, 3).withColumnRenamed("id", "doc_id"))
    rows = spark.range(100_000).where(passes(F.col("id")))
    assert len(rows._jdf.queryExecution().toString()) < 50_000
    assert 33_334 <= rows.count() < 40_000
