"""Pairs are counted by numbers, and a query works each relation out once."""

import os
from itertools import combinations

import pytest

from sparkweft.operators import adjacency as adj
from sparkweft.operators import cochange as cc
from sparkweft.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["units_components", "detector_scores", "import_suffix_resolve"])
def test_each_relation_once(spark, monkeypatch, name):
    asked, real = [], catalogue.relation
    monkeypatch.setattr(catalogue, "relation", lambda s, d, n: asked.append(n) or real(s, d, n))
    catalogue.QUERIES[name](spark, DIR).collect()
    assert len(asked) == len(set(asked)) > 1


@pytest.mark.parametrize("below", [50, 1 << 40])
def test_pairs_of_numbers(spark, below):
    base = 0 if below == 50 else (1 << 40) - 50  # numbers that do not fit in pairs of 31 bits
    sets = {c: sorted({base + (c * k + k * k) % 50 for k in range(1, 7)}) for c in range(300)}
    rows = spark.createDataFrame([(c, i) for c, ids in sets.items() for i in ids], "commit_id long, id long")
    want: dict[tuple, int] = {}
    for ids in sets.values():
        for p in combinations(ids, 2):
            want[p] = want.get(p, 0) + 1
    assert {(r.a, r.b): r.co for r in cc.id_pair_counts(rows, below, 3).collect()} == want


def test_pairs_have_their_own_counts(spark):
    """Paths stand in order and keep their counts whatever numbers they have; null commits and paths and giant commits are left out."""
    rows = [(c, p) for c in range(40) for p in {f"p{c % 7}", f"p{c % 5}", f"q{c % 3}", f"p{c % 7}"}]
    touch = spark.createDataFrame([*rows, *rows, (None, "p1"), (None, "p2"), (1, None), *((99, f"x{i}") for i in range(41))], "commit_id long, path string")
    n, co = {}, {}
    for c in range(40):
        paths = sorted({p for k, p in rows if k == c})
        for p in paths:
            n[p] = n.get(p, 0) + 1
        for p in combinations(paths, 2):
            co[p] = co.get(p, 0) + 1
    got = {(r.path_a, r.path_b): (r.co, r.n_a, r.n_b, r.n_total) for r in cc.cochange_pairs(touch, 2, 0, 0).collect()}
    assert got == {(a, b): (k, n[a], n[b], 40) for (a, b), k in co.items() if k >= 2}
    assert cc.cochange_pairs(touch.where("false")).count() == 0


def test_touching_pairs_leave_hot_resources_out(spark):
    rows = [(f"f{i}", f"t{k}") for k in range(2, 12) for i in range(k)] * 2
    got = sorted(map(tuple, adj.touching_pairs(spark.createDataFrame(rows, "src string, dst string"), 8).collect()))
    assert got == sorted((f"f{i}", f"f{j}") for k in range(2, 9) for i, j in combinations(range(k), 2))
