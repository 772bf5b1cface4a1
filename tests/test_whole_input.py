"""Catalogue queries over all their input, against brute force; where the SQL beside a query takes less, this is its check."""

import math
import os
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.operators import components, contention, resolve
from sparkweft.plans import catalogue
from sparkweft.plans.catalogue import QUERIES, Relations

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def clusters(nodes, links):
    """Node to the smallest node it is linked to over any number of steps."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def advisory(change):
    return change.startswith("BR-") and not re.match(v.RELEASE_BRANCH, change[3:].lower())


def all_waits(claims):
    """Waits for holders, and behind a branch that only advises also for the first change."""
    held = [(c.path, c.change_id) for c in claims if c.state == "active"]
    out = {(c.change_id, h) for c in claims if c.state == "waiting" for p, h in held if p == c.path and h != c.change_id}
    first = {}
    for c in sorted(claims, key=lambda c: (c.claimed_at, c.change_id)):
        if c.change_id.startswith("PR-"):
            first.setdefault(c.path, c.change_id)
    lanes = {p for p, h in held if advisory(h)}
    return out | {(c.change_id, first[c.path]) for c in claims if c.state == "waiting" and c.path in lanes and c.change_id.startswith("PR-") and first[c.path] != c.change_id}


def all_links(r):
    claims = r.claim.collect()
    held = {(c.path, c.change_id) for c in claims if c.state == "active"}
    coupled = {(a.change_id, b) for a in catalogue._adjacency(r).collect() for p, b in held if p == a.nbr and b != a.change_id}
    return {c.change_id for c in claims}, all_waits(claims) | coupled


@tables
def test_components_take_all_links(spark):
    want = clusters(*all_links(Relations(spark, DIR)))
    assert {r.node: r.component for r in QUERIES["inflight_components"](spark, DIR).collect()} == want


@tables
def test_order_ranks_within_whole_clusters(spark):
    want = clusters(*all_links(Relations(spark, DIR)))
    rows = QUERIES["suggested_order"](spark, DIR).collect()
    assert {r.change_id: r.component for r in rows} == want
    for c in set(want.values()):
        mine = sorted((r for r in rows if r.component == c), key=lambda r: (-r.depth, -r.impact, r.change_id))
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))


def test_several_clusters(spark):
    claim = "path string, change_id string, state string, is_draft boolean, claim_id long, claimed_at long"
    rows = [("a", "PR-1", "active"), ("a", "PR-2", "waiting"), ("b", "PR-3", "active"), ("c", "PR-4", "active"), ("d", "PR-5", "active"), ("d", "PR-5", "waiting")]
    claims = spark.createDataFrame([(p, c, s, False, i, i) for i, (p, c, s) in enumerate(rows)], claim)
    adjacency = spark.createDataFrame([("c", "b", "PR-4"), ("d", "x", "PR-5")], "f string, nbr string, change_id string")
    links = contention.change_links(contention.waits(claims), adjacency, claims)
    out = components.connected_components(claims.select(F.col("change_id").alias("node")), links)
    assert {r.node: r.component for r in out.collect()} == {"PR-1": "PR-1", "PR-2": "PR-1", "PR-3": "PR-3", "PR-4": "PR-3", "PR-5": "PR-5"}


@tables
def test_rollup_judges_real_changes_over_all_waits(spark):
    r = Relations(spark, DIR)
    claims = r.claim.collect()
    said = {x.change_id: x for x in QUERIES["verdicts"](spark, DIR).collect()}
    assert set(said) == {c.change_id for c in claims}
    assert {c for c, x in said.items() if x.step <= 3} <= {w for w, _ in all_waits(claims)}
    member = clusters(*all_links(r))
    want = {}
    for root in set(member.values()):
        mine = {c for c in member if member[c] == root}
        on = {}
        for c in claims:
            if c.change_id in mine:
                on.setdefault(c.path, set()).add(c.change_id)
        if len(mine) >= 2:
            want[root] = (len(mine), min((said[c].verdict for c in mine), key=v.VERDICTS.index), sum(len(x) >= 2 for x in on.values()))
    assert {x.component: (x.size, x.worst, x.hotspots) for x in QUERIES["cluster_rollup"](spark, DIR).collect()} == want


def test_rollup_of_several_clusters(spark):
    parts = spark.createDataFrame([("A", "A"), ("B", "A"), ("C", "C"), ("D", "C"), ("E", "E")], "node string, component string")
    verdict = spark.createDataFrame([("A", "clear"), ("B", "warn"), ("C", "unknown"), ("D", "clear"), ("E", "serialize")], "change_id string, verdict string")
    claims = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y"), ("C", "z"), ("D", "w"), ("E", "x")], "change_id string, path string")
    out = contention.cluster_rollup(parts, verdict, claims)
    assert sorted((x.component, x.size, x.worst, x.hotspots) for x in out.collect()) == [("A", 2, "warn", 1), ("C", 2, "unknown", 0)]


def parts(spark):
    return [(r.p_partkey, r.p_name.split(" "), r.p_size) for r in Relations(spark, DIR).table("part").collect()]


@tables
def test_bare_imports_of_all_files(spark):
    n = Counter((("python", "typescript", "go")[k % 3], f"p{math.isqrt(k)}") for k, _, _ in parts(spark) if k % 10 != 9)
    fate = lambda x: "raw" if x > v.MAX_BARE_FANOUT else "ambiguous" if x > 1 else "resolved"
    assert {(r.family, r.stem): (r.n, r.fate) for r in QUERIES["bare_fanout_cap"](spark, DIR).collect()} == {g: (x, fate(x)) for g, x in n.items()}


def test_bare_imports_are_resolved_by_the_operator(spark, monkeypatch):
    """At the cap and one over it, as resolve_imports says."""
    rows = [(f"src/m{k}/p{k}.py", "go") for k in [i for s in (2, 3) for i in range(s * s, (s + 1) ** 2)]]
    rows += [(f"src/m{100 + i}/p{100 + i}.py", "go") for i in range(9)]  # 100 to 108: one stem
    files = spark.createDataFrame(rows, "path string, language string")
    monkeypatch.setattr(catalogue, "Relations", lambda *_: SimpleNamespace(file_node=files))
    out = {r.stem: (r.n, r.fate) for r in QUERIES["bare_fanout_cap"](spark, "").collect()}
    assert out == {"p2": (5, "ambiguous"), "p3": (7, "ambiguous"), "p10": (9, "raw")}
    one = resolve.resolve_imports
    monkeypatch.setattr(resolve, "resolve_imports", lambda i, f: one(i, f, 4))
    assert {r.stem: r.fate for r in QUERIES["bare_fanout_cap"](spark, "").collect()} == {"p2": "raw", "p3": "raw", "p10": "raw"}


@tables
def test_siblings_of_all_parts(spark):
    groups = {}
    for k, name, size in parts(spark):
        if k % 4 != 2:  # docs
            ext = (".py", ".go", ".ts")[size % 3]
            path = f"src/{('alpha', 'beta', '', 'gamma')[k % 4]}/x{k}/{name[1]}_{math.isqrt(k)}{'' if k % 5 else '.service'}{ext}"
            groups.setdefault(f"sibling_stem::{({'.py': 'python', '.go': 'go', '.ts': 'web'})[ext]}::src::{name[1]}-{math.isqrt(k)}", []).append(path)
    want = sorted((c, p) for c, g in groups.items() if 2 <= len(g) <= v.MAX_GROUP_FILES for p in g)
    assert want and sorted(map(tuple, QUERIES["sibling_stem_groups"](spark, DIR).collect())) == want


@tables
def test_role_pairs_of_all_parts(spark):
    groups = {}
    for k, name, size in parts(spark):
        if k % 3 < 2:
            path = f"frontend/src/{('pages', 'components')[k % 3]}/x{k}/{name[0]}_{name[1]}s_feat{math.isqrt(k)}{'.vue' if size % 2 else '.tsx'}"
            for t in {name[0], name[1] if len(name[1]) >= 4 else f"{name[1]}s", f"feat{math.isqrt(k)}"}:
                if len(t) >= 4 and t not in v.ROLE_TOKEN_STOP:
                    groups.setdefault(f"role_feature::web_frontend::frontend::src::components__pages::{t}", []).append((k % 3, path))
    want = sorted((c, p) for c, g in groups.items() if len({r for r, _ in g}) == 2 and len(g) <= 30 for _, p in g)
    assert want and sorted(map(tuple, QUERIES["role_feature_pairs"](spark, DIR).collect())) == want
