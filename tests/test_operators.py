"""Hand-written cases of the operators, one step or boundary each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkweft.functions.paths import is_test_path, normalize_parts
from sparkweft.operators import adjacency, cochange, compat, components, contention, contracts, graph, landing, resolve, routes, surfaces


def test_giant_commits_and_rare_files(spark):
    rows = [(1, f"f{i}") for i in range(41)] + [(2, "a"), (2, "b"), (2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "c")]
    touch = spark.createDataFrame(rows, "commit_id long, path string")
    out = {(r.path_a, r.path_b): r for r in cochange.cochange_pairs(touch, 2, 0, 0).collect()}
    assert list(out) == [("a", "b")]
    r = out["a", "b"]
    assert (r.co, r.n_a, r.n_b, r.n_total) == (2, 3, 2, 3) and r.strength == 1.0 and r.lift == 1.0
    assert cochange.cochange_pairs(touch).count() == 0


def test_increment_is_exact(spark):
    rows = [(c, f"p{(c * k) % 7}") for c in range(60) for k in range(1, 4)]
    touch = spark.createDataFrame(rows, "commit_id long, path string")
    old, new = touch.where("commit_id < 40"), touch.where("commit_id >= 30")
    fresh = cochange.unseen(new, old)
    both = cochange.merge_counts(cochange.pair_counts(cochange.baskets(old)), cochange.pair_counts(cochange.baskets(fresh)))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, cochange.pair_counts(cochange.baskets(touch)).collect()))


def test_hubs_at_eight_and_nine(spark):
    rows = [(f"s{i}", "eight", None) for i in range(8)] + [(f"s{i}", "nine", None) for i in range(9)] + [("x", "eight", "ambiguous")]
    imports = spark.createDataFrame(rows, "src string, dst string, reference_status string")
    assert [r.path for r in graph.hub_files(imports).collect()] == ["nine"]


SYMBOLS = "path string, name string, kind string, start_line long, end_line long, content_hash string"
EDGE = "src string, dst string, reference_status string"


def adjacency_of(spark, symbols, calls=(), imports=(), resources=(), claims=(("a.py", "ag", "PR-1", "active"),)):
    s = spark.createDataFrame([(p, n, "def", 1, 9, "h") for p, n in symbols], SYMBOLS)
    c = spark.createDataFrame([(x, y, None) for x, y in calls], EDGE)
    i = spark.createDataFrame([(x, y, None) for x, y in imports], EDGE)
    r = spark.createDataFrame([(x, y, None) for x, y in resources], EDGE)
    cl = spark.createDataFrame(list(claims), "path string, agent string, change_id string, state string")
    return {(x.f, x.nbr, x.dir) for x in adjacency.claim_adjacency(cl, s, c, i, r).collect()}


def test_call_axis(spark):
    assert adjacency_of(spark, [("b.py", "charge")], [("a.py", "charge")]) == {("a.py", "b.py", "up")}
    assert adjacency_of(spark, [("a.py", "charge")], [("b.py", "charge")]) == {("a.py", "b.py", "down")}
    assert adjacency_of(spark, [("b.py", "map"), ("c.py", "__init__"), ("d.py", "pop"), ("e.py", "ab")], [("a.py", n) for n in ("map", "__init__", "pop", "ab")]) == set()
    two = [("b.py", "make"), ("c.py", "make")]
    assert adjacency_of(spark, two, [("a.py", "make")]) == set()
    assert adjacency_of(spark, two, [("a.py", "make")], [("a.py", "c.py")]) == {("a.py", "c.py", "up")}
    four = [(f"{x}.py", "make") for x in "bcde"]
    assert adjacency_of(spark, four, [("a.py", "make")], [("a.py", "c.py")]) == {("a.py", "c.py", "up")}
    assert adjacency_of(spark, [("tests/t.py", "charge")], [("a.py", "charge")]) == set()
    assert adjacency_of(spark, [("a.py", "charge")], [("tests/t.py", "charge")]) == {("a.py", "tests/t.py", "down")}


def test_shared_resources_and_hubs(spark):
    assert adjacency_of(spark, [], resources=[("a.py", "t"), ("b.py", "t")]) == {("a.py", "b.py", "shared")}
    assert adjacency_of(spark, [], resources=[(f"{x}.py", "t") for x in "abcdefghi"]) == set()
    assert adjacency_of(spark, [], imports=[(f"{x}.py", "h.py") for x in "abcdefgij"]) == set()


CLAIM = "claim_id long, path string, change_id string, agent string, claimed_at timestamp_ntz, state string, lo long, hi long, base_hash string, is_draft boolean"


def claim(i, path, change, state, lo=1, hi=2, base="h", draft=False):
    return (i, path, change, f"ag{change}", dt.datetime(2024, 1, 1, 0, i), state, lo, hi, base, draft)


def ladder(spark, claims, files=(), adj=(), damp=(), pairs=(), edges=()):
    c = spark.createDataFrame(list(claims), CLAIM)
    f = spark.createDataFrame(list(files), "path string, analysis_status string")
    a = spark.createDataFrame(list(adj), "f string, agent string, change_id string, nbr string, dir string")
    d = spark.createDataFrame(list(damp), "f string, change_id string, nbr string, nbr_change string, via string")
    p = spark.createDataFrame(list(pairs), "path_a string, path_b string, co long, lift double")
    e = spark.createDataFrame(list(edges), EDGE)
    facts = contention.change_facts(c, f, contention.waits(c), a, d, p, e)
    promoted = {r.change_id for r in contention.loss_promoted(facts).collect()}
    said = {r.change_id: (r.verdict, r.step) for r in contention.verdicts(facts).collect()}
    assert promoted <= {x for x, (_, step) in said.items() if step == 7}
    return {x: (*said[x], "promoted") if x in promoted else said[x] for x in said}


def test_every_step_of_the_ladder(spark):
    held, mine = claim(1, "a", "H", "active"), lambda **k: claim(2, "a", "W", "waiting", **k)
    files = [("a", None), ("b", None), ("yarn.lock", None)]
    assert ladder(spark, [held, mine()], files)["W"] == ("serialize", 1)
    assert ladder(spark, [claim(1, "yarn.lock", "H", "active"), claim(2, "yarn.lock", "W", "waiting")], files)["W"] == ("serialize_soft", 2)
    assert ladder(spark, [held, mine(draft=True)], files)["W"] == ("warn", 3)
    one, two = claim(1, "a", "X", "active"), claim(2, "b", "Y", "active")
    assert ladder(spark, [one, two], files, adj=[("a", "agX", "X", "b", "up")])["X"] == ("warn", 4)
    assert ladder(spark, [claim(1, "new", "X", "active")], files)["X"] == ("unknown", 5)
    damp = [("a", "X", "b", "Y", "h")]
    assert ladder(spark, [one, two], files, damp=damp, pairs=[("a", "b", 3, 2.0)])["X"] == ("warn", 6)
    assert ladder(spark, [one, two], [("a", None), ("b", "failed")]) == {"X": ("unknown", 7, "promoted"), "Y": ("unknown", 7)}
    assert ladder(spark, [one, two], files, edges=[("a", "z", "unresolved"), ("q", "b", "ambiguous")]) == {"X": ("unknown", 8), "Y": ("unknown", 8)}
    assert ladder(spark, [one], [("a", "ambiguous")])["X"] == ("unknown", 8)
    assert ladder(spark, [one, two], files, damp=damp, pairs=[("a", "b", 2, 9.0)])["X"] == ("unknown", 9)
    assert ladder(spark, [one, two], files)["X"] == ("clear", 10)


def test_ranges_touch_at_the_tolerance(spark):
    for gap, hit in ((2, 1), (3, 0)):
        c = spark.createDataFrame([claim(1, "a", "H", "active", 1, 5), claim(2, "a", "W", "waiting", 5 + gap, 9 + gap)], CLAIM)
        assert contention.conflict_points(c).count() == hit


def test_components_ring_chain_forest(spark):
    ring = [(f"r{i:02}", f"r{(i + 1) % 12:02}") for i in range(12)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    nodes = spark.createDataFrame([(x,) for x in sorted({n for e in ring + chain for n in e} | {"z"})], "node string")
    out = {r.node: r.component for r in components.connected_components(nodes, spark.createDataFrame(ring + chain, "a string, b string")).collect()}
    assert {v for k, v in out.items() if k[0] == "r"} == {"r00"} and {v for k, v in out.items() if k[0] == "c"} == {"c00"} and out["z"] == "z"


def test_depths(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "node string, needs string")
    assert {r.node: r.depth for r in components.depths(nodes, deps).collect()} == {"a": 2, "b": 1, "c": 0, "d": 0}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, needs string")
    assert max(r.depth for r in components.depths(nodes, loop, max_hops=5).collect()) == 5


FINDING = "producer_pr string, consumer_pr string, rule_id string, compat_result string"


def test_landing_plans(spark):
    def plan(*rows):
        out = landing.landing_plan(spark.createDataFrame(list(rows), FINDING)).collect()
        return {r.plan for r in out}, [r.change_id for r in sorted(out, key=lambda r: r.position or 0)]

    hard = lambda a, b: (a, b, "r", "breaking")
    assert plan(hard("PR-10", "PR-9"), hard("PR-2", "PR-10")) == ({"ordered"}, ["PR-2", "PR-10", "PR-9"])
    assert plan(hard("PR-1", "PR-2"), hard("PR-2", "PR-3"), hard("PR-3", "PR-1"))[0] == {"cycle"}
    assert plan(hard("PR-1", "PR-2"), hard("PR-2", "PR-1"))[0] == {"mutual"}
    assert plan(hard("PR-1", "PR-2"), hard("PR-2", "PR-1"), hard("PR-2", "PR-3"))[0] == {"mutual"}
    both = [hard("PR-1", "PR-2"), hard("PR-2", "PR-1"), hard("PR-2", "PR-3"), hard("PR-3", "PR-4"), hard("PR-4", "PR-2")]
    assert plan(*both)[0] == {"mutual"} and plan(*both, ("PR-1", "PR-9", "r", "unknown"))[0] == {"unknown"}
    assert plan(hard("PR-1", "PR-2"), ("PR-2", "PR-3", "consumer_call_mismatch", "breaking"))[0] == {"unknown"}
    assert plan(("PR-1", None, "r", "breaking"), ("PR-1", "PR-1", "r", "breaking"), hard("PR-1", "PR-2")) == ({"ordered"}, ["PR-1", "PR-2"])


def test_typed_landing_plans(spark):
    rows = [
        ("PR-1", "PR-2", "r", "breaking", None, None), ("PR-2", "PR-3", "r", "compatible", "rebase_needed", None),
        ("PR-4", "PR-5", "consumer_call_mismatch", "breaking", None, "arity"), ("PR-5", "PR-6", "r", "risky", None, None), ("PR-8", "PR-8", "r", "risky", None, None),
    ]
    findings = spark.createDataFrame(rows, FINDING + ", evidence_class string, reason_detail string")
    plan = landing.landing_plan(findings)
    assert sorted((r.plan, r.position, r.change_id, r.step) for r in plan.collect() if r.plan != "rebase") == [("ordered_with_revision", 1, "PR-4", "land"), ("ordered_with_revision", 2, "PR-5", "update_after_predecessor"), ("ordered_with_revision", 3, "PR-6", "land")]
    assert {(r.change_id, r.step) for r in plan.collect() if r.plan == "rebase"} == {("PR-1", "land"), ("PR-2", "land"), ("PR-3", "rebase")}
    assert tuple(landing.plan_summary(findings, plan).first()) == (0, "unknown", 2, 1)
    assert tuple(landing.plan_summary(findings.where("producer_pr <> consumer_pr"), plan).first()) == (0, "rebase", 2, 0)


def test_waits_and_their_flags(spark):
    claim = "claim_id long, path string, change_id string, state string, claimed_at long, is_draft boolean"
    rows = [
        (1, "a", "PR-1", "active", 1, False), (2, "a", "PR-2", "waiting", 2, False), (3, "a", "PR-3", "waiting", 3, True), (4, "go.sum", "PR-1", "active", 1, False), (5, "go.sum", "PR-2", "waiting", 2, False),
        (6, "b", "BR-topic", "active", 1, False), (7, "b", "PR-5", "waiting", 2, False), (8, "b", "PR-4", "waiting", 3, False), (9, "c", "BR-release/2", "active", 1, False), (10, "c", "PR-5", "waiting", 2, False),
    ]
    claims = spark.createDataFrame(rows, claim)
    overlap = spark.createDataFrame([("a", "PR-2", "PR-1", "disjoint"), ("go.sum", "PR-2", "PR-1", "same")], "path string, waiter string, holder string, relation string")
    got = {(r.path, r.waiter, r.holder): (r.cross_draft, r.low_value, r.append_soft, r.advisory) for r in contention.waits(claims, overlap).collect()}
    no = (False, False, False, False)
    assert got == {
        ("a", "PR-3", "PR-1"): (True, False, False, False), ("go.sum", "PR-2", "PR-1"): no, ("b", "PR-5", "BR-topic"): (False, False, False, True),
        ("b", "PR-4", "BR-topic"): (False, False, False, True), ("b", "PR-4", "PR-5"): no, ("c", "PR-5", "BR-release/2"): no,
    }
    assert {(r.path, r.waiter): r.low_value for r in contention.waits(claims).collect()}[("go.sum", "PR-2")]


def test_routes_match_as_pairs_do(spark):
    """The join by shapes against match_routes on every pair; a segment that all share is no key."""
    import itertools

    segs = ["api", "users", "{}", "x"]
    routes_ = ["/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(segs, repeat=n)]
    d = spark.createDataFrame([(f"d{i}", r) for i, r in enumerate(routes_)], "path string, route string")
    u = spark.createDataFrame([(f"u{i}", r) for i, r in enumerate(routes_)], "path string, route string")
    got = {(r.route, r.url) for r in routes.match_pairs(d, u).collect()}
    specific = {r.route for r in d.where(routes.is_specific(F.col("route"))).collect()}
    pairs = spark.createDataFrame([(a, b) for a in specific for b in specific], "a string, b string")
    assert got == {(r.a, r.b) for r in pairs.where(routes.match_routes(F.col("a"), F.col("b"))).collect()} and len(got) > 200


def test_steered_and_effect_counters(spark):
    import random

    r = random.Random(2)
    rows = [(i, f"2024-01-{r.randrange(1, 29):02} 00:00:00", f"a{r.randrange(3)}", f"a{r.randrange(3)}", r.choice(["pushed", "landed", "collision_held"]), f"p{r.randrange(3)}", "acct") for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, at string, agent string, counterparty string, kind string, path string, account string").withColumn("occurred_at", F.col("at").cast("timestamp_ntz"))
    got = {x.agent: (x.held, x.steered) for x in surfaces.collision_summary(events, "2024-01-31 00:00:00").collect()}
    held = [e for e in rows if e[4] == "collision_held" and e[2] != e[3]]
    steered = [e for e in held if any(p[4] == "pushed" and p[2] == e[2] and p[5] != e[5] and p[1] >= e[1] for p in rows)]
    assert got == {a: (sum(e[2] == a for e in held), sum(e[2] == a for e in steered)) for a in {e[2] for e in held}}
    landed = [e for e in rows if e[4] == "landed"]
    day = lambda e: int(e[1][8:10])
    hit = sum(any(o[5] == e[5] and o[2] != e[2] and day(e) - 14 <= day(o) < day(e) for o in landed) for e in landed)
    assert surfaces.effect_counters(events, "2024-01-31 00:00:00").first()["occurred"] == hit


def shape(names="", required=0, kw="", varargs=False, mark=None):
    return (list(names), list(kw), required, varargs, mark or f"{names}/{required}/{kw}/{varargs}")


@pytest.mark.parametrize(
    ("before", "after", "result", "rules"),
    [
        (shape("ab", 1), None, "breaking", ["exported_symbol_removed"]), (None, shape(), "unknown", ["unparseable_shape"]), (shape("a", 1), shape("a", 1), "compatible", []),
        (shape("a", 1), shape("ab", 2), "breaking", ["required_arg_added"]), (shape("ab", 1), shape("ab", 2), "breaking", ["required_arg_added", "optional_to_required"]),
        (shape("a", 1), shape("ab", 1), "compatible", []), (shape("ab", 2), shape("a", 1), "risky", ["required_arg_removed"]),
        (shape(kw="x"), shape(kw="y"), "breaking", ["kwonly_renamed"]), (shape(kw="x"), shape(), "compatible", []), (shape(varargs=True), shape(), "risky", ["varargs_removed"]),
    ],
)
def test_shapes(spark, before, after, result, rules):
    t = "struct<param_names:array<string>,kwonly_names:array<string>,required_arity:int,has_varargs:boolean,shape_fingerprint:string>"
    r = compat.compare_shapes(spark.createDataFrame([(before, after)], f"before {t}, after {t}")).first()
    assert (r.compat_result, r.rules) == (result, rules)


def test_routes(spark):
    cases = {"/Users/:id/": "/users/{}", "a//b?x=1#y": "/a/b", "/${x}/<int:k>/[...s]/[id]": "/{}/{}/{}/{}", "": "", "^/x/(.*)$": "/x", "/": "/"}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", routes.normalize_route(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in rows} == cases
    pairs = [("/users/{}", "/users/5", True), ("/things/{}", "/api/things/5", True), ("/plans/{}", "/api/orgs/{}/avatar", False), ("/a/b", "/a/c", False), ("/x", "/api/x", False), ("/{}/{}", "/a/b", False)]
    got = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(routes.match_routes(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in got] == [m for *_, m in pairs]
    keys = spark.createDataFrame([("/api/workspaces/{}/projects/{}",), ("/{}/{}",), ("/x/{}",)], "r string").select(routes.suffix_keys(F.col("r")).alias("k")).collect()
    assert [r.k for r in keys] == [["api/workspaces/{}/projects", "workspaces/{}/projects"], [], []]


def test_paths(spark):
    paths = {"tests/a.py": True, "src/latest.java": False, "src/FooTest.java": True, "a/b_test.go": True, "Testing/x": True, "src/contest.py": False, "": False, None: False}
    rows = spark.createDataFrame([(k,) for k in paths], "p string").select("p", is_test_path(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in rows} == paths
    norm = {"a/./b": "a/b", "a/b/../c": "a/c", "../x": "../x", "a/../../x": "../x"}
    rows = spark.createDataFrame([(k,) for k in norm], "p string").select("p", normalize_parts(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == norm


def test_import_resolution(spark):
    files = spark.createDataFrame([(p, "python") for p in ("pkg/a.py", "pkg/b.py", "pkg/sub/__init__.py", "lib/util.py", "tests/util.py", "x/dup.py", "y/dup.py")] + [("pkg/a.ts", "web")], "path string, family string")
    asked = [("pkg/b.py", "./a"), ("pkg/b.py", "./sub"), ("pkg/b.py", "./none"), ("pkg/b.py", "util"), ("pkg/b.py", "dup"), ("pkg/b.py", "numpy"), ("pkg/b.py", "pkg.a")]
    out = resolve.resolve_imports(spark.createDataFrame([(s, m, "python") for s, m in asked], "src string, module string, family string"), files).collect()
    got = {}
    for r in out:
        got.setdefault(r.module, set()).add((r.dst, r.reference_status))
    assert got == {
        "./a": {("pkg/a.py", None)}, "./sub": {("pkg/sub/__init__.py", None)}, "./none": {("./none", "unresolved")}, "util": {("lib/util.py", None)},
        "dup": {("x/dup.py", "ambiguous"), ("y/dup.py", "ambiguous")}, "numpy": {("numpy", None)}, "pkg.a": {("pkg/a.py", None)},
    }


def test_python_relative_and_member_imports(spark):
    files = spark.createDataFrame([(p, "python") for p in ("pkg/a.py", "pkg/b.py", "pkg/__init__.py", "pkg/sub/c.py", "top.py")], "path string, family string")
    asked = [("pkg/a.py", ".b"), ("pkg/a.py", ".b.member"), ("pkg/sub/c.py", "..b"), ("pkg/sub/c.py", ".."), ("pkg/a.py", ".none"), ("top.py", "pkg.b.member"), ("top.py", "pkg.sub.c")]
    out = resolve.resolve_imports(spark.createDataFrame([(s, m, "python") for s, m in asked], "src string, module string, family string"), files).collect()
    assert {(r.src, r.module): (r.dst, r.reference_status) for r in out} == {
        ("pkg/a.py", ".b"): ("pkg/b.py", None), ("pkg/a.py", ".b.member"): ("pkg/b.py", None), ("pkg/sub/c.py", "..b"): ("pkg/b.py", None), ("pkg/sub/c.py", ".."): ("pkg/__init__.py", None),
        ("pkg/a.py", ".none"): (".none", "unresolved"), ("top.py", "pkg.b.member"): ("pkg/b.py", None), ("top.py", "pkg.sub.c"): ("pkg/sub/c.py", None),
    }


def test_path_contracts(spark):
    files = spark.createDataFrame([("src/a/user_card.ts",), ("src/b/user-card.service.ts",), ("src/a/index.ts",), ("src/b/index.ts",), ("src/docs/user_card.ts",), ("frontend/src/pages/o/Orders.tsx",), ("frontend/src/components/OrderList.vue",)], "path string")
    assert {(r.contract, r.path) for r in contracts.sibling_stems(files).collect()} == {("sibling_stem::web::src::user-card", "src/a/user_card.ts"), ("sibling_stem::web::src::user-card", "src/b/user-card.service.ts")}
    assert {r.path for r in contracts.role_features(files).collect()} == {"frontend/src/pages/o/Orders.tsx", "frontend/src/components/OrderList.vue"}


def test_graph_hash_ignores_order(spark):
    rows = [(f"s{i}", f"d{i % 7}", None) for i in range(50)]
    a, b = spark.createDataFrame(rows, EDGE), spark.createDataFrame(rows[::-1], EDGE).repartition(5)
    assert graph.graph_hash(a).first() == graph.graph_hash(b).first() != graph.graph_hash(a.limit(49)).first()


def test_nfc_and_controls(spark):
    from sparkweft.operators import evaluation, validation

    rows = validation.nfc_fold(spark.createDataFrame([("é",), ("plain",), (None,)], "p string"), "p").collect()
    assert [r.p for r in rows] == ["é", "plain", None]
    files = spark.createDataFrame([(f"f{i}",) for i in range(300)], "path string")
    a = sorted(map(tuple, evaluation.controls(files).collect()))
    assert a == sorted(map(tuple, evaluation.controls(files.repartition(7)).collect())) and 300 < len(a) < 600
