"""Every branch of the rules occurs in the results that the queries are checked against."""

import glob
import os

import duckdb
import pytest

from sparkweft.operators import contention
from sparkweft.plans.catalogue import ORACLES

DIR = "/root/testdata/sf0.01"

CASES = {
    "verdicts": ("SELECT step FROM t", set(range(1, 11))),
    "effective_verdicts": ("SELECT verdict || '>' || effective FROM t", {"unknown>clear", "clear>unknown", "serialize>unknown", "warn>unknown", "unknown>unknown", "clear>clear", "serialize>serialize", "serialize_soft>serialize_soft", "warn>warn"}),
    "waits": ("SELECT unnest([CASE WHEN cross_draft THEN 'draft' END, CASE WHEN low_value THEN 'low' END, CASE WHEN append_soft THEN 'append' END, CASE WHEN advisory THEN 'advisory' END, CASE WHEN NOT (cross_draft OR low_value OR append_soft OR advisory) THEN 'hard' END]) FROM t", {"draft", "low", "append", "advisory", "hard", None}),
    "symbol_overlap_relation": ("SELECT relation FROM t", {"same", "disjoint", "append", "unknown"}),
    "import_suffix_resolve": ("SELECT reference_status FROM t", {None, "ambiguous", "unresolved"}),
    "route_single_definer": ("SELECT sure FROM t", {True, False}),
    "landing_plan_classes": ("SELECT plan FROM t", {"unknown", "mutual", "cycle", "rebase", "ordered_with_revision", "ordered"}),
    "landing_plan_summary": ("SELECT classification FROM t", {"unknown", "mutual", "cycle"}),
    "hotspots": ("SELECT basis FROM t", {"both", "foundation", "god_file"}),
    "split_candidates": ("SELECT basis FROM t", {"both", "collisions", "god_file", "structural"}),
    "account_coverage": ("SELECT CASE WHEN near THEN 'near' WHEN over_by > 0 THEN 'over' ELSE 'free' END FROM t", {"near", "over", "free"}),
    "units_components": ("SELECT premium_capped FROM t", {True, False}),
    "stalled_work": ("SELECT why FROM t", {"abandoned", "starved"}),
    "corroborated_dampened": ("SELECT corroborated FROM t", {True, False}),
    "pair_classification": ("SELECT claim FROM t", {"divergent_definitions", "rebase_needed", "unknown_baseline", "contract_delta:a", "contract_delta:b", None}),
    "compat_candidates": ("SELECT via FROM t", {"shared", "main_graph", "import_scan"}),
    "compat_candidacy": ("SELECT complete FROM t", {True, False}),
    "compat_claims": ("SELECT claim FROM t", {"divergent_definitions", "rebase_needed", "unknown_baseline", "contract_delta:a", "contract_delta:b"}),
    "consumer_mismatches": ("SELECT mismatch FROM t", {"callee_removed", "positional_shortfall", "missing_required_kwonly"}),
    "activation_stages": ("SELECT signal FROM t", {"clear", "heads_up", "wait_in_line", "paused", "unknown", None}),
    "activation_funnel": ("SELECT least(live_accounts - a2_selected_repo, a3_first_pr, live_accounts - a3_first_pr, a4_first_check, a5_first_signal, a9_repeat_7d, live_accounts - a9_repeat_7d, owner_accounts, under_1h, h1_to_1d, d1_to_7d, over_7d) > 0 FROM t", {True}),
    "human_judgments": ("SELECT judgment FROM t", {"useful", "too-late"}),
    "shape_compare": ("SELECT compat_result FROM t", {"compatible", "unknown", "risky", "breaking"}),
}
LEAST = {"inflight_loss_promoted": 5, "cochange_default_floors": 50, "cluster_rollup": 10, "conflict_points": 20, "dampened_pairs": 500, "hub_files": 50, "resource_hubs": 50, "cross_repo_contracts": 100, "graph_blind_pairs": 1000}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", CASES)
def test_branches(duck, name):
    body, want = CASES[name]
    assert {r[0] for r in duck.sql(body.replace("FROM t", f"FROM ({ORACLES[name]}) t")).fetchall()} >= want


@pytest.mark.parametrize("name", LEAST)
def test_rows(duck, name):
    assert len(duck.sql(ORACLES[name]).fetchall()) >= LEAST[name]


def test_evaluation_finds_a_difference(duck):
    row = dict(zip(duck.sql(ORACLES["evaluation_verdict"]).columns, duck.sql(ORACLES["evaluation_verdict"]).fetchall()[0], strict=True))
    assert row["applicable"] and row["real"] and 0 < row["control"] < row["coupled"] < 1


def test_many_clusters(duck):
    assert len({r[0] for r in duck.sql(f"SELECT component FROM ({ORACLES['inflight_components']}) t").fetchall()}) > 50


def test_effective_rules(spark):
    verdict = spark.createDataFrame([(c, v) for c, v in zip("abcdefghi", ["unknown"] * 5 + ["clear", "clear", "serialize", "warn"], strict=True)], "change_id string, verdict string")
    paths = {"a": "nk", "b": "n", "c": "nok", "d": "nk", "e": "nk", "f": "k", "g": "k", "h": "k", "i": "k"}  # n: new, o: absent and not proven new, k: known
    claims = spark.createDataFrame([(c, p) for c, ps in paths.items() for p in ps], "change_id string, path string")
    one = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    damp = spark.createDataFrame([("d", True), ("h", False), ("h", True), ("i", True)], "change_id string, corroborated boolean")
    out = contention.effective_verdicts(verdict, claims, one("k", "path"), damp, one("n", "path"), one("eg", "change_id"))
    assert {r.change_id: r.effective for r in out.collect()} == {"a": "clear", "b": "unknown", "c": "unknown", "d": "unknown", "e": "unknown", "f": "clear", "g": "unknown", "h": "unknown", "i": "warn"}
