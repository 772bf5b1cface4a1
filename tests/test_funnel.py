"""Activation steps on small logs: fences, deadlines, ties and odd rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import funnel

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="module")
def tables(spark):
    installs = [("a", at(0), False, 1), ("a", at(5), False, 1), ("a", at(-9), True, 1), ("b", at(0), True, 1), ("c", at(0), None, 1), (None, at(0), False, 1), ("d", at(200), False, 1), ("e", at(0), False, 1)]
    acts = [
        ("a", "r", "claim", "PR-1", at(1), None), ("a", "r", "claim", "PR-0", at(3), None), ("a", "r", "claim", "PR-0", at(3), None), ("a", "r", "warn_issued", "PR-1", at(3 + 168), None), ("a", "r", "check_published", "PR-1", at(5), "paused"), ("a", "r", "check_published", "PR-1", at(5), "heads_up"),
        ("a", "gone", "claim", "PR-2", at(2), None), ("a", "", "claim", "PR-2", at(2), None), ("a", None, "claim", "PR-2", at(2), None), ("a", "r", "claim", "PR-2", None, None),
        ("b", "r", "claim", "PR-1", at(1), None), ("c", "q", "claim", "BR-1", at(1), None), ("c", "q", "check_published", "PR-1", at(2), "odd"), ("c", "q", "collision_held", None, at(1), None), ("c", "q", "collision_held", None, at(170), None), ("c", "s", "collision_held", None, at(3), None),
        ("d", "r", "claim", "PR-1", at(1), None),
        ("a", "gone", "human_judgment", "PR-1", at(1), "judgment=useful action=waited"), ("a", "gone", "human_judgment", "PR-1", at(2), "judgment=wrong"), ("a", "r", "human_judgment", "PR-2", at(2), "nothing"), ("c", "r", "human_judgment", "PR-2", at(2), "judgment=useful action=waited"), ("b", "r", "human_judgment", "PR-2", at(2), "judgment=useful"),
    ]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (
        frame(installs, "account string, created_at timestamp, revoked boolean, extra int"),
        frame([("a", "r", at(0)), ("a", "r", at(3)), ("a", "gone", at(0)), ("d", "gone", at(0))], "account string, repo string, activated_at timestamp"),
        frame([("a", "gone"), ("a", "gone"), ("d", "gone"), (None, None)], "account string, repo string"),
        frame(acts, "account string, repo string, kind string, change_id string, acted_at timestamp, detail string"),
    )


def test_stages(tables):
    rows = {r.account: r for r in funnel.activation_stages(*tables).collect()}
    assert set(rows) == {"a", "c", "d", "e"}
    a, c, d, e = (rows[k] for k in "acde")
    # The claim before the last activation does not count; the warning comes a week after the first that does, to the hour.
    assert (a.installed_at, a.selected, a.first_pr, a.signal, a.warns, a.serializes, a.repeated) == (at(0), True, at(3), "heads_up", 1, 0, True)
    assert (a.to_pr, a.to_check, a.pr_to_check, a.first_at, a.last_at) == (3 * 3600, 5 * 3600, 2 * 3600, at(3), at(171))
    # Second actions in another repository, or more than a week later, are no return.
    assert (c.selected, c.first_pr, c.signal, c.serializes, c.repeated, c.to_check, c.pr_to_check) == (False, None, "unknown", 3, False, 2 * 3600, None)
    assert (d.selected, d.to_pr, d.repeated) == (False, 0, False)
    assert (e.first_pr, e.signal, e.warns, e.repeated, e.first_at) == (None, None, 0, False, None)


def test_funnel_and_judgments(spark, tables):
    installs, acts = tables[0], tables[3]
    own = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "account string")
    stages = funnel.activation_stages(*tables)
    got = funnel.activation_funnel(stages, installs, own).first().asDict()
    want = {"installs_total": 8, "installs_live": 6, "live_accounts": 4, "external_accounts": 3, "owner_accounts": 1, "a2_selected_repo": 1, "a3_first_pr": 2, "a4_first_check": 2, "a5_first_signal": 2, "a9_repeat_7d": 1, "a4_heads_up": 1, "a4_unknown": 1, "a4_clear": 0, "warns": 1, "serializes": 3, "to_pr_n": 2, "to_pr_p50": 5400, "to_pr_p90": 9720, "under_1h": 1, "h1_to_1d": 1, "over_7d": 0}
    assert {k: got[k] for k in want} == want
    assert {tuple(r) for r in funnel.judgments(acts, stages, own).collect()} == {("wrong", None, 1, 0), ("useful", "waited", 1, 1)}


def test_empty(tables):
    installs, activations, tombstones, acts = (t.where(F.lit(False)) for t in tables)
    stages = funnel.activation_stages(installs, activations, tombstones, acts)
    row = funnel.activation_funnel(stages, installs, tombstones.select("account")).first()
    assert stages.count() == 0 and (row.live_accounts, row.a3_first_pr, row.to_pr_p50, row.warns) == (0, 0, None, 0)
    assert funnel.judgments(acts, stages, tombstones.select("account")).count() == 0
