"""Many small components of findings go to Python together, each planned by itself."""

from sparkweft.operators import landing


def test_components_are_no_groups_of_their_own(spark):
    rows = [(f"L{i}-1", f"L{i}-2", "r", "breaking" if i % 2 else "unknown") for i in range(40)]
    plan = landing.landing_plan(spark.createDataFrame(rows, "producer_pr string, consumer_pr string, rule_id string, compat_result string"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroups" not in text and "Range" not in text
    got = {(r.component, r.change_id): (r.plan, r.position, r.step) for r in plan.collect()}
    assert len(got) == 80 and got["L3-1", "L3-2"] == ("ordered", 2, "land") and got["L2-1", "L2-1"] == ("unknown", None, "hold_pending_analysis")
    assert landing.landing_plan(spark.createDataFrame(rows[:0], "producer_pr string, consumer_pr string, rule_id string, compat_result string")).count() == 0
