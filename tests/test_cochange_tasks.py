"""Tasks that make pairs are bounded by the number of rows, whatever the session's shuffle partitions."""

from sparkweft.operators import cochange as cc


def test_pairs_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(cc, "ROWS_A_TASK", 100)
    touch = spark.range(3000).selectExpr("id % 500 as commit_id", "concat('p', id % 700) as path")
    kept, tasks = cc.stored_baskets(touch)
    assert tasks == 30  # the session has 8 shuffle partitions
    plain, spread = cc.pair_counts(cc.baskets(touch)), cc.pair_counts(kept, tasks=tasks)
    assert spread.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, plain.collect()))
    both = cc.merge_counts(plain, spread, tasks=tasks)
    assert {(r.path_a, r.path_b): r.co for r in both.collect()} == {(r.path_a, r.path_b): 2 * r.co for r in plain.collect()}


def test_no_rows_need_one_task(spark):
    kept, tasks = cc.stored_baskets(spark.createDataFrame([], "commit_id long, path string"))
    assert tasks == 1 and cc.pair_counts(kept, tasks=tasks).count() == 0
