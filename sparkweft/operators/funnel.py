"""The activation funnel: how far live accounts come from installing to coming back, with the seconds between steps.

Steps of an account: A2 has a repository selected now; A3 a first pull request; A4 a first check published, with its signal; A5 a first warning or held
collision; A9 in one repository a second action within a week of the first. Only what a repository's present life holds counts: nothing
before its last activation, nothing of one that is gone. Comments, acknowledgements and required checks (A6 to A8) are not in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEAT_DAYS = 7
#: What a check may signal, all else is unknown; what a signal event is; latency buckets in seconds.
SIGNALS = ("clear", "heads_up", "wait_in_line", "paused")
SIGNAL_KINDS = ("warn_issued", "collision_held")
BUCKETS = {"under_1h": (0, 3600), "h1_to_1d": (3600, 86400), "d1_to_7d": (86400, 604800), "over_7d": (604800, None)}


def _seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds from one to the other, none below 0 where clocks disagree."""
    s = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return F.when(later.isNotNull() & earlier.isNotNull(), F.greatest(s(later) - s(earlier), F.lit(0)))


def present_acts(acts: DataFrame, activations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """acts (account, repo, acted_at) of named repositories that are not gone, from their last activation on; one never activated has no bound."""
    start = activations.groupBy("account", "repo").agg(F.max("activated_at").alias("start"))
    rows = acts.where("account is not null and repo <> '' and acted_at is not null").join(tombstones.select("account", "repo").distinct(), ["account", "repo"], "left_anti")
    return rows.join(start, ["account", "repo"], "left").where("start is null or acted_at >= start").drop("start")


def activation_stages(installs: DataFrame, activations: DataFrame, tombstones: DataFrame, acts: DataFrame) -> DataFrame:
    """One row for each account with a live installation: installed_at, selected, first_pr, first_check, signal, warns, serializes, repeated,
    first_at, last_at, and the seconds to_pr, to_check and pr_to_check.

    installs (account, created_at, revoked); activations (account, repo, activated_at); tombstones (account, repo) of repositories gone for now;
    acts (account, repo, kind, change_id, acted_at, detail) with kind claim or an event's. Counts by partial aggregates only: the first action of a repository,
    then the first after it, so that one repository with most of all acts is no single task's. Of checks at one time the smaller detail
    is the first. Null accounts are left out, repeated acts count as often as they occur, empty tables give an empty one.
    """
    live = installs.where("not coalesce(revoked, false) and account is not null").groupBy("account").agg(F.min("created_at").alias("installed_at"))
    gone = tombstones.select("account", "repo").distinct()
    selected = activations.join(gone, ["account", "repo"], "left_anti").select("account").distinct().withColumn("selected", F.lit(True))
    now = present_acts(acts.join(live.select("account"), "account", "left_semi"), activations, tombstones)
    pull = (F.col("kind") == "claim") & F.col("change_id").startswith("PR-")
    signal = F.col("kind").isin(*SIGNAL_KINDS)
    check = (F.col("kind") == "check_published") & F.col("change_id").startswith("PR-")
    firsts = now.groupBy("account", "repo").agg(
        F.min(F.when(pull, F.col("acted_at"))).alias("first_pr"),
        F.min(F.when(check, F.struct("acted_at", F.coalesce("detail", F.lit("")).alias("detail")))).alias("check"),
        F.count_if(F.col("kind") == SIGNAL_KINDS[0]).alias("warns"), F.count_if(F.col("kind") == SIGNAL_KINDS[1]).alias("serializes"),
        F.min(F.when(pull | signal, F.col("acted_at"))).alias("one"), F.max(F.when(pull | signal, F.col("acted_at"))).alias("last"),
    )
    later = now.where(pull | signal).join(firsts.select("account", "repo", "one"), ["account", "repo"]).where("acted_at > one").groupBy("account", "repo").agg(F.min("acted_at").alias("two"))
    again = F.coalesce(F.col("two") <= F.col("one") + F.expr(f"interval {REPEAT_DAYS} days"), F.lit(False))
    per = firsts.join(later, ["account", "repo"], "left").groupBy("account").agg(
        F.min("first_pr").alias("first_pr"), F.min("check").alias("check"), F.sum("warns").alias("warns"), F.sum("serializes").alias("serializes"),
        F.max(again).alias("repeated"), F.min("one").alias("first_at"), F.max("last").alias("last_at"),
    )
    rows = live.join(selected, "account", "left").join(per, "account", "left").na.fill(False, ["selected", "repeated"]).na.fill(0, ["warns", "serializes"])
    told = F.when(F.col("check.detail").isin(*SIGNALS), F.col("check.detail")).when(F.col("check").isNotNull(), "unknown")
    rows = rows.withColumn("signal", told).withColumn("first_check", F.col("check.acted_at")).drop("check")
    return rows.withColumns({"to_pr": _seconds(F.col("first_pr"), F.col("installed_at")), "to_check": _seconds(F.col("first_check"), F.col("installed_at")), "pr_to_check": _seconds(F.col("first_check"), F.col("first_pr"))})


def activation_funnel(stages: DataFrame, installs: DataFrame, own: DataFrame) -> DataFrame:
    """One row: installations and accounts, how many reached each step, what first checks signalled, and latencies with their median and 90th percentile.

    own (account) are the operator's accounts, which count as live but not as external. Without live accounts all counts are 0 and latencies null.
    """
    mine = own.where("account is not null").select("account").distinct().withColumn("own", F.lit(True))
    part = lambda c, p: F.round(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {c})")).cast("long")
    steps = {"a2_selected_repo": F.col("selected"), "a3_first_pr": F.col("first_pr").isNotNull(), "a4_first_check": F.col("first_check").isNotNull(), "a5_first_signal": F.col("warns") + F.col("serializes") > 0, "a9_repeat_7d": F.col("repeated")}
    between = lambda low, high: (F.col("to_pr") >= low) & (F.lit(True) if high is None else F.col("to_pr") < high)
    out = stages.join(mine, "account", "left").agg(
        F.count("*").alias("live_accounts"), F.count_if(F.col("own").isNull()).alias("external_accounts"), F.count_if(F.col("own")).alias("owner_accounts"),
        *[F.count_if(c).alias(n) for n, c in steps.items()], *[F.count_if(F.col("signal") == s).alias(f"a4_{s}") for s in (*SIGNALS, "unknown")],
        F.coalesce(F.sum("warns"), F.lit(0)).alias("warns"), F.coalesce(F.sum("serializes"), F.lit(0)).alias("serializes"),
        *[x for c in ("to_pr", "to_check", "pr_to_check") for x in (F.count(c).alias(f"{c}_n"), part(c, 0.5).alias(f"{c}_p50"), part(c, 0.9).alias(f"{c}_p90"))],
        *[F.count_if(between(*b)).alias(n) for n, b in BUCKETS.items()], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )
    totals = installs.agg(F.count("*").alias("installs_total"), F.count_if(~F.coalesce("revoked", F.lit(False))).alias("installs_live"))
    return totals.crossJoin(out)  # one row each


def judgments(acts: DataFrame, stages: DataFrame, own: DataFrame) -> DataFrame:
    """(judgment, action, total, external): the last human judgment of each change of live accounts, by verdict and by what was done.

    detail reads judgment=word action=word; one without a judgment says nothing, one without an action has none. Of judgments at one time the
    larger detail is the last. A judgment is the account's whatever became of the repository.
    """
    key = ["account", "repo", "change_id"]
    said = acts.where("kind = 'human_judgment'").join(stages.select("account"), "account", "left_semi")
    last = said.groupBy(*key).agg(F.max(F.struct("acted_at", F.coalesce("detail", F.lit("")).alias("detail"))).alias("last"))
    word = lambda name: F.nullif(F.regexp_extract("last.detail", f"{name}=([a-z-]+)", 1), F.lit(""))
    mine = own.where("account is not null").select("account").distinct().withColumn("own", F.lit(True))
    rows = last.select("account", word("judgment").alias("judgment"), word("action").alias("action")).where("judgment is not null").join(mine, "account", "left")
    return rows.groupBy("judgment", "action").agg(F.count("*").alias("total"), F.count_if(F.col("own").isNull()).alias("external"))
