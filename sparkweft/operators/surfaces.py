"""Roll-ups of the event log. Every function takes an explicit as_of where the window ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _since(as_of: str, days: int, at: str = "occurred_at") -> Column:
    end = F.lit(as_of).cast("timestamp_ntz")
    return (F.col(at) > end - F.expr(f"interval {days} days")) & (F.col(at) <= end)


def collision_summary(events: DataFrame, as_of: str) -> DataFrame:
    """(agent, held, held_recent, steered): held by another agent; steered where the agent pushed another path at that time or later.

    Whether any such push exists follows from an agent's last push and its last push on another path than that one, so
    nothing is joined with all pushes.
    """
    held = events.where("kind = 'collision_held' and not agent <=> counterparty").select("agent", "path", "occurred_at")
    pushed = events.where("kind = 'pushed'").groupBy("agent", "path").agg(F.max("occurred_at").alias("later"))
    last = pushed.groupBy("agent").agg(F.max(F.struct("later", "path")).alias("top"))
    other = pushed.join(last, "agent").where("path <> top.path").groupBy("agent").agg(F.max("later").alias("else"))
    rows = held.join(last, "agent", "left").join(other, "agent", "left")
    elsewhere = F.when(F.col("top.path") != F.col("path"), F.col("top.later")).otherwise(F.col("else"))
    return rows.groupBy("agent").agg(
        F.count("*").alias("held"), F.count_if(_since(as_of, 7)).alias("held_recent"), F.count_if(F.coalesce(elsewhere >= F.col("occurred_at"), F.lit(False))).alias("steered"),
    )


def recent_collisions(events: DataFrame, most: int = 20) -> DataFrame:
    """(blocked, holder, path, occurred_at): the newest collisions between agents, a report of at most so many."""
    rows = events.where("kind = 'collision_held' and not agent <=> counterparty")
    newest = rows.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(most)
    return newest.select(F.col("agent").alias("blocked"), F.col("counterparty").alias("holder"), "path", "occurred_at")


def effect_counters(events: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """(account, interventions, recent, occurred): occurred are landings that another agent landed on too, within days before.

    One pass along each path, no landing is joined with all others: the newest earlier moment, the agents' least and
    greatest name then, and the newest earlier moment at which another agent than the one there landed.
    """
    base = events.groupBy("account").agg(F.count_if(F.col("kind").isin("collision_held", "warned")).alias("interventions"), F.count_if(F.col("kind").isin("collision_held", "warned") & _since(as_of, 7)).alias("recent"))
    landed = events.where("kind = 'landed'").groupBy("account", "path", "occurred_at", "agent").agg(F.count("*").alias("n"))
    # each moment of a path: the one agent of it, or null where there are several
    moments = landed.groupBy("account", "path", "occurred_at").agg(F.when(F.min("agent") == F.max("agent"), F.min("agent")).alias("sole"))
    along = Window.partitionBy("account", "path").orderBy("occurred_at")
    seen = moments.withColumns({"last_sole": F.lag("sole").over(along), "last_at": F.lag("occurred_at").over(along)})
    # where a moment's agent differs from the one before, the moment before is the newest of another agent, until the next change
    changed = F.when(~F.col("sole").eqNullSafe(F.col("last_sole")) | F.col("last_sole").isNull(), F.col("last_at"))
    seen = seen.withColumn("other_at", F.last(changed, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seen = seen.withColumn("before_last", F.lag("other_at").over(along))
    rows = landed.join(seen, ["account", "path", "occurred_at"])
    newest = F.when(F.col("last_sole") == F.col("agent"), F.col("before_last")).otherwise(F.col("last_at"))
    hit = rows.where(newest >= F.col("occurred_at") - F.expr(f"interval {days} days"))
    return base.join(hit.groupBy("account").agg(F.sum("n").alias("occurred")), "account", "left").na.fill(0, ["occurred"])


def collisions_on_main(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(path, agents): paths that at least two agents landed on in the window."""
    rows = events.where("kind = 'landed'").where(_since(as_of, days))
    return rows.groupBy("path").agg(F.countDistinct("agent").alias("agents")).where("agents >= 2")


def recent_prior(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(path, recent, prior): landings in the window and in the one before it."""
    end = F.lit(as_of).cast("timestamp_ntz")
    now, before = _since(as_of, days), (F.col("occurred_at") > end - F.expr(f"interval {2 * days} days")) & (F.col("occurred_at") <= end - F.expr(f"interval {days} days"))
    out = events.where("kind = 'landed'").groupBy("path").agg(F.count_if(now).alias("recent"), F.count_if(before).alias("prior"))
    return out.where("recent > 0 or prior > 0")


def file_insights(events: DataFrame) -> DataFrame:
    """(path, events, agents, first_at, last_at)."""
    return events.groupBy("path").agg(F.count("*").alias("events"), F.countDistinct("agent").alias("agents"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def now_contended(claims: DataFrame, as_of: str, lease_minutes: int) -> DataFrame:
    """(path, changes): paths with at least two changes in flight whose lease still runs."""
    live = F.col("claimed_at") + F.expr(f"interval {lease_minutes} minutes") > F.lit(as_of).cast("timestamp_ntz")
    rows = claims.where((F.col("claimed_at") <= F.lit(as_of).cast("timestamp_ntz")) & live)
    return rows.groupBy("path").agg(F.countDistinct("change_id").alias("changes")).where("changes >= 2")


def stalled_work(claims: DataFrame, as_of: str, lease_minutes: int, starve_minutes: int = 60) -> DataFrame:
    """(path, change_id, why): abandoned where an active claim's lease ran out and no live one holds the path; starved where
    a claim has waited too long."""
    end = F.lit(as_of).cast("timestamp_ntz")
    rows = claims.where(F.col("claimed_at") <= end)
    live = F.col("claimed_at") + F.expr(f"interval {lease_minutes} minutes") > end
    active = rows.where("state = 'active'")
    gone = active.where(~live).join(active.where(live).select("path").distinct(), "path", "left_anti").select("path", "change_id", F.lit("abandoned").alias("why"))
    starved = rows.where("state = 'waiting'").where(F.col("claimed_at") < end - F.expr(f"interval {starve_minutes} minutes")).select("path", "change_id", F.lit("starved").alias("why"))
    return gone.unionAll(starved)


def stuck_changes(events: DataFrame) -> DataFrame:
    """(change_id, path, failing_since): the latest failure of changes that never landed after it."""
    last = events.where("kind = 'pr_failing'").withColumn("rn", F.row_number().over(Window.partitionBy("change_id", "path").orderBy(F.desc("occurred_at"), F.desc("event_id")))).where("rn = 1")
    landed = events.where("kind = 'landed'").groupBy("change_id", "path").agg(F.max("occurred_at").alias("landed_at"))
    rows = last.join(landed, ["change_id", "path"], "left").where("landed_at is null or landed_at < occurred_at")
    return rows.select("change_id", "path", F.col("occurred_at").alias("failing_since"))


def parse_outcomes(outcomes: DataFrame) -> DataFrame:
    """(pred, adv, land, conf) out of detail strings like pred=...;adv=...;land=...;conf=..."""
    part = lambda k: F.regexp_extract("detail", rf"(?:^|;){k}=([a-z_]+)", 1).alias(k)
    return outcomes.select("*", part("pred"), part("adv"), part("land"), part("conf"))


def outcome_matrix(outcomes: DataFrame) -> DataFrame:
    return parse_outcomes(outcomes).groupBy("pred", "land").agg(F.count("*").alias("n"))


def ignored_advice(outcomes: DataFrame) -> DataFrame:
    """(pred, n, ignored, bad_when_ignored, silent_misses)."""
    bad = F.col("land").isin("conflicted", "reverted")
    rows = parse_outcomes(outcomes)
    return rows.groupBy("pred").agg(
        F.count("*").alias("n"), F.count_if(F.col("adv") == "ignored").alias("ignored"),
        F.count_if((F.col("adv") == "ignored") & bad).alias("bad_when_ignored"), F.count_if((F.col("pred") == "clear") & bad).alias("silent_misses"),
    )


def first_predictions(events: DataFrame) -> DataFrame:
    """The first warning of each change; later ones are ignored."""
    return events.where("kind = 'warned'").groupBy("change_id").agg(F.min_by("event_id", F.struct("occurred_at", "event_id")).alias("event_id"), F.min("occurred_at").alias("occurred_at"))


def seat_count(events: DataFrame, claims: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(seats): distinct agents of events and claims in the window, bots left out."""
    seen = events.where(_since(as_of, days)).select("agent").union(claims.where(_since(as_of, days, "claimed_at")).select("agent")).distinct()
    return seen.where("agent not like '%[bot]'").agg(F.count("*").alias("seats"))


def account_cost(events: DataFrame, free_line: int) -> DataFrame:
    """(account, events, paths, share, over): one grouping for all accounts."""
    out = events.groupBy("account").agg(F.count("*").alias("events"), F.countDistinct("path").alias("paths"))
    return out.select("*", (F.col("events") * 100.0 / free_line).alias("share"), (F.col("events") > free_line).alias("over"))


def coverage(events: DataFrame, limits: DataFrame) -> DataFrame:
    """(account, files, file_limit, over_by, near): near from four fifths of the limit; a null limit is none."""
    files = events.groupBy("account").agg(F.countDistinct("path").alias("files")).join(limits, "account", "left")
    return files.select(
        "account", "files", "file_limit", F.greatest(F.coalesce(F.col("files") - F.col("file_limit"), F.lit(0)), F.lit(0)).alias("over_by"),
        F.coalesce((F.col("files") * 5 >= F.col("file_limit") * 4) & (F.col("files") <= F.col("file_limit")), F.lit(False)).alias("near"),
    )


def activation_latency(events: DataFrame) -> DataFrame:
    """(account, n, p50, p90): seconds from an agent's first push to its first landing after it, interpolated percentiles."""
    first = events.where("kind = 'pushed'").groupBy("account", "agent").agg(F.min("occurred_at").alias("start"))
    landed = events.where("kind = 'landed'").select("account", "agent", F.col("occurred_at").alias("landed_at"))
    rows = first.join(landed, ["account", "agent"]).where("landed_at >= start").groupBy("account", "agent").agg(F.min("landed_at").alias("landed_at"), F.first("start").alias("start"))
    # whole seconds: both ends are cut to the second first
    secs = F.unix_timestamp(F.col("landed_at").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    rows = rows.withColumn("secs", secs)
    return rows.groupBy("account").agg(F.count("*").alias("n"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY secs)").alias("p50"), F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY secs)").alias("p90"))


def repeat_within(events: DataFrame, days: int = 7) -> DataFrame:
    """(account, agents, repeated): agents, and those whose second action came within days of their first."""
    order = Window.partitionBy("account", "agent").orderBy("occurred_at", "event_id")
    rows = events.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    per = rows.groupBy("account", "agent").agg(F.min(F.when(F.col("rn") == 1, F.col("occurred_at"))).alias("one"), F.min(F.when(F.col("rn") == 2, F.col("occurred_at"))).alias("two"))
    return per.groupBy("account").agg(F.count("*").alias("agents"), F.count_if(F.coalesce(F.col("two") <= F.col("one") + F.expr(f"interval {days} days"), F.lit(False))).alias("repeated"))


def retention_prune(events: DataFrame, as_of: str, days: dict[str, int]) -> DataFrame:
    """What stays: of the kinds in days the events in their window, all of the others."""
    keep = ~F.col("kind").isin(list(days))
    for kind, n in days.items():
        keep = keep | ((F.col("kind") == kind) & (F.col("occurred_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {n} days")))
    return events.where(keep)


def generation_filter(rows: DataFrame, boundaries: DataFrame, tombstones: DataFrame, key: str, at: str) -> DataFrame:
    """Rows at or after their key's activation, of keys that have no tombstone."""
    kept = rows.join(tombstones.select(key).distinct(), key, "left_anti").join(boundaries.select(key, "active_from"), key, "left")
    return kept.where(F.col("active_from").isNull() | (F.col(at) >= F.col("active_from"))).drop("active_from")


def push_coalesce(pushes: DataFrame, keys: list[str], window: Column) -> DataFrame:
    """One push per key and micro-batch: the newest; where it skipped others it needs a full ingest."""
    return pushes.groupBy(*keys, window.alias("batch")).agg(F.max_by("event_id", F.struct("occurred_at", "event_id")).alias("event_id"), (F.count("*") - 1).alias("skipped"), (F.count("*") > 1).alias("full"))


def board(claims: DataFrame) -> DataFrame:
    """(agent, active, waiting, paths): each agent's work with its active paths in order."""
    return claims.groupBy("agent").agg(
        F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "waiting").alias("waiting"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "active", F.col("path")))), ",").alias("paths"),
    )


def page(rows: DataFrame, key: str, after: str, size: int) -> DataFrame:
    """Keyset pagination: the rows behind the cursor, one more than a page to see whether there is a next."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size + 1)


def freshness(versions: DataFrame, heads: DataFrame, extractor: str, as_of: str) -> DataFrame:
    """(repo, behind, age): behind where the stored commit or extractor is not the current one; age in seconds."""
    rows = versions.join(heads, "repo", "left")
    behind = ~F.col("commit_sha").eqNullSafe(F.col("head_sha")) | ~F.col("extractor_version").eqNullSafe(F.lit(extractor))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("captured_at").cast("timestamp"))
    return rows.select("repo", behind.alias("behind"), age.alias("age"))


def rekey(rows: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """Rows with their coordinate under its new name; renames (old, new) has one row per old name."""
    table = renames.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return rows.join(table, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new").select(rows.columns)


def fair_order(deliveries: DataFrame, per_account: int) -> DataFrame:
    """(delivery, turn): each account's deliveries in order of arrival, accounts taking turns, at most per_account in flight (the queue's own cap)."""
    order = Window.partitionBy("account").orderBy("occurred_at", "event_id")
    return deliveries.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_account).select("event_id", "account", "turn")
