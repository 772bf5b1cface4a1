"""Streaming forms: the claim state machine, coalesced pushes, deduplicated deliveries, co-change increments.

Claims are per-path state: one active holder, waiters in order of arrival, leases that run out in event time. The same
step function drives the stream and the batch replay, so their results can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "path string, change_id string, action string, at timestamp"
STATE = "holder string, lease_until timestamp, waiting array<string>"


def lease_minutes(value: int | None, default: int = 30) -> int:
    """The policy value within its bounds."""
    return min(1440, max(5, default if value is None else value))


def apply_event(state: tuple, change: str, kind: str, at: pd.Timestamp, lease: pd.Timedelta) -> tuple[tuple, list[tuple[str, str]]]:
    """One event on one path. State is (holder, lease_until, waiting); the result lists (change, action).

    declare: a holder's own is a heartbeat; a free path is taken; else the change waits, once. release or land: the holder
    goes and the first waiter follows; a waiter leaves the line. Before anything a lease that has run out passes the path on,
    and the displaced holder goes to the end of the line.
    """
    holder, until, waiting = state
    waiting, said = list(waiting), []

    def promote():
        nonlocal holder, until
        holder = waiting.pop(0) if waiting else None
        until = at + lease if holder else None
        if holder:
            said.append((holder, "promoted"))

    if holder and until is not None and until < at:
        gone = holder
        said.append((gone, "expired"))
        if waiting:
            waiting.append(gone)
            said.append((gone, "waiting"))
        promote()
    if kind == "declare":
        if change == holder:
            until = at + lease
            said.append((change, "heartbeat"))
        elif holder is None:
            holder, until = change, at + lease
            said.append((change, "active"))
        elif change not in waiting:
            waiting.append(change)
            said.append((change, "waiting"))
    elif kind in ("release", "land"):
        if change == holder:
            said.append((change, "released" if kind == "release" else "landed"))
            promote()
        elif change in waiting:
            waiting.remove(change)
            said.append((change, "left"))
    return (holder, until, waiting), said


def _run(rows: pd.DataFrame, state: tuple, path: str, lease: pd.Timedelta) -> tuple[tuple, list[tuple]]:
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        state, said = apply_event(state, r.change_id, r.kind, r.at, lease)
        out += [(path, c, a, r.at) for c, a in said]
    return state, out


def claim_stream(events: DataFrame, lease: int = 30, watermark: str = "10 minutes") -> DataFrame:
    """Events (path, change_id, kind, at, event_id) to actions, by arbitrary state per path with an event-time timeout on the lease."""
    span = pd.Timedelta(minutes=lease_minutes(lease))

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = (group.get[0], group.get[1], list(group.get[2])) if group.exists else (None, None, [])
        out: list[tuple] = []
        if group.hasTimedOut:
            now = pd.Timestamp(group.getCurrentWatermarkMs(), unit="ms")
            state, said = apply_event(state, "", "tick", now, span)
            out = [(key[0], c, a, now) for c, a in said]
        else:
            state, out = _run(pd.concat(list(batches)), state, key[0], span)
        if state[0] is None and not state[2]:
            group.remove()
        else:
            group.update((state[0], state[1].to_pydatetime(), state[2]))
            due = int(state[1].timestamp() * 1000) + 1
            group.setTimeoutTimestamp(max(due, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "change_id", "action", "at"])

    return events.withWatermark("at", watermark).groupBy("path").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def claim_replay(events: DataFrame, lease: int = 30) -> DataFrame:
    """The same machine over a finished log."""
    span = pd.Timedelta(minutes=lease_minutes(lease))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_run(pdf, (None, None, []), pdf["path"].iloc[0], span)[1], columns=["path", "change_id", "action", "at"])

    return events.groupBy("path").applyInPandas(replay, OUTPUT)


def deduplicated_deliveries(stream: DataFrame, key: str = "delivery_key", at: str = "received_at", within: str = "1 day") -> DataFrame:
    """Each delivery once, remembered for as long as the watermark allows."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def coalesced_pushes(stream: DataFrame, at: str = "at", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """One push per repo, branch and window, the newest; full where it stands for several."""
    rows = stream.withWatermark(at, late).groupBy("repo", "branch", F.window(at, every).alias("w"))
    out = rows.agg(F.max_by("commit_sha", at).alias("commit_sha"), F.count("*").alias("pushes"))
    return out.select("repo", "branch", F.col("w.start").alias("start"), "commit_sha", (F.col("pushes") > 1).alias("full"))


def cochange_sink(state_dir: str, max_files: int = 40):
    """A foreachBatch function that folds each batch of touches (commit_id, path) into exact count tables under state_dir.

    Batches are folders of their own: a batch that is run again overwrites itself, and commits that earlier batches have
    seen are left out. Commit ids are kept as strings, so hex ids and numbers both do.
    """
    from sparkweft.operators.cochange import baskets, file_counts, pair_counts, unseen

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen_dir = f"{state_dir}/seen"
        fresh = batch.select(F.col("commit_id").cast("string"), "path").distinct()
        if batch_id:
            seen = spark.read.schema("commit_id string, batch int").parquet(seen_dir).where(F.col("batch") < batch_id)
            fresh = unseen(fresh, seen)
        fresh.persist()
        kept = baskets(fresh, max_files)
        file_counts(kept).write.mode("overwrite").parquet(f"{state_dir}/files/batch={batch_id}")
        pair_counts(kept).write.mode("overwrite").parquet(f"{state_dir}/pairs/batch={batch_id}")
        fresh.select("commit_id").distinct().write.mode("overwrite").parquet(f"{seen_dir}/batch={batch_id}")
        fresh.unpersist()

    return fold
