"""Commit history: log lines and push payloads as long tables of touches, renames folded to the latest name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.operators.components import cut


def parse_log(lines: DataFrame, window: int = 800) -> DataFrame:
    """(repo, commit_id, nth, status, path, old_path) out of rows (position, value, and repo where there are several) of logs with a
    line 'commit <sha>' before each commit's status lines, newest first; of each log at most window commits (a look-back, as
    the history scan defines it).

    The window's commits are found first, as a top-k over the commit lines alone, so lines behind the look-back are neither
    moved nor sorted; a log's remaining lines are put in order in one task.
    """
    several = "repo" in lines.columns
    rows = lines.select(F.col("repo") if several else F.lit("").alias("repo"), "position", "value")
    sha = F.nullif(F.regexp_extract("value", "^commit ([0-9a-f]+)", 1), F.lit(""))
    heads = rows.select("repo", "position", sha.alias("commit_id")).where("commit_id is not null")
    order = Window.partitionBy("repo").orderBy("position")
    nth = heads.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= window + 1)
    ends = nth.where(F.col("nth") == window + 1).select("repo", F.col("position").alias("end"))
    near = rows.join(F.broadcast(ends), "repo", "left").where("end is null or position < end").drop("end")  # one row a log
    marked = near.withColumn("commit_id", F.last(sha, ignorenulls=True).over(order)).withColumn("nth", F.count(sha).over(order))
    parts = F.split("value", "\t")
    files = marked.where(sha.isNull() & (F.col("nth") > 0)).where(F.size(parts) >= 2)
    status = F.substring(F.get(parts, F.lit(0)), 1, 1)
    out = files.select("repo", "commit_id", "nth", status.alias("status"), F.element_at(parts, -1).alias("path"), F.when(status == "R", F.get(parts, F.lit(1))).alias("old_path"))
    return out if several else out.drop("repo")


def latest_names(renames: DataFrame) -> DataFrame:
    """(path, latest): each renamed path and the newest name its renames lead to. renames are (nth, old_path, path), newest first by
    nth; of several renames of a name the oldest counts. Each round follows one rename more, and a name that was passed already
    ends the way, so there are as many rounds as one file has names."""
    steps = cut(renames.where("old_path <> path").groupBy(F.col("old_path").alias("path")).agg(F.max_by("path", F.struct("nth", "path")).alias("latest")))
    step = steps.select(F.col("path").alias("latest"), F.col("latest").alias("next"))
    now = steps.select("path", "latest", F.array("path", "latest").alias("trail"), F.lit(True).alias("moved"))
    while now.where("moved").limit(1).count():
        on = now.where("moved").join(step, "latest", "left")
        goes = F.col("next").isNotNull() & ~F.array_contains("trail", F.col("next"))
        went = on.select("path", F.when(goes, F.col("next")).otherwise(F.col("latest")).alias("latest"), F.when(goes, F.array_append("trail", F.col("next"))).otherwise(F.col("trail")).alias("trail"), F.coalesce(goes, F.lit(False)).alias("moved"))
        now = cut(now.where("not moved").unionByName(went))
    return now.select("path", "latest")


def fold_renames(touches: DataFrame, log: DataFrame) -> DataFrame:
    """touches with each path under its latest name, by all renames of the log."""
    names = latest_names(log.where("status = 'R' and old_path is not null").select("nth", "old_path", "path"))
    return touches.join(names, "path", "left").withColumn("path", F.coalesce("latest", "path")).drop("latest").distinct()


PAYLOAD = "struct<repository:struct<full_name:string>,ref:string,commits:array<struct<id:string,added:array<string>,modified:array<string>,removed:array<string>>>>"


def push_touches(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(repo, branch, commit_id, path) of push payloads in JSON; a commit without id gets the hash of its place and paths."""
    none = F.expr("cast(array() as array<string>)")
    rows = payloads.select(F.from_json(body, PAYLOAD).alias("p")).select(F.col("p.repository.full_name").alias("repo"), F.regexp_replace("p.ref", "^refs/heads/", "").alias("branch"), F.posexplode("p.commits").alias("at", "c"))
    paths = F.array_sort(F.array_union(F.array_union(F.coalesce("c.added", none), F.coalesce("c.modified", none)), F.coalesce("c.removed", none)))
    rows = rows.withColumn("paths", paths).withColumn("commit_id", F.coalesce(F.nullif("c.id", F.lit("")), F.sha1(F.concat_ws("\n", F.col("at"), F.col("paths")))))
    return rows.select("repo", "branch", "commit_id", F.explode("paths").alias("path")).distinct()
