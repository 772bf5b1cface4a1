"""Connected components and depths of the conflict graph by iteration, each round cut off by a written table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def cut_dir(spark: SparkSession) -> str:
    """The folder of the tables that cut lineages: spark.checkpoint.dir, else the context's checkpoint folder; where neither is set, in
    local mode, a temporary one."""
    global _own_dir
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sparkweft-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: worked out once, without lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{cut_dir(spark)}/sparkweft-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(table: DataFrame) -> None:
    """Deletes what cut wrote, once what was made of it is written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), taken both ways.

    Each round a node's label falls to the least of its neighbours' (hook) and then to its label's label (jump). Raises if the
    labels don't settle.
    """
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = cut(nodes.select("node", F.col("node").alias("component"), F.lit(True).alias("moved")).distinct())
    for _ in range(max_rounds):
        labels = now.select("node", "component")
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("hook"))
        root = labels.select(F.col("node").alias("hook"), F.col("component").alias("up"))
        after = cut(hooked.join(root, "hook", "left").select("node", F.least("hook", F.coalesce("up", "hook")).alias("component"), (F.least("hook", F.coalesce("up", "hook")) != F.col("component")).alias("moved")))
        drop_cut(now)
        now = after
        if not now.where("moved").limit(1).count():
            drop_cut(both)
            return now.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def depths(nodes: DataFrame, deps: DataFrame, max_hops: int = 64) -> DataFrame:
    """(node, depth): the longest way from node over deps (node, needs), at most max_hops long; 0 where it needs nothing."""
    steps = cut(deps.select("node", "needs").distinct())
    now = cut(nodes.select("node", F.lit(0).alias("depth"), F.lit(True).alias("moved")).distinct())
    for _ in range(max_hops):
        front = now.where("moved").select(F.col("node").alias("needs"), "depth")
        step = steps.join(front, "needs").groupBy("node").agg((F.max("depth") + 1).alias("new"))
        after = cut(now.drop("moved").join(step, "node", "left").select("node", F.greatest("depth", F.coalesce("new", "depth")).alias("depth"), F.coalesce(F.col("new") > F.col("depth"), F.lit(False)).alias("moved")))
        drop_cut(now)
        now = after
        if not now.where("moved").limit(1).count():
            break
    drop_cut(steps)
    return now.select("node", "depth")
