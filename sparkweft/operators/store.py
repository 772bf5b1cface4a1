"""A versioned store of graphs: whole ingests and incremental patches for any number of coordinates at once, with compare-and-set.

A coordinate is one graph (account, repository and branch in one string). Tables lie in data/<id>/bucket=<b>, by a hash of the coordinate;
a manifest names the folder of each bucket. A commit writes the buckets that it changes, then puts the next manifest in place by a
rename that fails where one is there: of two writers on one version one loses, and readers see a version or the next one, never a mix.
What a lost commit wrote is not read by anyone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.operators.components import cut

SCHEMAS = {
    "version": "coordinate string, commit string, captured_at timestamp_ntz, revision long, base_commit string, base_revision long",
    "node": "coordinate string, id string, path string",
    "edge": "coordinate string, src string, dst string, kind string, reference_status string",
}
BUCKETS = 64


class LostRace(RuntimeError):
    """Another writer's manifest came first."""


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """(number, table to bucket to folder) of the newest version; 0 and nothing in a new store."""
        folder = self._path("manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.spark.read.text(f"{self.root}/manifest/{max(numbers):012d}.json", wholetext=True).first()[0])

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table's rows in one version, the newest if none is given."""
        at = (self.manifest()[1] if manifest is None else manifest).get(name, {})
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/data/{folder}/bucket={b}" for b, folder in at.items()])

    def commit(self, number: int, manifest: dict, changes: dict[str, DataFrame], buckets: list[int]) -> int:
        """Puts the given tables' rows, which replace all rows of these buckets, on version number; raises LostRace where it is no longer the newest."""
        after = {t: dict(m) for t, m in manifest.items()}
        for name, rows in changes.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.withColumn("bucket", bucket_of()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            written = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(self._path(f"data/{folder}"))}
            kept = {b: f for b, f in after.get(name, {}).items() if int(b) not in buckets}
            after[name] = kept | {str(b): folder for b in buckets if str(b) in written}
        draft, final = self._path(f"draft/{uuid.uuid4().hex}.json"), self._path(f"manifest/{number + 1:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise LostRace(f"version {number + 1} is there") from e
            raise
        return number + 1

    def _replace(self, state: tuple[int, dict], accepted: DataFrame, versions: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        """Commits new rows for the accepted coordinates; others in their buckets stay as they are."""
        number, manifest = state
        mine = accepted.select("coordinate").distinct()
        buckets = [r[0] for r in mine.select(bucket_of()).distinct().collect()]  # at most BUCKETS
        if not buckets:
            return
        changes = {}
        for name, fresh in (("version", versions), ("node", nodes), ("edge", edges)):
            others = self.table(name, manifest).where(bucket_of().isin(buckets)).join(mine, "coordinate", "left_anti")
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            changes[name] = others.select(columns).unionByName(fresh.select(columns))
        self.commit(number, manifest, changes, buckets)

    def ingest(self, graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Whole graphs (coordinate, commit, captured_at) with their nodes and edges; returns (coordinate, outcome).

        stale: a newer one is stored, by captured_at; unchanged: this very one is; else stored, under the next revision.
        """
        state = self.manifest()
        old = self.table("version", state[1]).select("coordinate", F.col("commit").alias("old_commit"), F.col("captured_at").alias("old_at"), F.col("revision").alias("old_revision"))
        same = (F.col("old_commit") == F.col("commit")) & (F.col("old_at") == F.col("captured_at"))
        outcome = F.when(same, "unchanged").when(F.col("old_at") > F.col("captured_at"), "stale").otherwise("stored")
        judged = cut(graphs.join(old, "coordinate", "left").withColumn("outcome", outcome))
        good = judged.where("outcome = 'stored'")
        versions = good.select("coordinate", "commit", "captured_at", (F.coalesce("old_revision", F.lit(0)) + 1).alias("revision"), F.lit(None).cast("string").alias("base_commit"), F.lit(None).cast("long").alias("base_revision"))
        only = lambda rows: rows.join(good.select("coordinate"), "coordinate", "left_semi")
        self._replace(state, good, versions, only(nodes), only(edges))
        return judged.select("coordinate", "outcome")

    def patch(self, patches: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Patches (coordinate, commit, captured_at, base_commit, base_revision) with the paths that they touch (coordinate, path, removed)
        and the fresh rows of these; returns (coordinate, outcome).

        A patch is stored where base_commit and base_revision are the stored ones, unchanged where it is the patch that was stored
        last, else a conflict. Rows that touched paths own go, and so do edges into removed ones; the fresh rows come.
        """
        state = self.manifest()
        old = self.table("version", state[1]).select("coordinate", F.col("commit").alias("old_commit"), F.col("revision").alias("old_revision"), F.col("base_commit").alias("last_commit"), F.col("base_revision").alias("last_revision"))
        fits = (F.col("old_commit") == F.col("base_commit")) & (F.col("old_revision") == F.col("base_revision"))
        again = (F.col("old_commit") == F.col("commit")) & (F.col("last_commit") == F.col("base_commit")) & (F.col("last_revision") == F.col("base_revision"))
        judged = cut(patches.join(old, "coordinate", "left").withColumn("outcome", F.when(fits, "stored").when(again, "unchanged").otherwise("conflict")))
        good = judged.where("outcome = 'stored'")
        only = lambda rows: rows.join(good.select("coordinate"), "coordinate", "left_semi")
        touched = only(paths).select("coordinate", "path").distinct()
        gone = only(paths.where("removed")).select("coordinate", F.col("path").alias("dst")).distinct()
        versions = good.select("coordinate", "commit", "captured_at", (F.col("old_revision") + 1).alias("revision"), "base_commit", "base_revision")
        kept_nodes = only(self.table("node", state[1])).join(touched, ["coordinate", "path"], "left_anti")
        kept_edges = only(self.table("edge", state[1])).join(touched.withColumnRenamed("path", "src"), ["coordinate", "src"], "left_anti").join(gone, ["coordinate", "dst"], "left_anti")
        self._replace(state, good, versions, kept_nodes.unionByName(only(nodes)), kept_edges.unionByName(only(edges)))
        return judged.select("coordinate", "outcome")


def bucket_of():
    return F.pmod(F.xxhash64("coordinate"), F.lit(BUCKETS)).cast("int")
