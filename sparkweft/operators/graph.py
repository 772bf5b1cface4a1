"""Graph assembly and measures: deduplication, statuses, hubs, hotspots, blast radius, diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v


def usable(edges: DataFrame) -> DataFrame:
    """Edges whose reference is resolved."""
    return edges.where("reference_status is null")


def status_rank(status: Column) -> Column:
    return F.when(status == "failed", 3).when(status == "incomplete", 2).when(status == "ambiguous", 1).otherwise(0)


def dedupe_nodes(nodes: DataFrame, keys: tuple[str, ...] = ("id", "kind", "path")) -> DataFrame:
    """One node per key: the worst status, a specific language before "unknown" and none, the greatest content hash."""
    worst = F.max(status_rank(F.col("analysis_status")))
    names = F.array(F.lit(None).cast("string"), F.lit("ambiguous"), F.lit("incomplete"), F.lit("failed"))
    return nodes.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("language") != "unknown", F.col("language"))), F.max("language")).alias("language"), F.max("content_hash").alias("content_hash"), F.get(names, worst).alias("analysis_status"))


def dedupe_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst", "kind")) -> DataFrame:
    """One edge per key; a resolved one beats an uncertain one."""
    status = F.when(F.count_if(F.col("reference_status").isNull()) > 0, None).otherwise(F.min("reference_status"))
    return edges.groupBy(*keys).agg(status.alias("reference_status"))


def kind_counts(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows of each kind of the vocabulary, zero where there are none."""
    spark = rows.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return F.broadcast(names).join(rows.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def language_coverage(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def named_definers(symbols: DataFrame) -> DataFrame:
    """(name, path, n): definers of names that are no dunder and no stop word, n files defining each."""
    named = symbols.where(F.col("kind").isin("def", "class") & F.col("name").isNotNull() & ~F.col("name").startswith("__") & ~F.lower("name").isin(v.STOP_NAMES)).select("name", "path").distinct()
    counts = named.groupBy("name").agg(F.count("*").alias("n"))
    return named.join(counts.where(F.col("n") <= v.MAX_DEFINERS), "name")


def fan_in(imports: DataFrame) -> DataFrame:
    return usable(imports).groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("importers"))


def hub_files(imports: DataFrame, degree: int = v.HUB_DEGREE) -> DataFrame:
    """Files that more than degree others import."""
    return fan_in(imports).where(F.col("importers") > degree)


def hub_resources(resources: DataFrame, degree: int = v.HUB_DEGREE) -> DataFrame:
    return usable(resources).groupBy("dst").agg(F.countDistinct("src").alias("touchers")).where(F.col("touchers") > degree)


def blast_radius(symbols: DataFrame, calls: DataFrame, max_definers: int = v.MAX_DEFINERS) -> DataFrame:
    """(path, caller, n): files that call symbols of path, by how many; names that more files define are left out."""
    names = symbols.select("name", "path").distinct()
    few = names.groupBy("name").agg(F.countDistinct("path").alias("d")).where(F.col("d") <= max_definers).select("name")
    defined = names.join(few, "name", "left_semi")
    return calls.join(defined, calls.dst == defined.name).where("src <> path").groupBy("path", F.col("src").alias("caller")).agg(F.countDistinct("name").alias("n"))


def ambiguous_definers(edges: DataFrame, definer_kind: str = "alters") -> DataFrame:
    """Contracts that several files define: all their edges become ambiguous, that is inert but visible."""
    many = edges.where(F.col("kind") == definer_kind).groupBy("dst").agg(F.countDistinct("src").alias("definers")).where("definers > 1").select("dst", "definers")
    joined = edges.join(many, "dst", "left")
    return joined.withColumn("reference_status", F.when(F.col("definers").isNotNull(), "ambiguous").otherwise(F.col("reference_status"))).drop("definers")


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that came and went, with multiplicity."""
    cols = before.columns
    return after.select(cols).exceptAll(before.select(cols)).withColumn("change", F.lit("added")).unionAll(before.select(cols).exceptAll(after.select(cols)).withColumn("change", F.lit("removed")))


def graph_hash(rows: DataFrame) -> DataFrame:
    """An order-free hash of all rows in one row: sums of row hashes, so nothing is gathered to be sorted."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), *(part(i).alias(f"h{i}") for i in range(4)))


def hotspots(files: DataFrame, imports: DataFrame, symbols: DataFrame, landed: DataFrame, fan: int = 5, size: int = 25, churn: int = 3) -> DataFrame:
    """Files with many landings that are a foundation (many importers) or a god file (many symbols)."""
    sizes = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    churned = landed.groupBy("path").agg(F.count("*").alias("landings")).where(F.col("landings") >= churn)
    rows = churned.join(files.where("not generated").select("path"), "path", "left_semi").join(fan_in(imports), "path", "left").join(sizes, "path", "left")
    rows = rows.select("path", F.coalesce("importers", F.lit(0)).alias("importers"), F.coalesce("symbols", F.lit(0)).alias("symbols"), "landings")
    deep, big = F.col("importers") >= fan, F.col("symbols") >= size
    return rows.where(deep | big).withColumn("basis", F.when(deep & big, "both").when(deep, "foundation").otherwise("god_file"))


def split_candidates(files: DataFrame, imports: DataFrame, symbols: DataFrame, landed: DataFrame, held: DataFrame, fan: int = 5, size: int = 25, churn: int = 3, collisions: int = 3) -> DataFrame:
    """Files to split: often collided on, or structural hotspots, with their weight."""
    hits = held.groupBy("path").agg(F.count("*").alias("collisions"))
    sizes = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    churned = landed.groupBy("path").agg(F.count("*").alias("landings"))
    rows = files.where("not generated").select("path").join(hits, "path", "left").join(fan_in(imports), "path", "left").join(sizes, "path", "left").join(churned, "path", "left").na.fill(0)
    often = F.col("collisions") >= collisions
    structural = (F.col("landings") >= churn) & ((F.col("importers") >= fan) | (F.col("symbols") >= size))
    god = (F.col("landings") >= churn) & (F.col("symbols") >= size) & (F.col("importers") < fan)
    basis = F.when(often & structural, "both").when(often, "collisions").when(god, "god_file").otherwise("structural")
    return rows.where(often | structural).select("path", "collisions", "importers", "symbols", "landings", basis.alias("basis"), (F.greatest("importers", "symbols") * F.col("landings")).alias("weight"))


def central_files(imports: DataFrame, top: int = 8) -> DataFrame:
    return fan_in(imports).orderBy(F.desc("importers"), "path").limit(top)


def patch(stored: DataFrame, fresh: DataFrame, touched: DataFrame, owner: str = "path") -> DataFrame:
    """Incremental maintenance: rows owned by touched paths go, the fresh ones come."""
    return stored.join(touched.select(F.col("path").alias(owner)).distinct(), owner, "left_anti").unionByName(fresh)


def latest_version(versions: DataFrame, keys: list[str], order: str = "captured_at") -> DataFrame:
    """The newest row of each coordinate; older ones that arrive later lose."""
    others = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("v")).select(*keys, "v.*")


def propagate_status(files: DataFrame, edges: DataFrame) -> DataFrame:
    """A document with an ambiguous edge is at least ambiguous, with an unresolved one incomplete."""
    worst = edges.where("reference_status is not null").groupBy(F.col("src").alias("path")).agg(F.max(F.when(F.col("reference_status") == "unresolved", 2).otherwise(1)).alias("r"))
    rank = F.greatest(status_rank(F.col("analysis_status")), F.coalesce("r", F.lit(0)))
    names = F.array(F.lit(None).cast("string"), F.lit("ambiguous"), F.lit("incomplete"), F.lit("failed"))
    return files.join(worst, "path", "left").withColumn("analysis_status", F.get(names, rank)).drop("r")


def queue_positions(claims: DataFrame) -> DataFrame:
    """Waiting claims of a path in the order they came."""
    order = Window.partitionBy("path").orderBy("claimed_at", "claim_id")
    return claims.where("state = 'waiting'").withColumn("position", F.row_number().over(order)).select("claim_id", "path", "change_id", "position")
