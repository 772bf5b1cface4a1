"""Co-change mining: which files change together, beyond what their own frequencies explain.

Input is the long table of touches (commit, path). Pairs are made within each commit, whose size the giant-commit cut bounds to
MAX_COMMIT_FILES first, from files that are frequent enough to reach the support. Where the number of rows is known, tasks that make or
count pairs are as many as keep each within ROWS_A_TASK rows, however few shuffle partitions the session has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.operators.components import cut

#: Rows (commit, path) that one task makes pairs of; with 40 files in each commit these are some two million pairs.
ROWS_A_TASK = 100_000


def baskets(touch: DataFrame, max_files: int = v.MAX_COMMIT_FILES, commit: str = "commit_id") -> DataFrame:
    """Distinct (commit, path) of commits that touch at most max_files files."""
    pairs = touch.select(commit, "path").where(F.col(commit).isNotNull() & F.col("path").isNotNull()).distinct()
    size = F.count("*").over(Window.partitionBy(commit))  # one shuffle, none where touches lie by commit already
    return pairs.select(commit, "path", size.alias("files of it")).where(F.col("files of it") <= max_files).select(commit, "path")


def stored_baskets(touch: DataFrame, max_files: int = v.MAX_COMMIT_FILES) -> tuple[DataFrame, int]:
    """baskets() written once, and how many tasks its pairs need."""
    kept = cut(baskets(touch, max_files))
    return kept, -(-kept.count() // ROWS_A_TASK) or 1


def file_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("path").agg(F.count("*").alias("n"))


def pair_counts(kept: DataFrame, min_support: int = 1, commit: str = "commit_id", tasks: int | None = None) -> DataFrame:
    """(path_a < path_b, co) of distinct (commit, path) rows, as baskets() gives them. A pair's support is at most its files', so rarer
    files go first; a commit's paths, at most as many as baskets() allows, are sorted into one array and paired within it. tasks is their number where pairs are made and counted; else Spark chooses."""
    if min_support > 1:
        often = file_counts(kept).where(F.col("n") >= min_support).select("path")
        kept = kept.join(often, "path", "left_semi")
    if tasks:
        kept = kept.repartition(tasks, commit)
    sets = kept.groupBy(commit).agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)
    left = sets.select(F.posexplode("paths").alias("at", "path_a"), "paths")
    pairs = left.select("path_a", F.explode(F.slice("paths", F.col("at") + 2, F.size("paths"))).alias("path_b"))
    if tasks:
        pairs = pairs.repartition(tasks, "path_a", "path_b")  # few pairs repeat within a task, so counting them before the shuffle only takes memory
    out = pairs.groupBy("path_a", "path_b").agg(F.count("*").alias("co"))
    return out.where(F.col("co") >= min_support) if min_support > 1 else out


def numbered_files(kept: DataFrame) -> tuple[DataFrame, int]:
    """(path, n, id) of each file, written once, and a bound that all ids are below. Ids are whole numbers from 0, nearly without gaps as files
    are spread evenly over the tasks that write them."""
    table = cut(file_counts(kept).withColumn("id", F.monotonically_increasing_id()))
    task, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    most = table.agg(F.max(task).alias("task"), F.max(row).alias("row")).head()
    tasks = (most["task"] or 0) + 1
    return table.withColumn("id", row * tasks + task), ((most["row"] or 0) + 1) * tasks


def id_pair_counts(rows: DataFrame, below: int, tasks: int) -> DataFrame:
    """(a, b, co) of rows (commit_id, id) with ids under below, one id a commit at most once: pairs travel as one number while two ids fit in it."""
    sets = rows.repartition(tasks, "commit_id").groupBy("commit_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    left = sets.select(F.posexplode("ids").alias("at", "a"), "ids")
    pairs = left.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    if below > 1 << 31:
        return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("co"))
    one = pairs.select(F.shiftleft("a", 31).bitwiseOR(F.col("b")).alias("ab")).repartition(tasks, "ab").groupBy("ab").agg(F.count("*").alias("co"))
    return one.select(F.shiftright("ab", 31).alias("a"), F.col("ab").bitwiseAND(F.lit((1 << 31) - 1)).alias("b"), "co")


def cochange_pairs(touch: DataFrame, min_support: int = v.COCHANGE_SUPPORT, min_lift: float = v.COCHANGE_LIFT, min_strength: float = v.COCHANGE_STRENGTH, max_files: int = v.MAX_COMMIT_FILES) -> DataFrame:
    """(path_a, path_b, co, n_a, n_b, n_total, strength, lift) of the pairs over all floors, which hold for unrounded values.

    Baskets are written as one row a commit. Files that are frequent enough are numbered, and pairs are made and counted by numbers; paths
    come back to those over the support only.
    """
    sets = cut(baskets(touch, max_files).groupBy("commit_id").agg(F.collect_list("path").alias("paths")))
    size = sets.agg(F.count("*").alias("commits"), F.sum(F.size("paths")).alias("rows")).head()
    tasks = -(-(size["rows"] or 0) // ROWS_A_TASK) or 1
    kept = sets.select("commit_id", F.explode("paths").alias("path"))
    files, below = numbered_files(kept)
    often = files.where(F.col("n") >= min_support)
    counted = id_pair_counts(kept.join(often.select("path", "id"), "path").select("commit_id", "id"), below, tasks).where(F.col("co") >= min_support)
    side = lambda s: often.select(F.col("id").alias(s), F.col("path").alias(f"path_{s}"), F.col("n").alias(f"n_{s}"))
    out = counted.join(side("a"), "a").join(side("b"), "b")
    flip = F.col("path_a") > F.col("path_b")
    swapped = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x)
    out = out.select(swapped("path_a", "path_b"), swapped("path_b", "path_a"), "co", swapped("n_a", "n_b"), swapped("n_b", "n_a"), F.lit(size["commits"]).cast("long").alias("n_total"))
    out = out.withColumn("strength", F.greatest(F.col("co") / F.col("n_a"), F.col("co") / F.col("n_b")))
    out = out.withColumn("lift", (F.col("co") * F.col("n_total")) / (F.col("n_a") * F.col("n_b")))
    return out.where((F.col("lift") >= min_lift) & (F.col("strength") >= min_strength))


def strongest(pairs: DataFrame, limit: int = 5000) -> DataFrame:
    """The whole-store read: the strongest pairs first, at most limit (a top-k, not a filter)."""
    return pairs.orderBy(F.round("lift", 2).desc(), F.round("strength", 3).desc(), F.desc("co"), "path_a", "path_b").limit(limit)


def both_sides(pairs: DataFrame) -> DataFrame:
    """(edited, partner, co, lift, prob): prob is the share of edited's commits that touch partner."""
    forward = pairs.select(F.col("path_a").alias("edited"), F.col("path_b").alias("partner"), "co", "lift", (F.col("co") / F.col("n_a")).alias("prob"))
    backward = pairs.select(F.col("path_b").alias("edited"), F.col("path_a").alias("partner"), "co", "lift", (F.col("co") / F.col("n_b")).alias("prob"))
    return forward.unionAll(backward)


def partners(pairs: DataFrame, min_support: int = 5, min_lift: float = 2.0, min_prob: float = 0.4, top: int = 3) -> DataFrame:
    """Each file's top partners over the read floors, ranked."""
    order = Window.partitionBy("edited").orderBy(F.desc_nulls_last("lift"), F.desc_nulls_last("prob"), F.desc_nulls_last("co"), "partner")
    rows = both_sides(pairs).where((F.col("co") >= min_support) & (F.col("lift") >= min_lift) & (F.col("prob") >= min_prob))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(10, top)))


def merge_counts(*states: DataFrame, tasks: int | None = None) -> DataFrame:
    """State tables of the same keys added up: the exact increment of file or pair counts."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    value = "co" if "co" in out.columns else "n"
    keys = [c for c in out.columns if c != value]
    if tasks:
        out = out.repartition(tasks, *keys)
    return out.groupBy(keys).agg(F.sum(value).alias(value))


def unseen(touch: DataFrame, seen: DataFrame, commit: str = "commit_id") -> DataFrame:
    """Touches of commits that the ledger has not."""
    return touch.join(seen.select(commit).distinct(), commit, "left_anti")


def structural_pairs(edges: DataFrame) -> DataFrame:
    """Undirected (path_a < path_b) of (src, dst) edges."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("path_a"), F.greatest("src", "dst").alias("path_b")).distinct()


def graph_blind(pairs: DataFrame, structure: DataFrame) -> DataFrame:
    """Co-change pairs that no structural edge explains."""
    return pairs.join(structure, ["path_a", "path_b"], "left_anti")


def pair_stats(pairs: DataFrame, counted: DataFrame, files: DataFrame, total: DataFrame) -> DataFrame:
    """One row for each value of label in pairs (path_a, path_b, label): how many ever change together, and the median lift.

    The median is the lower middle one, and pairs that never change together have a lift of 0.
    """
    na = files.select(F.col("path").alias("path_a"), F.col("n").alias("n_a"))
    nb = files.select(F.col("path").alias("path_b"), F.col("n").alias("n_b"))
    rows = pairs.join(counted, ["path_a", "path_b"], "left").join(na, "path_a").join(nb, "path_b").crossJoin(F.broadcast(total))  # one row
    lift = F.coalesce(F.col("co") * F.col("n_total") / (F.col("n_a") * F.col("n_b")), F.lit(0.0))
    # equal lifts are counted first, so that the order runs over distinct values and not over all pairs
    values = rows.groupBy("label", lift.alias("lift")).agg(F.count("*").alias("k"), F.count("co").alias("ever"))
    up_to = F.sum("k").over(Window.partitionBy("label").orderBy("lift"))
    ranked = values.withColumns({"upto": up_to, "n": F.sum("k").over(Window.partitionBy("label"))})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("lift")))
    return ranked.groupBy("label").agg(F.first("n").alias("n"), F.sum("ever").alias("ever"), middle.alias("median_lift"))


def canonical_pairs(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Stored pairs (repo, path_a, path_b, co, n_a, n_b, n_total, strength, lift) from rows in any order and orientation, some repeated.

    The smaller path comes first, with its own count. Of rows of one pair each count is the largest that any of them says, so a batch that comes
    again or late changes nothing. Counts are at least 0, n_a and n_b at least co and n_total at least both; strength and lift follow from
    them. Rows of one path with itself or without one are left out.
    """
    flip = F.col("path_a") > F.col("path_b")
    one = rows.where("path_a <> path_b").select(
        "repo", F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"), "co",
        F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "n_total",
    )
    most = lambda c, *least: F.greatest(F.coalesce(F.max(c), F.lit(0)), *[F.coalesce(F.max(x), F.lit(0)) for x in least], F.lit(0)).cast("long").alias(c)
    if tasks:
        one = one.repartition(tasks, "repo", "path_a", "path_b")
    out = one.groupBy("repo", "path_a", "path_b").agg(most("co"), most("n_a", "co"), most("n_b", "co"), most("n_total", "co", "n_a", "n_b"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    strength = F.greatest(ratio(F.col("co"), F.col("n_a")), ratio(F.col("co"), F.col("n_b")))
    return out.withColumns({"strength": strength, "lift": ratio(F.col("co") * F.col("n_total"), F.col("n_a") * F.col("n_b"))})


def seed_counters(pairs: DataFrame) -> DataFrame:
    """(repo, path, n): each file's count as its stored pairs tell it, the largest that any of them has."""
    side = lambda p, n: pairs.select("repo", F.col(p).alias("path"), F.col(n).alias("n"))
    return side("path_a", "n_a").unionByName(side("path_b", "n_b")).groupBy("repo", "path").agg(F.max("n").alias("n"))
