"""Contention between in-flight changes: waits, range conflicts, the verdict ladder, clusters and landing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v


def low_value(path: Column) -> Column:
    """Lock files, change logs and generated output, on which waiting is not worth it."""
    return F.lower(path).rlike(r"(^|/)(package-lock\.json|yarn\.lock|poetry\.lock|cargo\.lock|go\.sum|changelog(\.[a-z]+)?)$|\.(lock|snap|min\.js)$")


def contested_files(adjacency: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, degree): active files that an active file of another agent is coupled to, by how many changes."""
    other = claims.where("state = 'active'").select(F.col("path").alias("nbr"), F.col("agent").alias("other_agent"), F.col("change_id").alias("other_change")).distinct()
    return adjacency.join(other, "nbr").where("agent <> other_agent").groupBy(F.col("f").alias("path")).agg(F.countDistinct("other_change").alias("degree"))


def is_advisory(change: Column) -> Column:
    """A branch's reservation without an open change behind it, unless the branch is a release lane."""
    return change.startswith("BR-") & ~F.lower(F.substring(change, 4, 1_000_000)).rlike(v.RELEASE_BRANCH)


def waits(claims: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """(path, waiter, holder, waiter_claim, holder_claim, cross_draft, low_value, append_soft, advisory): waiting claims on paths that another change holds.

    overlap (path, waiter, holder, relation), as symbol_overlap gives it: waits on ranges proven disjoint are left out, those of
    pure appends are marked append_soft, and a proven common symbol is never of low value. A change is a draft where any of its
    claims is. Behind an advisory holder the changes of a path also wait for the earliest of them.
    """
    draft = claims.groupBy("change_id").agg(F.coalesce(F.bool_or("is_draft"), F.lit(False)).alias("draft"))
    held = claims.where("state = 'active'").select("path", F.col("change_id").alias("holder"), F.col("claim_id").alias("holder_claim"))
    waiting = claims.where("state = 'waiting'").select("path", F.col("change_id").alias("waiter"), F.col("claim_id").alias("waiter_claim"))
    base = waiting.join(held, "path").where("waiter <> holder").withColumn("advisory", is_advisory(F.col("holder")))
    first = claims.where("change_id like 'PR-%' and state in ('active', 'waiting')").groupBy("path").agg(F.min_by(F.struct(F.col("change_id").alias("holder"), F.col("claim_id").alias("holder_claim")), F.struct("claimed_at", "change_id")).alias("first"))
    lanes = held.where(is_advisory(F.col("holder"))).select("path").distinct()
    behind = waiting.where("waiter like 'PR-%'").join(lanes, "path", "left_semi").join(first, "path").select("path", "waiter", "waiter_claim", "first.*", F.lit(False).alias("advisory")).where("waiter <> holder")
    rows = base.unionByName(behind)
    rows = rows.join(draft.withColumnsRenamed({"change_id": "waiter", "draft": "waiter_draft"}), "waiter").join(draft.withColumnsRenamed({"change_id": "holder", "draft": "holder_draft"}), "holder")
    if overlap is None:
        rows = rows.withColumns({"same": F.lit(False), "append_soft": F.lit(False)})
    else:
        a, b = overlap.select("path", "waiter", "holder", "relation"), overlap.select("path", F.col("holder").alias("waiter"), F.col("waiter").alias("holder"), "relation")
        found = lambda r: F.bool_or(F.col("relation") == r)
        known = a.unionAll(b).groupBy("path", "waiter", "holder").agg(found("disjoint").alias("disjoint"), found("same").alias("same"), found("append").alias("append_soft"))
        rows = rows.join(known, ["path", "waiter", "holder"], "left").na.fill(False, ["disjoint", "same", "append_soft"]).where("not disjoint")
    return rows.select(
        "path", "waiter", "holder", "waiter_claim", "holder_claim", (F.col("waiter_draft") != F.col("holder_draft")).alias("cross_draft"),
        (low_value(F.col("path")) & ~F.col("same")).alias("low_value"), "append_soft", "advisory",
    )


def conflict_points(claims: DataFrame, tolerance: int = 2) -> DataFrame:
    """(path, waiter, holder, line): half-open ranges that overlap or lie at most tolerance lines apart; the first line hit."""
    cols = lambda name: ["path", F.col("change_id").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi")]
    w, h = claims.where("state = 'waiting'").select(*cols("waiter")), claims.where("state = 'active'").select(*cols("holder"))
    hit = w.join(h, "path").where("waiter <> holder").withColumn("line", F.greatest("waiter_lo", "holder_lo"))
    return hit.where(F.col("line") - F.least("waiter_hi", "holder_hi") <= tolerance).groupBy("path", "waiter", "holder").agg(F.min("line").alias("line"))


def symbol_overlap(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, waiter, holder, relation) by the tightest symbol around each side's range: same, disjoint, append or unknown.

    Disjoint and append are only said where both sides started from the graph's own content.
    """
    spans = symbols.select("path", "name", "start_line", "end_line", "content_hash")
    tight = Window.partitionBy("claim_id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name")
    inside = claims.join(spans, "path").where("lo >= start_line and hi <= end_line + 1").withColumn("rn", F.row_number().over(tight)).where("rn = 1").select("claim_id", "name")
    hashes = symbols.groupBy("path").agg(F.min("content_hash").alias("graph_hash"), F.max("end_line").alias("last_line"))
    side = claims.join(inside, "claim_id", "left").join(hashes, "path", "left")
    cols = lambda n: ["path", F.col("change_id").alias(n), F.col("name").alias(f"{n}_name"), (F.col("base_hash") == F.col("graph_hash")).alias(f"{n}_fresh"), (F.col("lo") > F.col("last_line")).alias(f"{n}_append")]
    rows = side.where("state = 'waiting'").select(*cols("waiter")).join(side.where("state = 'active'").select(*cols("holder")), "path").where("waiter <> holder")
    fresh = F.col("waiter_fresh") & F.col("holder_fresh")
    relation = (
        F.when(F.col("waiter_name") == F.col("holder_name"), "same")
        .when(fresh & F.col("waiter_name").isNotNull() & F.col("holder_name").isNotNull(), "disjoint")
        .when(fresh & F.col("waiter_append") & F.col("holder_append"), "append")
        .otherwise("unknown")
    )
    return rows.select("path", "waiter", "holder", relation.alias("relation"))


def corroborated(dampened: DataFrame, pairs: DataFrame, min_co: int = 3, min_lift: float = 2.0) -> DataFrame:
    """Dampened couplings with whether history bears them out."""
    known = pairs.where((F.col("co") >= min_co) & (F.col("lift") >= min_lift)).select("path_a", "path_b", F.lit(True).alias("known"))
    rows = dampened.withColumns({"path_a": F.least("f", "nbr"), "path_b": F.greatest("f", "nbr")})
    return rows.join(known, ["path_a", "path_b"], "left").select(*dampened.columns, F.coalesce("known", F.lit(False)).alias("corroborated"))


def uncertain_paths(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, reason): files whose analysis is not whole, sources of uncertain references, and known files that an ambiguous one may mean."""
    status = F.col("analysis_status")
    said = F.when(status == "failed", "analysis_failed").when(status == "ambiguous", "analysis_ambiguous").otherwise("analysis_incomplete")
    own = files.where(status.isin("failed", "ambiguous", "incomplete")).select("path", said.alias("reason"))
    bad = edges.where(F.col("reference_status").isin("ambiguous", "unresolved"))
    out = bad.select(F.col("src").alias("path"), F.concat(F.lit("reference_"), "reference_status").alias("reason"))
    meant = bad.where("reference_status = 'ambiguous'").select(F.col("dst").alias("path")).distinct().join(files.select("path"), "path", "left_semi").withColumn("reason", F.lit("reference_ambiguous"))
    return own.unionAll(out).unionAll(meant).distinct()


#: Facts in the order in which the first that holds decides, with what it says.
LADDER = [
    ("hard", "serialize"), ("soft", "serialize_soft"), ("draft", "warn"), ("contested", "warn"), ("absent", "unknown"), ("borne_out", "warn"),
    ("any_loss", "unknown"), ("uncertain", "unknown"), ("dampened", "unknown"),
]


def change_facts(claims: DataFrame, files: DataFrame, wait_rows: DataFrame, adjacency: DataFrame, dampened: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(change_id, and one boolean for each fact of LADDER). Each fact is aggregated by change and joined once.

    any_loss holds for all changes of a repository (a column repo of claims, if there is one; a change has one) of which one touches a
    file whose analysis lost facts.
    """
    repo = F.first("repo") if "repo" in claims.columns else F.lit("")
    changes = claims.groupBy("change_id").agg(repo.alias("repo"))
    own = claims.select("change_id", "path").distinct()
    mild = F.col("low_value") | F.col("append_soft") | F.col("advisory")
    w = wait_rows.groupBy(F.col("waiter").alias("change_id")).agg(F.bool_or(~F.col("cross_draft") & ~mild).alias("hard"), F.bool_or(~F.col("cross_draft")).alias("soft"), F.bool_or("cross_draft").alias("draft"))
    active = claims.where("state = 'active'").select(F.col("path").alias("nbr"), F.col("change_id").alias("other")).distinct()
    contested = adjacency.join(active, "nbr").where("change_id <> other").select("change_id").distinct().withColumn("contested", F.lit(True))
    doubt = uncertain_paths(files, edges).groupBy("path").agg(F.lit(True).alias("doubt"), F.bool_or(F.col("reason").isin("analysis_failed", "analysis_incomplete")).alias("loss"))
    known = own.join(files.select("path", F.lit(True).alias("here")).distinct(), "path", "left").join(doubt, "path", "left")
    facts = known.groupBy("change_id").agg(F.bool_or(F.col("here").isNull()).alias("absent"), F.bool_or(F.col("doubt").isNotNull()).alias("uncertain"), F.bool_or(F.coalesce("loss", F.lit(False))).alias("loss"))
    damp = corroborated(dampened, pairs).groupBy("change_id").agg(F.bool_or("corroborated").alias("borne_out"), F.lit(True).alias("dampened"))
    lossy = changes.join(facts.where("loss").select("change_id"), "change_id", "left_semi").groupBy("repo").agg(F.lit(True).alias("any_loss"))
    rows = changes.join(w, "change_id", "left").join(contested, "change_id", "left").join(facts, "change_id", "left").join(damp, "change_id", "left").join(lossy, "repo", "left")
    return rows.select("change_id", *(F.coalesce(n, F.lit(False)).alias(n) for n, _ in LADDER))


def verdicts(facts: DataFrame) -> DataFrame:
    """(change_id, verdict, step): the first step of the ladder that holds."""
    verdict, step = F.lit("clear"), F.lit(len(LADDER) + 1)
    for i in range(len(LADDER) - 1, -1, -1):
        fact, said = LADDER[i]
        verdict, step = F.when(F.col(fact), said).otherwise(verdict), F.when(F.col(fact), i + 1).otherwise(step)
    return facts.select("change_id", verdict.alias("verdict"), step.alias("step"))


def loss_promoted(facts: DataFrame) -> DataFrame:
    """(change_id): changes that are unknown only because some change in flight touches a file whose analysis lost facts."""
    stronger = [n for n, _ in LADDER if n != "any_loss"]
    clear = F.lit(True)
    for n in stronger:
        clear = clear & ~F.col(n)
    return facts.where(F.col("any_loss") & clear).select("change_id")


def change_links(wait_rows: DataFrame, adjacency: DataFrame, claims: DataFrame) -> DataFrame:
    """(a, b): changes that wait for each other or are coupled."""
    active = claims.where("state = 'active'").select(F.col("path").alias("nbr"), F.col("change_id").alias("b")).distinct()
    semantic = adjacency.join(active, "nbr").where("change_id <> b").select(F.col("change_id").alias("a"), "b")
    return semantic.unionAll(wait_rows.select(F.col("waiter").alias("a"), F.col("holder").alias("b"))).distinct()


def impacts(adjacency: DataFrame) -> DataFrame:
    """(change_id, impact): distinct files downstream of a change or sharing a resource with it."""
    return adjacency.where("dir in ('down', 'shared')").groupBy("change_id").agg(F.countDistinct("nbr").alias("impact"))


def suggested_order(depth: DataFrame, impact: DataFrame, component: DataFrame) -> DataFrame:
    """(component, change_id, depth, impact, position) in each cluster: deepest first, then widest, then by id."""
    rows = depth.join(component, "node").select("component", F.col("node").alias("change_id"), "depth").join(impact, "change_id", "left").na.fill(0, ["impact"])
    order = Window.partitionBy("component").orderBy(F.desc("depth"), F.desc("impact"), "change_id")
    return rows.withColumn("position", F.row_number().over(order))


def cluster_rollup(component: DataFrame, verdict: DataFrame, claims: DataFrame) -> DataFrame:
    """(component, size, worst, hotspots): clusters of at least two changes, worst verdict, paths that two members touch."""
    rank = F.array_position(F.array(*[F.lit(x) for x in v.VERDICTS]), F.col("verdict"))
    names = F.array(*[F.lit(x) for x in v.VERDICTS])
    members = component.select(F.col("node").alias("change_id"), "component")
    sized = members.join(verdict, "change_id").groupBy("component").agg(F.count("*").alias("size"), F.get(names, (F.min(rank) - 1).cast("int")).alias("worst")).where("size >= 2")
    hot = claims.join(members, "change_id").groupBy("component", "path").agg(F.countDistinct("change_id").alias("n")).where("n >= 2").groupBy("component").agg(F.count("*").alias("hotspots"))
    return sized.join(hot, "component", "left").na.fill(0, ["hotspots"])


def effective_verdicts(verdict: DataFrame, claims: DataFrame, files: DataFrame, dampened: DataFrame, added: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """(change_id, verdict, effective) by what the paths that the graph knows say.

    unknown becomes clear where there are unknown paths, all proven new (added), some path is known, nothing is dampened and the
    change's paths are not cut short (truncated: change_id). Any other verdict becomes unknown where something dampened is not
    borne out, and clear also where the paths are cut short. dampened has (change_id, corroborated).
    """
    known = files.select("path", F.lit(True).alias("known")).distinct()
    own = claims.select("change_id", "path").distinct().join(known, "path", "left").join(added.select("path", F.lit(True).alias("new")).distinct(), "path", "left")
    paths = own.groupBy("change_id").agg(F.bool_and(F.when(F.col("known").isNull(), F.col("new").isNotNull())).alias("all_new"), F.bool_or(F.col("known").isNotNull()).alias("some_known"))
    damp = dampened.groupBy("change_id").agg(F.lit(True).alias("dampened"), F.bool_or(~F.col("corroborated")).alias("lone"))
    rows = verdict.join(paths, "change_id", "left").join(damp, "change_id", "left")
    flags = ["all_new", "some_known", "dampened", "lone"]
    if truncated is None:
        rows = rows.withColumn("truncated", F.lit(False))
    else:
        rows, flags = rows.join(truncated.select("change_id", F.lit(True).alias("truncated")).distinct(), "change_id", "left"), [*flags, "truncated"]
    rows = rows.na.fill(False, flags)
    proven = ~F.col("dampened") & ~F.col("truncated") & F.col("all_new") & F.col("some_known")
    doubted = F.col("lone") | ((F.col("verdict") == "clear") & F.col("truncated"))
    effective = F.when(F.col("verdict") == "unknown", F.when(proven, "clear").otherwise("unknown")).when(doubted, "unknown").otherwise(F.col("verdict"))
    return rows.select("change_id", "verdict", effective.alias("effective"))


def coupling_snapshot(adjacency: DataFrame) -> DataFrame:
    """(change_id, couplings, snapshot): a hash of each change's couplings in order; another hash means an acknowledgement is stale."""
    rows = adjacency.select("change_id", F.concat_ws("|", "f", "nbr", "dir").alias("c")).distinct()
    return rows.groupBy("change_id").agg(F.count("*").alias("couplings"), F.sha2(F.array_join(F.array_sort(F.collect_list("c")), "\n"), 256).alias("snapshot"))


def coordination_brief(verdict: DataFrame, wait_rows: DataFrame, impact: DataFrame) -> DataFrame:
    """(change_id, brief): the verdict with the changes waited for and the reach, as one JSON document per change."""
    holders = wait_rows.groupBy(F.col("waiter").alias("change_id")).agg(F.array_sort(F.collect_set("holder")).alias("waits_for"), F.countDistinct("path").alias("contended_paths"))
    rows = verdict.join(holders, "change_id", "left").join(impact, "change_id", "left")
    none = F.expr("cast(array() as array<string>)")
    brief = F.struct("verdict", F.coalesce("waits_for", none).alias("waits_for"), F.coalesce("contended_paths", F.lit(0)).alias("contended_paths"), F.coalesce("impact", F.lit(0)).alias("impact"))
    return rows.select("change_id", F.to_json(brief).alias("brief"))
