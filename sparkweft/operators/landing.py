"""Landing order: findings become directed edges, mutual ones ask for revision, the rest is sorted per component.

Edges, mutual pairs and components are relational; the topological order runs per component, whose size is that of a group of
changes in flight together.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.operators.components import connected_components, cut

#: Precedence of plan classes, the gravest first.
PLAN_CLASSES = ("unknown", "mutual", "cycle", "rebase", "ordered_with_revision", "ordered")
STEPS = {"unknown": "hold_pending_analysis", "mutual": "coordinate_revision", "cycle": "coordinate_cycle"}
CALL_MISMATCH = "consumer_call_mismatch"


def landing_edges(findings: DataFrame) -> DataFrame:
    """(producer, consumer, hard, rules): one edge per direction; a breaking finding is hard and beats soft ones."""
    good = findings.where("producer_pr is not null and consumer_pr is not null and producer_pr <> consumer_pr and compat_result in ('breaking', 'risky')")
    return good.groupBy(F.col("producer_pr").alias("producer"), F.col("consumer_pr").alias("consumer")).agg(
        F.bool_or(F.col("compat_result") == "breaking").alias("hard"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules")
    )


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """(a, b): hard edges both ways; neither can land first as it is."""
    hard = edges.where("hard").select("producer", "consumer")
    back = hard.select(F.col("consumer").alias("producer"), F.col("producer").alias("consumer"))
    return hard.join(back, ["producer", "consumer"], "left_semi").where("producer < consumer").select(F.col("producer").alias("a"), F.col("consumer").alias("b"))


def change_key(change: str) -> tuple[int, str]:
    m = re.search(r"(\d+)$", change)
    return (int(m[1]) if m else -1, change)


def kahn(nodes: list[str], edges: list[tuple[str, str]]) -> list[str] | None:
    """Topological order, the smallest ready change first; None where there is a cycle."""
    after: dict[str, list[str]] = {n: [] for n in nodes}
    need = dict.fromkeys(nodes, 0)
    for a, b in edges:
        after[a].append(b)
        need[b] += 1
    ready = [change_key(n) for n in nodes if not need[n]]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)[1]
        out.append(n)
        for m in after[n]:
            need[m] -= 1
            if not need[m]:
                heapq.heappush(ready, change_key(m))
    return out if len(out) == len(nodes) else None


def plan_edges(findings: DataFrame) -> DataFrame:
    """(producer, consumer, hard, unknown, rebase, revise, live): one row per direction over all usable findings.

    A finding is usable where both changes are known and differ and it is breaking, risky, unknown or asks for a rebase. unknown
    are those of unknown result and call mismatches without a reason; revise are breaking call mismatches with one; live
    edges are those with a breaking or risky finding that is neither, and only they order.
    """
    rows = typed(findings).where("usable")
    return rows.groupBy(F.col("producer_pr").alias("producer"), F.col("consumer_pr").alias("consumer")).agg(
        F.bool_or("live_hard").alias("hard"), F.bool_or("unknown").alias("unknown"), F.bool_or("rebase").alias("rebase"), F.bool_or("revise").alias("revise"), F.bool_or("live").alias("live")
    )


def typed(findings: DataFrame) -> DataFrame:
    """findings with what the plan reads off each: usable, unknown, rebase, revise, live, live_hard. evidence_class and reason_detail may be missing."""
    optional = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string")
    result = F.coalesce("compat_result", F.lit(""))
    evidence = F.coalesce(optional("evidence_class"), F.when(F.col("rule_id") == CALL_MISMATCH, CALL_MISMATCH), F.lit(""))
    detail = F.coalesce(optional("reason_detail"), F.lit(""))
    rebase = evidence.isin(v.REBASE_CLASSES)
    unknown = (result == "unknown") | ((evidence == CALL_MISMATCH) & (detail == ""))
    known = F.coalesce((F.col("producer_pr") != "") & (F.col("consumer_pr") != "") & (F.col("producer_pr") != F.col("consumer_pr")), F.lit(False))
    live = result.isin("breaking", "risky") & ~rebase & ~unknown
    return findings.withColumns(
        {
            "usable": known & (result.isin("breaking", "risky", "unknown") | rebase), "unknown": unknown, "rebase": rebase, "live": live,
            "revise": (evidence == CALL_MISMATCH) & (result == "breaking") & (detail != ""), "live_hard": live & (result == "breaking"),
        }
    )


def _plan(component: str, edges: list[dict]) -> list[tuple]:
    """The steps of one component, given all its edges."""
    nodes = sorted({e[side] for e in edges for side in ("producer", "consumer")}, key=change_key)
    order = kahn(nodes, [(e["producer"], e["consumer"]) for e in edges if e["live"] and not e["mutual"]])
    has = lambda c: any(e[c] for e in edges)
    facts = {"unknown": has("unknown"), "mutual": has("mutual"), "cycle": order is None, "rebase": has("rebase"), "ordered_with_revision": has("revise"), "ordered": True}
    kind = next(k for k in PLAN_CLASSES if facts[k])
    successors = {e["consumer"] for e in edges if e["revise" if kind == "ordered_with_revision" else "rebase"]}
    turn = "update_after_predecessor" if kind == "ordered_with_revision" else "rebase"
    return [(component, kind, i + 1 if kind.startswith("ordered") else None, n, STEPS.get(kind, turn if n in successors else "land")) for i, n in enumerate(order if kind.startswith("ordered") else nodes)]


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["component", "plan", "position", "change_id", "step"], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        steps = [s for c, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in _plan(c, edges)]
        columns = zip(*steps) if steps else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)  # noqa: B905


def landing_plan(findings: DataFrame) -> DataFrame:
    """(component, plan, position, change_id, step) for each component of changes that findings link.

    The gravest class that holds is the component's: unknown, mutual, cycle, rebase, ordered_with_revision, ordered. A position is
    given in the ordered classes only; step is what the change has to do. Edges are written once, and a component's are one row, so that
    Python takes many small components at a time.
    """
    edges = cut(plan_edges(findings))
    hard = edges.select("producer", "consumer", "hard")
    mutual = mutual_pairs(hard)
    both = mutual.select(F.col("a").alias("producer"), F.col("b").alias("consumer")).unionAll(mutual.select(F.col("b").alias("producer"), F.col("a").alias("consumer"))).withColumn("mutual", F.lit(True))
    marked = edges.join(both, ["producer", "consumer"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))
    nodes = edges.select(F.col("producer").alias("node")).union(edges.select("consumer")).distinct()
    parts = connected_components(nodes, edges.select(F.col("producer").alias("a"), F.col("consumer").alias("b")))
    edge = F.struct("producer", "consumer", "unknown", "rebase", "revise", "live", "mutual")
    rows = marked.join(parts, F.col("producer") == F.col("node")).groupBy("component").agg(F.collect_list(edge).alias("edges"))
    return rows.mapInArrow(_plans, "component string, plan string, position int, change_id string, step string")


def plan_summary(findings: DataFrame, plan: DataFrame, lane: Callable[[Column], Column] | None = None) -> DataFrame:
    """(lane, classification, clusters, skipped): the gravest class of each lane's plans; unknown where any of its findings could not be used.

    lane gives the lane from a change or component; without it there is one, 0.
    """
    of = lane or (lambda _: F.lit(0))
    rank = F.array_position(F.array(*[F.lit(x) for x in PLAN_CLASSES]), F.col("plan"))
    worst = plan.groupBy(of(F.col("component")).alias("lane")).agg(F.countDistinct("component").alias("clusters"), F.min(rank).cast("int").alias("worst"))
    skipped = typed(findings).groupBy(of(F.col("producer_pr")).alias("lane")).agg(F.count_if(~F.col("usable")).alias("skipped"))
    names = F.array(*[F.lit(x) for x in PLAN_CLASSES])
    rows = skipped.join(worst, "lane", "left").na.fill(0, ["clusters"])
    said = F.when(F.col("skipped") > 0, "unknown").otherwise(F.coalesce(F.get(names, F.col("worst") - 1), F.lit("ordered")))
    return rows.select("lane", said.alias("classification"), "clusters", "skipped")
