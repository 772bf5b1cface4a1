"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import forget, join_counted, shared_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it can reach.

    Each round rewires edges towards smaller nodes and never holds a node's neighbours together: a minimum per node
    (partially aggregated) is joined back, and edges of a hub meet their minimum where they lie (join_counted). Each round
    is written to the shared folder, which cuts the lineage, and the round before is deleted. Self-edges and edges with a
    null end are ignored; an empty table gives an empty one. Raises if the rounds don't settle.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = shared_table(pairs.select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest node around u
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = shared_table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "around")
        # a node with a smaller neighbour has no other, in every part: each points at a root, which points nowhere
        state = around.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ends"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("open")).first()
        if not state["open"]:
            forget(around)
            break
        least = around.select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.where("v > u"), least, "u", state["ends"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = shared_table(large.distinct(), "large")
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", state["ends"] // 2).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = shared_table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (now, around, large):
            forget(done)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots).distinct()
