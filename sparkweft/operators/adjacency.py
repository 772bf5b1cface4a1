"""In-flight adjacency: which files a claimed file is coupled to, and how. Three variants that differ on purpose.

Claimed paths restrict calls, definers, imports and one side of the shared resources before they are joined; hubs and how many
files define a name are properties of the whole graph and are counted over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.functions.paths import is_test_path
from sparkweft.operators.graph import hub_files, hub_resources, named_definers, usable


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def call_links(symbols: DataFrame, calls: DataFrame, imports: DataFrame, hubs: DataFrame, callers: DataFrame | None = None, definers: DataFrame | None = None, into_hubs: bool = False) -> DataFrame:
    """(caller, definer): calls that resolve to a file that is no hub, or with into_hubs to one that is.

    Without an import that confirms it, a call counts only for a name with one definer, not for short or built-in names, and
    not from product code to a test unless into_hubs. Where callers or definers (path) are given, only theirs: both
    sides shrink before they meet. How many files define a name is counted over all symbols.
    """
    called = usable(calls).select(F.col("src").alias("caller"), F.col("dst").alias("name")).distinct()
    named = named_definers(symbols).select("name", F.col("path").alias("definer"), "n")
    hub = hubs.select(F.col("path").alias("definer"))
    named = named.join(hub, "definer", "left_semi" if into_hubs else "left_anti")
    if callers is not None:
        called = called.join(callers.select(F.col("path").alias("caller")), "caller", "left_semi")
    if definers is not None:
        named = named.join(definers.select(F.col("path").alias("definer")), "definer", "left_semi")
    found = called.join(named, "name").where("caller <> definer")
    imported = usable(imports).select(F.col("src").alias("caller"), F.col("dst").alias("definer")).distinct().withColumn("imported", F.lit(True))
    sure = (F.col("n") == 1) & (F.length("name") > 2) & ~F.lower("name").isin(v.BUILTIN_TAILS)
    if not into_hubs:
        sure = sure & ~(is_test_path(F.col("definer")) & ~is_test_path(F.col("caller")))
    return found.join(imported, ["caller", "definer"], "left").where(F.col("imported") | sure).select("caller", "definer").distinct()


def claim_adjacency(claims: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, resources: DataFrame, degree: int = v.HUB_DEGREE) -> DataFrame:
    """(f, agent, change_id, nbr, dir) for each active claim: up depends on nbr, down is depended on, shared by a resource."""
    edited = claims.where("state = 'active'").select(F.col("path").alias("f"), "agent", "change_id").distinct()
    active = edited.select(F.col("f").alias("path")).distinct()
    hubs = hub_files(imports, degree)
    up = call_links(symbols, calls, imports, hubs, callers=active)
    down = call_links(symbols, calls, imports, hubs, definers=active)
    imported = usable(imports).where("src <> dst").select("src", "dst")
    above = imported.join(active.select(F.col("path").alias("src")), "src", "left_semi")
    below = imported.join(active.select(F.col("path").alias("dst")), "dst", "left_semi")
    no_hub = lambda d: d.join(hubs.select(F.col("path").alias("dst")), "dst", "left_anti")
    touched = usable(resources).select("src", "dst").distinct().join(hub_resources(resources, degree).select("dst"), "dst", "left_anti")
    mine = touched.join(active.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("src").alias("f"), "dst")
    pairs = _union(
        [
            up.select(F.col("caller").alias("f"), F.col("definer").alias("nbr"), F.lit("up").alias("dir")),
            down.select(F.col("definer").alias("f"), F.col("caller").alias("nbr"), F.lit("down").alias("dir")),
            no_hub(above).select(F.col("src").alias("f"), F.col("dst").alias("nbr"), F.lit("up").alias("dir")),
            no_hub(below).select(F.col("dst").alias("f"), F.col("src").alias("nbr"), F.lit("down").alias("dir")),
            mine.join(touched.select(F.col("src").alias("nbr"), "dst"), "dst").where("f <> nbr").select("f", "nbr", F.lit("shared").alias("dir")),
        ]
    )
    return edited.join(pairs.distinct(), "f").select("f", "agent", "change_id", "nbr", "dir")


def dampened_pairs(claims: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, resources: DataFrame, degree: int = v.HUB_DEGREE) -> DataFrame:
    """(f, change_id, nbr, nbr_change, via): couplings through a hub, which adjacency leaves out, between two active changes: an
    import of a hub, a call into one, or a hot resource that both touch. Active files restrict each axis before its join."""
    active = claims.where("state = 'active'").select("path", "change_id").distinct()
    paths = active.select("path").distinct()
    src, dst = paths.select(F.col("path").alias("src")), paths.select(F.col("path").alias("dst"))
    hubs = hub_files(imports, degree)
    imp = usable(imports).select("src", "dst").where("src <> dst").join(src, "src", "left_semi").join(dst, "dst", "left_semi").join(hubs.select(F.col("path").alias("dst")), "dst", "left_semi")
    call = call_links(symbols, calls, imports, hubs, callers=paths, definers=paths, into_hubs=True).select(F.col("caller").alias("src"), F.col("definer").alias("dst"))
    into = imp.unionByName(call).distinct()
    both = into.select(F.col("src").alias("f"), F.col("dst").alias("nbr"), F.col("dst").alias("via")).unionAll(into.select(F.col("dst").alias("f"), F.col("src").alias("nbr"), F.col("dst").alias("via")))
    res = usable(resources).select("src", "dst").join(src, "src", "left_semi").join(hub_resources(resources, degree).select("dst"), "dst", "left_semi").distinct()
    shared = res.select(F.col("src").alias("f"), "dst").join(res.select(F.col("src").alias("nbr"), "dst"), "dst").where("f <> nbr").select("f", "nbr", F.col("dst").alias("via"))
    pairs = both.unionAll(shared).distinct()
    a, b = active.select(F.col("path").alias("f"), "change_id"), active.select(F.col("path").alias("nbr"), F.col("change_id").alias("nbr_change"))
    return pairs.join(a, "f").join(b, "nbr").where("change_id <> nbr_change").select("f", "change_id", "nbr", "nbr_change", "via").distinct()


def coupled_pairs_offline(symbols: DataFrame, calls: DataFrame, imports: DataFrame, resources: DataFrame, min_name: int = 3) -> DataFrame:
    """(path_a, path_b, label) by axis: no hub rule, no import confirmation, short names left out everywhere."""
    names = named_definers(symbols).where(~F.lower("name").isin(v.BUILTIN_TAILS) & (F.length("name") >= min_name))
    call = calls.select("src", F.col("dst").alias("name")).join(names, "name").select("src", F.col("path").alias("dst"))
    res = resources.select("src", "dst").distinct()
    shared = res.join(res.select(F.col("src").alias("other"), "dst"), "dst").where("src < other").select("src", F.col("other").alias("dst"))
    tag = lambda df, label: df.where("src <> dst").select(F.least("src", "dst").alias("path_a"), F.greatest("src", "dst").alias("path_b"), F.lit(label).alias("label"))
    return _union([tag(imports.select("src", "dst"), "import"), tag(call, "call"), tag(shared, "resource")]).distinct()


def cross_repo_contracts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(definer, consumer, contract) between two repositories' (path, contract, role) tables, either way round. Contracts that
    several files of a repository define are ambiguous and left out."""
    many = lambda d: d.where("role = 'defines'").groupBy("contract").agg(F.countDistinct("path").alias("n")).where("n > 1").select("contract")
    bad = many(a).unionAll(many(b)).distinct()
    pick = lambda d, role, name: d.where(F.col("role") == role).select(F.col("path").alias(name), "contract").distinct()
    links = pick(a, "defines", "definer").join(pick(b, "uses", "consumer"), "contract").unionByName(pick(b, "defines", "definer").join(pick(a, "uses", "consumer"), "contract"))
    return links.join(bad, "contract", "left_anti").select("definer", "consumer", "contract").distinct()


def touching_pairs(resources: DataFrame, degree: int = v.HUB_DEGREE) -> DataFrame:
    """(path_a < path_b), repeated for each resource both touch (src, dst), of resources that at most degree files touch."""
    of, order = Window.partitionBy("dst"), Window.partitionBy("dst").orderBy("src")
    rows = resources.select("src", "dst").distinct()
    few = rows.select("src", "dst", F.count("*").over(of).alias("n")).where(F.col("n").between(2, degree))
    after = few.select(F.col("src").alias("path_a"), F.collect_list("src").over(order.rowsBetween(1, degree - 1)).alias("others"))
    return after.select("path_a", F.explode("others").alias("path_b"))


def meter_components(files: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, resources: DataFrame, history: DataFrame, degree: int = v.HUB_DEGREE) -> DataFrame:
    """One row of the unit meter's components; history are pairs (path_a, path_b) that change together, each once. Pairs of all kinds meet in
    one grouping, each kind a bit."""
    known = files.select("path")
    src, dst = known.select(F.col("path").alias("src")), known.select(F.col("path").alias("dst"))
    dirs = lambda c: F.regexp_replace(c, "(^|/)[^/]*$", "")
    imported = imports.select("src", "dst").join(dst, "dst", "left_semi")
    named = named_definers(symbols).select("name", F.col("path").alias("dst")).join(dst, "dst", "left_semi")
    called = calls.select("src", F.col("dst").alias("name")).join(named, "name").select("src", "dst")
    bit = lambda df, b: df.where("src <> dst").select(F.least("src", "dst").alias("path_a"), F.greatest("src", "dst").alias("path_b"), F.lit(b).alias("kinds"))
    res = resources.join(src, "src", "left_semi")
    pairs = _union(
        [
            bit(imported.join(src, "src", "left_semi"), 1), bit(called.join(src, "src", "left_semi"), 2),
            touching_pairs(res, degree).select("path_a", "path_b", F.lit(4).alias("kinds")), history.select("path_a", "path_b", F.lit(8).alias("kinds")),
        ]
    )
    pairs = pairs.groupBy("path_a", "path_b").agg(F.bit_or("kinds").alias("kinds"))
    has = lambda b: F.col("kinds").bitwiseAND(F.lit(b)) != 0
    counts = pairs.agg(
        F.count_if(has(1) & (dirs(F.col("path_a")) != dirs(F.col("path_b")))).alias("xdir"), F.count_if(has(2)).alias("call"),
        (2 * F.count_if(has(1 | 4))).alias("ends"), F.count_if(has(8) & ~has(1 | 2)).alias("blind"),
    )
    touched = res.groupBy("src", "dst").agg(F.bool_or(F.col("kind") == "alters").alias("w"), F.bool_or(F.col("kind") == "queries").alias("r"))  # lies by src already
    keys = touched.groupBy("dst").agg(F.count("*").alias("n"), F.bool_or("w").alias("w"), F.bool_or("r").alias("r"))
    shared = keys.agg(F.count_if(F.col("n") >= 2).alias("shared"), F.count_if(F.col("w") & F.col("r")).alias("both"), F.count_if(F.col("n") > degree).alias("hot"))
    hubs = imported.groupBy("dst").agg(F.countDistinct("src").alias("n")).where(F.col("n") > degree).agg(F.count("*").alias("hubs"))
    one = files.agg(F.count("*").alias("files"), F.sum("loc").cast("long").alias("loc"))
    for other in (counts, shared, hubs):  # one row each
        one = one.crossJoin(F.broadcast(other))
    n = F.col("files")
    return one.select(
        "loc", ((F.col("shared") + F.col("both")) / n).alias("xs_intensity"), (F.col("call") / n).alias("call_density"), (F.col("xdir") / n).alias("xdir_density"),
        (F.col("ends") / n).alias("blast_mean"), (F.col("blind") / n).alias("blind_density"), (F.col("hubs") + F.col("hot")).alias("concentration"),
    )


def meter(components: DataFrame, policy: dict | None = None) -> DataFrame:
    """The components with the hub bucket, the premium that the policy gives them, whether that is capped, and the units."""
    p = v.UNIT_POLICY | (policy or {})
    bucket = F.when(F.col("concentration") == 0, 0).when(F.col("concentration") <= 3, 1).when(F.col("concentration") <= 10, 2).otherwise(3)
    raw = (
        1.0 + p["a_xs"] * F.col("xs_intensity") + p["a_call"] * F.least("call_density", F.lit(p["cap_call"])) + p["a_xdir"] * F.least("xdir_density", F.lit(p["cap_xdir"]))
        + p["a_blast"] * F.least("blast_mean", F.lit(p["cap_blast"])) + p["a_hub"] * bucket + p["a_cc"] * F.least("blind_density", F.lit(p["cap_cc"]))
    )
    out = components.withColumn("hub_bucket", bucket).withColumn("premium", F.least(raw, F.lit(p["cap_premium"]))).withColumn("premium_capped", raw > p["cap_premium"] + 1e-9)
    return out.withColumn("units", F.floor(F.col("loc") * F.col("premium"))).drop("concentration")
