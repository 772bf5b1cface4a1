"""Every registered query over the test tables, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.functions.paths import dirname, module_stem, path_stem
from sparkweft.operators import adjacency as adj
from sparkweft.operators import cochange as cc
from sparkweft.operators import compat, components, contention, contracts, evaluation, funnel, graph, landing, packages, resolve, routes, store, surfaces, validation
from sparkweft.sources import build, calls, columns, extract
from sparkweft.sources.projection import relation, table, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"
#: Importers or touchers from which a file or resource is a hub.
HUB = v.HUB_DEGREE
STOP = ", ".join(f"'{n}'" for n in v.STOP_NAMES)
TAILS = ", ".join(f"'{n}'" for n in v.BUILTIN_TAILS)


def query(oracle: str | None = None):
    """Registers a query under its name, with its oracle; relations the oracle names are put before it."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_relations(oracle)
        return f

    return add


class Relations:
    """The relations of one directory, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def query(self, sql: str, name: str) -> DataFrame:
        """SQL over one relation."""
        return self.spark.sql(sql.replace(f"FROM {name}", "FROM {rows}"), rows=relation(self.spark, self.sf_dir, name))


class Stored(Relations):
    """Relations written once on first use, for queries that read them several times; touches are read once, by the baskets, which are written themselves."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.written: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name == "touch":
            return super().__getattr__(name)
        if name not in self.written:
            self.written[name] = components.cut(super().__getattr__(name))
        return self.written[name]


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of texts to be parsed: its tables' rows are dealt to all cores before texts are made of them, as parsing takes far longer
    than so few bytes suggest and texts are wider than the rows."""
    return relation(spark, sf_dir, name, parts=2 * spark.sparkContext.defaultParallelism)


# ---- co-change -------------------------------------------------------------------------------------------------

BASKET_SQL = """kept AS (SELECT commit_id, path FROM touch WHERE commit_id IN (SELECT commit_id FROM touch GROUP BY commit_id HAVING count(*) <= 40)),
nf AS (SELECT path, count(*) AS n FROM kept GROUP BY path), total AS (SELECT count(DISTINCT commit_id) AS n FROM kept),
co AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS co FROM kept a JOIN kept b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL),
scored AS (SELECT path_a, path_b, co, x.n AS n_a, y.n AS n_b, total.n AS n_total, greatest(co / x.n, co / y.n) AS strength, (co * total.n) / (x.n * y.n) AS lift
  FROM co JOIN nf x ON x.path = path_a JOIN nf y ON y.path = path_b, total)"""


def _pairs(r: Relations, support: int = 2, lift: float = 2.0, strength: float = 0.0) -> DataFrame:
    return cc.cochange_pairs(r.touch, support, lift, strength)


@query(f"WITH {BASKET_SQL} SELECT * FROM scored WHERE co >= 2 AND lift >= 2")
def cochange_pairs(spark, sf_dir):
    return _pairs(Relations(spark, sf_dir))


@query(f"WITH {BASKET_SQL} SELECT * FROM scored WHERE co >= 5 AND lift >= 2 AND strength >= 0.3")
def cochange_default_floors(spark, sf_dir):
    return cc.cochange_pairs(Relations(spark, sf_dir).touch)


HOURS_SQL = "touches AS (SELECT DISTINCT date_trunc('{unit}', occurred_at) AS commit_id, path FROM event_log)"


@query(
    f"""WITH {HOURS_SQL.format(unit="day")}, sizes AS (SELECT commit_id, count(*) AS n FROM touches GROUP BY 1)
    SELECT count(*) AS commits, count(*) FILTER (WHERE n > 40) AS giant, count(*) FILTER (WHERE n <= 40) AS kept FROM sizes"""
)
def cochange_giant_skip(spark, sf_dir):
    touch = Relations(spark, sf_dir).event_log.select(F.date_trunc("day", "occurred_at").alias("commit_id"), "path").distinct()
    kept = cc.baskets(touch).select("commit_id").distinct().withColumn("kept", F.lit(True))
    return touch.select("commit_id").distinct().join(kept, "commit_id", "left").agg(F.count("*").alias("commits"), F.count_if(F.col("kept").isNull()).alias("giant"), F.count_if(F.col("kept")).alias("kept"))


@query(
    f"""WITH {BASKET_SQL}, sides AS (
      SELECT path_a AS edited, path_b AS partner, co, lift, co / n_a AS prob FROM scored UNION ALL SELECT path_b, path_a, co, lift, co / n_b FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY edited ORDER BY lift DESC NULLS LAST, prob DESC NULLS LAST, co DESC NULLS LAST, partner) AS rank FROM sides WHERE co >= 2 AND lift >= 2 AND prob >= 0.02)
    SELECT edited, partner, co, lift, prob, rank FROM ranked WHERE rank <= 3"""
)
def cochange_partners_topk(spark, sf_dir):
    return cc.partners(_pairs(Relations(spark, sf_dir)), min_support=2, min_prob=0.02)


@query(f"WITH {BASKET_SQL} SELECT path_a, path_b, co FROM scored WHERE co >= 2 AND lift >= 2 ORDER BY round(lift, 2) DESC, round(strength, 3) DESC, co DESC, path_a, path_b LIMIT 200")
def cochange_all_topn(spark, sf_dir):
    return cc.strongest(_pairs(Relations(spark, sf_dir)), 200).select("path_a", "path_b", "co")


@query(f"WITH {BASKET_SQL} SELECT path_a, path_b, co FROM co WHERE co >= 2")
def cochange_incremental_equals_batch(spark, sf_dir):
    """Pair counts of two halves of history, added up."""
    touch, tasks = cc.stored_baskets(Relations(spark, sf_dir).touch)
    old, new = touch.where("commit_id % 3 <> 0"), touch.where("commit_id % 3 <= 1")
    fresh = cc.unseen(new, old)
    return cc.merge_counts(cc.pair_counts(old, tasks=tasks), cc.pair_counts(fresh, tasks=tasks), tasks=tasks).where("co >= 2")


STRUCT_SQL = "structure AS (SELECT DISTINCT least(src, dst) AS path_a, greatest(src, dst) AS path_b FROM import_edge WHERE src <> dst AND reference_status IS NULL)"


@query(f"WITH {BASKET_SQL}, {STRUCT_SQL} SELECT path_a, path_b, co, lift FROM scored WHERE co >= 2 AND lift >= 2 AND NOT EXISTS (SELECT 1 FROM structure s WHERE s.path_a = scored.path_a AND s.path_b = scored.path_b)")
def graph_blind_pairs(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return cc.graph_blind(_pairs(r), cc.structural_pairs(graph.usable(r.import_edge))).select("path_a", "path_b", "co", "lift")


@query(
    f"""WITH {BASKET_SQL}, labelled AS (
      SELECT DISTINCT least(src, dst) AS path_a, greatest(src, dst) AS path_b, CASE WHEN reference_status IS NULL THEN 'resolved' ELSE 'uncertain' END AS label FROM import_edge WHERE src <> dst),
    rows AS (SELECT label, co.co, coalesce(co.co * total.n / (x.n * y.n), 0.0) AS lift FROM labelled LEFT JOIN co USING (path_a, path_b) JOIN nf x ON x.path = path_a JOIN nf y ON y.path = path_b, total),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lift) AS pos, count(*) OVER (PARTITION BY label) AS n FROM rows)
    SELECT label, any_value(n) AS n, count(co) AS ever, max(CASE WHEN pos = n // 2 + 1 THEN lift END) AS median_lift FROM ranked GROUP BY label"""
)
def pair_stats_by_type(spark, sf_dir):
    r = Relations(spark, sf_dir)
    label = F.when(F.col("reference_status").isNull(), "resolved").otherwise("uncertain").alias("label")
    pairs = r.import_edge.where("src <> dst").select(F.least("src", "dst").alias("path_a"), F.greatest("src", "dst").alias("path_b"), label).distinct()
    kept, tasks = cc.stored_baskets(r.touch)
    return cc.pair_stats(pairs, cc.pair_counts(kept, tasks=tasks), cc.file_counts(kept), kept.select("commit_id").distinct().agg(F.count("*").alias("n_total")))


@query("SELECT commit_id, path FROM touch WHERE commit_id NOT IN (SELECT commit_id FROM touch WHERE commit_id % 5 = 0)")
def seen_commit_dedupe(spark, sf_dir):
    touch = Relations(spark, sf_dir).touch
    return cc.unseen(touch, touch.where("commit_id % 5 = 0")).select("commit_id", "path")


STORED_SQL = f"""{BASKET_SQL}, batches AS (SELECT regexp_extract(path_a, 'm([0-9]+)/', 1) AS repo, path_a AS x, path_b AS y, co, n_a AS nx, n_b AS ny, n_total FROM scored WHERE co >= 2
  UNION ALL SELECT regexp_extract(path_a, 'm([0-9]+)/', 1), path_b, path_a, co - 1, n_b, n_a - 1, n_total - 7 FROM scored WHERE co >= 2 UNION ALL SELECT regexp_extract(path_a, 'm([0-9]+)/', 1), path_b, path_a, co + 1, 0, 0, NULL FROM scored WHERE co >= 2 AND n_a % 5 = 0
  UNION ALL SELECT 'x', path_a, path_a, co, n_a, n_b, n_total FROM scored),
turned AS (SELECT repo, least(x, y) AS path_a, greatest(x, y) AS path_b, co, CASE WHEN x > y THEN ny ELSE nx END AS n_a, CASE WHEN x > y THEN nx ELSE ny END AS n_b, n_total FROM batches WHERE x <> y),
stored AS (SELECT repo, path_a, path_b, max(co) AS co, greatest(max(n_a), max(co)) AS n_a, greatest(max(n_b), max(co)) AS n_b, greatest(max(n_total), max(co), max(n_a), max(n_b)) AS n_total FROM turned GROUP BY ALL)"""


def _stored(r: Relations) -> DataFrame:
    """Three batches of pairs, some turned round, late or with too small counts."""
    pairs = _pairs(r, 1, 0.0)
    repo = F.regexp_extract("path_a", "m([0-9]+)/", 1).alias("repo")
    pairs = components.cut(pairs)  # read by all batches
    often = pairs.where("co >= 2")
    first = often.select(repo, "path_a", "path_b", "co", "n_a", "n_b", "n_total")
    late = often.select(repo, F.col("path_b").alias("path_a"), F.col("path_a").alias("path_b"), (F.col("co") - 1).alias("co"), F.col("n_b").alias("n_a"), (F.col("n_a") - 1).alias("n_b"), (F.col("n_total") - 7).alias("n_total"))
    odd = often.where("n_a % 5 = 0").select(repo, F.col("path_b").alias("path_a"), F.col("path_a").alias("path_b"), (F.col("co") + 1).alias("co"), F.lit(0).cast("long").alias("n_a"), F.lit(0).cast("long").alias("n_b"), F.lit(None).cast("long").alias("n_total"))
    same = pairs.select(F.lit("x").alias("repo"), "path_a", F.col("path_a").alias("path_b"), "co", "n_a", "n_b", "n_total")
    return cc.canonical_pairs(odd.unionByName(late).unionByName(same).unionByName(first), -(-pairs.count() // cc.ROWS_A_TASK) or 1)


@query(f"WITH {STORED_SQL} SELECT *, greatest(co / n_a, co / n_b) AS strength, (co * n_total) / (n_a * n_b) AS lift FROM stored")
def cochange_store(spark, sf_dir):
    return _stored(Relations(spark, sf_dir))


@query(f"WITH {STORED_SQL} SELECT repo, path, max(n) AS n FROM (SELECT repo, path_a AS path, n_a AS n FROM stored UNION ALL SELECT repo, path_b, n_b FROM stored) GROUP BY ALL")
def cochange_seed_counters(spark, sf_dir):
    return cc.seed_counters(_stored(Relations(spark, sf_dir)))


# ---- graph -----------------------------------------------------------------------------------------------------

EDGES_SQL = "edges AS (SELECT src, dst, 'imports' AS kind, reference_status FROM import_edge UNION ALL SELECT src, dst, 'calls', reference_status FROM call_edge UNION ALL SELECT src, dst, kind, reference_status FROM resource_edge)"


def _edges(r: Relations) -> DataFrame:
    imports = r.import_edge.select("src", "dst", F.lit("imports").alias("kind"), "reference_status")
    calls = r.call_edge.select("src", "dst", F.lit("calls").alias("kind"), "reference_status")
    return imports.unionAll(calls).unionAll(r.resource_edge.select("src", "dst", "kind", "reference_status"))


@query(f"WITH {EDGES_SQL}, kinds AS (SELECT unnest({v.EDGE_KINDS}) AS kind) SELECT k.kind, count(e.src) AS n FROM kinds k LEFT JOIN edges e ON e.kind = k.kind GROUP BY k.kind")
def kind_counts(spark, sf_dir):
    return graph.kind_counts(_edges(Relations(spark, sf_dir)), v.EDGE_KINDS)


@query("SELECT language, count(*) AS files FROM file_node GROUP BY language")
def language_coverage(spark, sf_dir):
    return graph.language_coverage(Relations(spark, sf_dir).file_node)


@query(
    """WITH few AS (SELECT name FROM symbol_node GROUP BY name HAVING count(DISTINCT path) <= 3)
    SELECT s.path, c.src AS caller, count(DISTINCT s.name) AS n FROM symbol_node s JOIN few USING (name) JOIN call_edge c ON c.dst = s.name WHERE c.src <> s.path GROUP BY ALL"""
)
def blast_radius(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return graph.blast_radius(r.symbol_node, r.call_edge)


HUBS_SQL = f"hubs AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM import_edge WHERE reference_status IS NULL GROUP BY dst HAVING count(DISTINCT src) > {HUB})"


@query(f"WITH {HUBS_SQL} SELECT * FROM hubs")
def hub_files(spark, sf_dir):
    return graph.hub_files(Relations(spark, sf_dir).import_edge, HUB)


HOT_SQL = f"hot AS (SELECT dst, count(DISTINCT src) AS touchers FROM resource_edge WHERE reference_status IS NULL GROUP BY dst HAVING count(DISTINCT src) > {HUB})"


@query(f"WITH {HOT_SQL} SELECT * FROM hot")
def resource_hubs(spark, sf_dir):
    return graph.hub_resources(Relations(spark, sf_dir).resource_edge, HUB)


SIZES_SQL = """fan AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM import_edge WHERE reference_status IS NULL GROUP BY dst),
sizes AS (SELECT path, count(*) AS symbols FROM many_symbols GROUP BY path), churn AS (SELECT path, count(*) AS landings FROM event_log WHERE kind = 'landed' GROUP BY path),
hits AS (SELECT path, count(*) AS collisions FROM event_log WHERE kind = 'collision_held' GROUP BY path)"""
MANY_SQL = "many_symbols AS (SELECT path, name FROM symbol_node UNION ALL SELECT src, dst FROM resource_edge)"


def _many_symbols(r: Relations) -> DataFrame:
    return r.symbol_node.select("path", "name").unionAll(r.resource_edge.select("src", "dst"))


@query(
    f"""WITH {MANY_SQL}, {SIZES_SQL}, rows AS (
      SELECT path, coalesce(importers, 0) AS importers, coalesce(symbols, 0) AS symbols, landings FROM churn JOIN file_node USING (path) LEFT JOIN fan USING (path) LEFT JOIN sizes USING (path) WHERE NOT generated AND landings >= 2)
    SELECT *, CASE WHEN importers >= 8 AND symbols >= 6 THEN 'both' WHEN importers >= 8 THEN 'foundation' ELSE 'god_file' END AS basis FROM rows WHERE importers >= 8 OR symbols >= 6"""
)
def hotspots(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return graph.hotspots(r.file_node, r.import_edge, _many_symbols(r), r.event_log.where("kind = 'landed'"), fan=8, size=6, churn=2)


@query(
    f"""WITH {MANY_SQL}, {SIZES_SQL}, rows AS (
      SELECT path, coalesce(collisions, 0) AS collisions, coalesce(importers, 0) AS importers, coalesce(symbols, 0) AS symbols, coalesce(landings, 0) AS landings
      FROM file_node LEFT JOIN hits USING (path) LEFT JOIN fan USING (path) LEFT JOIN sizes USING (path) LEFT JOIN churn USING (path) WHERE NOT generated),
    flags AS (SELECT *, collisions >= 3 AS o, landings >= 2 AND (importers >= 8 OR symbols >= 6) AS s FROM rows)
    SELECT path, collisions, importers, symbols, landings, CASE WHEN o AND s THEN 'both' WHEN o THEN 'collisions' WHEN symbols >= 6 AND importers < 8 THEN 'god_file' ELSE 'structural' END AS basis,
      greatest(importers, symbols) * landings AS weight FROM flags WHERE o OR s"""
)
def split_candidates(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return graph.split_candidates(r.file_node, r.import_edge, _many_symbols(r), r.event_log.where("kind = 'landed'"), r.event_log.where("kind = 'collision_held'"), fan=8, size=6, churn=2)


@query("SELECT dst AS path, count(DISTINCT src) AS importers FROM import_edge WHERE reference_status IS NULL GROUP BY dst ORDER BY importers DESC, path LIMIT 8")
def central_files(spark, sf_dir):
    return graph.central_files(Relations(spark, sf_dir).import_edge)


@query(
    """WITH many AS (SELECT dst FROM resource_edge WHERE kind = 'alters' GROUP BY dst HAVING count(DISTINCT src) > 1)
    SELECT src, dst, kind, CASE WHEN dst IN (SELECT dst FROM many) THEN 'ambiguous' ELSE reference_status END AS reference_status FROM resource_edge"""
)
def ambiguous_definers(spark, sf_dir):
    return graph.ambiguous_definers(Relations(spark, sf_dir).resource_edge)


@query(
    f"""WITH {EDGES_SQL}, twice AS (SELECT * FROM edges UNION ALL SELECT src, dst, kind, 'unresolved' FROM edges WHERE length(dst) % 2 = 0)
    SELECT src, dst, kind, CASE WHEN bool_or(reference_status IS NULL) THEN NULL ELSE min(reference_status) END AS reference_status FROM twice GROUP BY src, dst, kind"""
)
def edge_dedupe_resolved_wins(spark, sf_dir):
    edges = _edges(Relations(spark, sf_dir))
    twice = edges.unionAll(edges.where("length(dst) % 2 = 0").withColumn("reference_status", F.lit("unresolved")))
    return graph.dedupe_edges(twice)


NODES_SQL = """nodes AS (SELECT path AS id, 'file' AS kind, path, language, cast(NULL AS varchar) AS content_hash, analysis_status FROM file_node
  UNION ALL SELECT path, 'file', path, CASE WHEN loc % 2 = 0 THEN 'unknown' END, 'h' || (loc % 5), CASE WHEN loc % 3 = 0 THEN 'ambiguous' END FROM file_node
  UNION ALL SELECT 'x' || path, 'file', path, 'unknown', NULL, NULL FROM file_node)"""


@query(
    f"""WITH {NODES_SQL} SELECT id, kind, path, coalesce(max(language) FILTER (WHERE language <> 'unknown'), max(language)) AS language, max(content_hash) AS content_hash,
    CASE max(CASE analysis_status WHEN 'failed' THEN 3 WHEN 'incomplete' THEN 2 WHEN 'ambiguous' THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'incomplete' WHEN 1 THEN 'ambiguous' END AS analysis_status
    FROM nodes GROUP BY id, kind, path"""
)
def node_dedupe_status_rank(spark, sf_dir):
    files = Relations(spark, sf_dir).file_node
    one = files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), "path", "language", F.lit(None).cast("string").alias("content_hash"), "analysis_status")
    two = files.select("path", F.lit("file"), "path", F.when(F.col("loc") % 2 == 0, "unknown"), F.concat(F.lit("h"), F.col("loc") % 5), F.when(F.col("loc") % 3 == 0, "ambiguous"))
    three = files.select(F.concat(F.lit("x"), "path"), F.lit("file"), "path", F.lit("unknown"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return graph.dedupe_nodes(one.unionAll(two).unionAll(three))


@query(
    """WITH before AS (SELECT src, dst, reference_status FROM import_edge WHERE length(src) % 3 <> 0), after AS (SELECT src, dst, reference_status FROM import_edge WHERE length(dst) % 3 <> 0)
    SELECT *, 'added' AS change FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after)"""
)
def graph_diff(spark, sf_dir):
    edges = Relations(spark, sf_dir).import_edge
    return graph.graph_diff(edges.where("length(src) % 3 <> 0"), edges.where("length(dst) % 3 <> 0"))


@query(
    """WITH worst AS (SELECT src AS path, max(CASE reference_status WHEN 'unresolved' THEN 2 ELSE 1 END) AS r FROM import_edge WHERE reference_status IS NOT NULL GROUP BY src)
    SELECT path, CASE greatest(CASE analysis_status WHEN 'failed' THEN 3 WHEN 'incomplete' THEN 2 WHEN 'ambiguous' THEN 1 ELSE 0 END, coalesce(r, 0)) WHEN 3 THEN 'failed' WHEN 2 THEN 'incomplete' WHEN 1 THEN 'ambiguous' END AS analysis_status
    FROM file_node LEFT JOIN worst USING (path)"""
)
def status_propagation(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return graph.propagate_status(r.file_node, r.import_edge).select("path", "analysis_status")


@query("WITH fresh AS (SELECT src, dst || '.new' AS dst FROM import_edge WHERE length(src) % 4 = 0) SELECT src, dst FROM import_edge WHERE src NOT IN (SELECT src FROM fresh) UNION ALL SELECT src, dst FROM fresh")
def graph_patch(spark, sf_dir):
    edges = Relations(spark, sf_dir).import_edge.select("src", "dst")
    fresh = edges.where("length(src) % 4 = 0").withColumn("dst", F.concat("dst", F.lit(".new")))
    return graph.patch(edges, fresh, fresh.select(F.col("src").alias("path")), owner="src")


@query("SELECT account, path, arg_max(event_id, (occurred_at, event_id)) AS event_id, max(occurred_at) AS occurred_at FROM event_log GROUP BY account, path")
def latest_version(spark, sf_dir):
    events = Relations(spark, sf_dir).event_log.select("account", "path", "event_id", "occurred_at", F.struct("occurred_at", "event_id").alias("at"))
    return graph.latest_version(events, ["account", "path"], "at").select("account", "path", "event_id", "occurred_at")


# ---- adjacency -------------------------------------------------------------------------------------------------

TEST_SQL = "(regexp_matches(lower({0}), '(^|/)(tests?|specs?|__tests__|examples?|testing)/') OR regexp_matches(regexp_replace({0}, '^.*/', ''), '(^test_|_test\\.|\\.test\\.|_spec\\.|\\.spec\\.)|(Tests?\\.|Specs?\\.)'))"
DEFS_SQL = f"""{HUBS_SQL}, {HOT_SQL},
named AS (SELECT DISTINCT name, path FROM symbol_node WHERE NOT starts_with(name, '__') AND lower(name) NOT IN ({STOP})),
defs AS (SELECT name, path, n FROM named JOIN (SELECT name, count(*) AS n FROM named GROUP BY name HAVING count(*) <= 3) USING (name)),
good_imports AS (SELECT DISTINCT src, dst FROM import_edge WHERE reference_status IS NULL)"""
ADJ_SQL = f"""{DEFS_SQL},
edited AS (SELECT DISTINCT path AS f, agent, change_id FROM claim WHERE state = 'active'),
links AS (SELECT DISTINCT c.src AS caller, d.path AS definer FROM call_edge c JOIN defs d ON d.name = c.dst WHERE c.reference_status IS NULL AND c.src <> d.path AND d.path NOT IN (SELECT path FROM hubs)
  AND (EXISTS (SELECT 1 FROM good_imports i WHERE i.src = c.src AND i.dst = d.path)
    OR (d.n = 1 AND NOT ({TEST_SQL.format("d.path")} AND NOT {TEST_SQL.format("c.src")}) AND length(d.name) > 2 AND lower(d.name) NOT IN ({TAILS})))),
cool AS (SELECT DISTINCT src, dst FROM resource_edge WHERE reference_status IS NULL AND dst NOT IN (SELECT dst FROM hot)),
axes AS (SELECT caller AS f, definer AS nbr, 'up' AS dir FROM links UNION SELECT definer, caller, 'down' FROM links
  UNION SELECT src, dst, 'up' FROM good_imports WHERE src <> dst AND dst NOT IN (SELECT path FROM hubs) UNION SELECT dst, src, 'down' FROM good_imports WHERE src <> dst AND dst NOT IN (SELECT path FROM hubs)
  UNION SELECT a.src, b.src, 'shared' FROM cool a JOIN cool b ON a.dst = b.dst AND a.src <> b.src),
adjacent AS (SELECT f, agent, change_id, nbr, dir FROM edited JOIN axes USING (f))"""


def _adjacency(r: Relations) -> DataFrame:
    return adj.claim_adjacency(r.claim, r.symbol_node, r.call_edge, r.import_edge, r.resource_edge, HUB)


@query(f"WITH {ADJ_SQL} SELECT * FROM adjacent")
def claim_adjacency(spark, sf_dir):
    return _adjacency(Stored(spark, sf_dir))


@query(f"WITH {ADJ_SQL} SELECT dir, count(*) AS links, count(DISTINCT f) AS files FROM adjacent GROUP BY dir")
def claim_adjacency_dirs(spark, sf_dir):
    return _adjacency(Stored(spark, sf_dir)).groupBy("dir").agg(F.count("*").alias("links"), F.countDistinct("f").alias("files"))


DAMP_SQL = f"""live AS (SELECT DISTINCT path, change_id FROM claim WHERE state = 'active'),
via_import AS (SELECT DISTINCT src, dst FROM good_imports WHERE src <> dst AND dst IN (SELECT path FROM hubs) AND src IN (SELECT path FROM live) AND dst IN (SELECT path FROM live)),
via_call AS (SELECT DISTINCT c.src, d.path AS dst FROM call_edge c JOIN defs d ON d.name = c.dst WHERE c.reference_status IS NULL AND c.src <> d.path AND d.path IN (SELECT path FROM hubs)
  AND c.src IN (SELECT path FROM live) AND d.path IN (SELECT path FROM live)
  AND (EXISTS (SELECT 1 FROM good_imports i WHERE i.src = c.src AND i.dst = d.path) OR (d.n = 1 AND length(d.name) > 2 AND lower(d.name) NOT IN ({TAILS})))),
via_hub AS (SELECT * FROM via_import UNION SELECT * FROM via_call),
via_res AS (SELECT DISTINCT src, dst FROM resource_edge WHERE reference_status IS NULL AND dst IN (SELECT dst FROM hot) AND src IN (SELECT path FROM live)),
coupled AS (SELECT src AS f, dst AS nbr, dst AS via FROM via_hub UNION SELECT dst, src, dst FROM via_hub UNION SELECT a.src, b.src, a.dst FROM via_res a JOIN via_res b ON a.dst = b.dst AND a.src <> b.src),
damp AS (SELECT DISTINCT c.f, a.change_id, c.nbr, b.change_id AS nbr_change, c.via FROM coupled c JOIN live a ON a.path = c.f JOIN live b ON b.path = c.nbr WHERE a.change_id <> b.change_id)"""


def _dampened(r: Relations) -> DataFrame:
    return adj.dampened_pairs(r.claim, r.symbol_node, r.call_edge, r.import_edge, r.resource_edge, HUB)


@query(f"WITH {DEFS_SQL}, {DAMP_SQL} SELECT * FROM damp")
def dampened_pairs(spark, sf_dir):
    return _dampened(Stored(spark, sf_dir))


@query(
    f"""WITH named AS (SELECT DISTINCT name, path FROM symbol_node WHERE NOT starts_with(name, '__') AND lower(name) NOT IN ({STOP})),
    defs AS (SELECT name, path FROM named WHERE lower(name) NOT IN ({TAILS}) AND length(name) >= 3 AND name IN (SELECT name FROM named GROUP BY name HAVING count(*) <= 3)),
    res AS (SELECT DISTINCT src, dst FROM resource_edge),
    raw AS (SELECT src, dst, 'import' AS label FROM import_edge UNION ALL SELECT c.src, d.path, 'call' FROM call_edge c JOIN defs d ON d.name = c.dst UNION ALL SELECT a.src, b.src, 'resource' FROM res a JOIN res b ON a.dst = b.dst AND a.src < b.src)
    SELECT DISTINCT least(src, dst) AS path_a, greatest(src, dst) AS path_b, label FROM raw WHERE src <> dst"""
)
def coupled_pairs_offline(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return adj.coupled_pairs_offline(r.symbol_node, r.call_edge, r.import_edge, r.resource_edge)


CONTRACT_SQL = """contracts_a AS (SELECT src AS path, dst AS contract, CASE WHEN kind = 'alters' THEN 'defines' ELSE 'uses' END AS role FROM resource_edge WHERE src LIKE 'src/%'),
contracts_b AS (SELECT src AS path, dst AS contract, CASE WHEN kind = 'alters' THEN 'defines' ELSE 'uses' END AS role FROM resource_edge WHERE src LIKE 'tests/%'),
bad AS (SELECT contract FROM contracts_a WHERE role = 'defines' GROUP BY contract HAVING count(DISTINCT path) > 1 UNION SELECT contract FROM contracts_b WHERE role = 'defines' GROUP BY contract HAVING count(DISTINCT path) > 1),
linked AS (SELECT a.path AS definer, b.path AS consumer, a.contract FROM contracts_a a JOIN contracts_b b ON a.contract = b.contract AND a.role = 'defines' AND b.role = 'uses'
  UNION SELECT b.path, a.path, a.contract FROM contracts_a a JOIN contracts_b b ON a.contract = b.contract AND b.role = 'defines' AND a.role = 'uses')"""


@query(f"WITH {CONTRACT_SQL} SELECT * FROM linked WHERE contract NOT IN (SELECT contract FROM bad)")
def cross_repo_contracts(spark, sf_dir):
    rows = Relations(spark, sf_dir).resource_edge.select(F.col("src").alias("path"), F.col("dst").alias("contract"), F.when(F.col("kind") == "alters", "defines").otherwise("uses").alias("role"))
    return adj.cross_repo_contracts(rows.where("path like 'src/%'"), rows.where("path like 'tests/%'"))


@query(f"WITH {CONTRACT_SQL} SELECT contract, count(*) AS links FROM linked WHERE contract NOT IN (SELECT contract FROM bad) GROUP BY contract")
def cross_tenant_contract_surface(spark, sf_dir):
    """Counts per shared contract only, as two consenting tenants see them."""
    return cross_repo_contracts(spark, sf_dir).groupBy("contract").agg(F.count("*").alias("links"))


# ---- contention ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {ADJ_SQL}, other AS (SELECT DISTINCT path AS nbr, agent AS oa, change_id AS oc FROM claim WHERE state = 'active')
    SELECT f AS path, count(DISTINCT oc) AS degree FROM adjacent JOIN other USING (nbr) WHERE agent <> oa GROUP BY f"""
)
def contested_files(spark, sf_dir):
    r = Stored(spark, sf_dir)
    return contention.contested_files(_adjacency(r), r.claim)


OVERLAP_SQL = """tight AS (SELECT claim_id, s.name, row_number() OVER (PARTITION BY claim_id ORDER BY end_line - start_line, start_line, s.name) AS rn FROM claim c JOIN symbol_node s ON s.path = c.path AND c.lo >= s.start_line AND c.hi <= s.end_line + 1),
hashes AS (SELECT path, min(content_hash) AS g, max(end_line) AS last_line FROM symbol_node GROUP BY path),
claim_side AS (SELECT c.*, t.name, c.base_hash = g AS fresh, c.lo > last_line AS app FROM claim c LEFT JOIN tight t ON t.claim_id = c.claim_id AND rn = 1 LEFT JOIN hashes USING (path)),
overlap AS (SELECT w.path, w.change_id AS waiter, h.change_id AS holder, CASE WHEN w.name = h.name THEN 'same' WHEN w.fresh AND h.fresh AND w.name IS NOT NULL AND h.name IS NOT NULL THEN 'disjoint' WHEN w.fresh AND h.fresh AND w.app AND h.app THEN 'append' ELSE 'unknown' END AS relation
  FROM claim_side w JOIN claim_side h ON w.path = h.path AND w.state = 'waiting' AND h.state = 'active' AND w.change_id <> h.change_id)"""
RELEASE = v.RELEASE_BRANCH.replace("'", "''")
RAW_WAITS_SQL = f"""raw_waits AS (SELECT w.path, w.change_id AS waiter, h.change_id AS holder, w.claim_id AS waiter_claim, h.claim_id AS holder_claim, h.change_id LIKE 'BR-%' AND NOT regexp_matches(lower(substr(h.change_id, 4)), '{RELEASE}') AS advisory
    FROM claim w JOIN claim h ON w.path = h.path AND w.state = 'waiting' AND h.state = 'active' AND w.change_id <> h.change_id
  UNION ALL SELECT w.path, w.change_id, f.holder, w.claim_id, f.holder_claim, false
    FROM claim w JOIN (SELECT path, arg_min(change_id, (claimed_at, change_id)) AS holder, arg_min(claim_id, (claimed_at, change_id)) AS holder_claim FROM claim WHERE change_id LIKE 'PR-%' GROUP BY path) f USING (path)
    WHERE w.state = 'waiting' AND w.change_id LIKE 'PR-%' AND w.change_id <> f.holder AND w.path IN (SELECT path FROM claim WHERE state = 'active' AND change_id LIKE 'BR-%' AND NOT regexp_matches(lower(substr(change_id, 4)), '{RELEASE}')))"""
WAITS_SQL = f"""{OVERLAP_SQL}, {RAW_WAITS_SQL}, drafts AS (SELECT change_id, bool_or(is_draft) AS draft FROM claim GROUP BY change_id),
known_overlap AS (SELECT path, waiter, holder, bool_or(relation = 'disjoint') AS apart, bool_or(relation = 'same') AS same, bool_or(relation = 'append') AS appends FROM (SELECT * FROM overlap UNION ALL SELECT path, holder, waiter, relation FROM overlap) GROUP BY path, waiter, holder),
wait_rows AS (SELECT w.path, w.waiter, w.holder, w.waiter_claim, w.holder_claim, x.draft <> y.draft AS cross_draft, regexp_matches(lower(w.path), '\\.(lock|snap|min\\.js)$') AND NOT coalesce(o.same, false) AS low_value, coalesce(o.appends, false) AS append_soft, w.advisory
  FROM raw_waits w JOIN drafts x ON x.change_id = w.waiter JOIN drafts y ON y.change_id = w.holder LEFT JOIN known_overlap o ON o.path = w.path AND o.waiter = w.waiter AND o.holder = w.holder WHERE NOT coalesce(o.apart, false))"""


def _waits(r: Relations) -> DataFrame:
    return contention.waits(r.claim, contention.symbol_overlap(r.claim, r.symbol_node))


@query(f"WITH {WAITS_SQL} SELECT * FROM wait_rows")
def waits(spark, sf_dir):
    return _waits(Stored(spark, sf_dir))


@query("SELECT path, arg_min(change_id, (claimed_at, claim_id)) AS leader, count(DISTINCT change_id) AS changes FROM claim GROUP BY path HAVING count(DISTINCT change_id) >= 2")
def waits_leader(spark, sf_dir):
    """The earliest change of each contended path."""
    rows = Relations(spark, sf_dir).claim.groupBy("path").agg(F.min_by("change_id", F.struct("claimed_at", "claim_id")).alias("leader"), F.countDistinct("change_id").alias("changes"))
    return rows.where("changes >= 2")


@query(
    """SELECT w.path, w.change_id AS waiter, h.change_id AS holder, min(greatest(w.lo, h.lo)) AS line FROM claim w JOIN claim h ON w.path = h.path AND w.state = 'waiting' AND h.state = 'active' AND w.change_id <> h.change_id
    WHERE greatest(w.lo, h.lo) - least(w.hi, h.hi) <= 2 GROUP BY ALL"""
)
def conflict_points(spark, sf_dir):
    return contention.conflict_points(Relations(spark, sf_dir).claim)


@query(f"WITH {OVERLAP_SQL} SELECT * FROM overlap")
def symbol_overlap_relation(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return contention.symbol_overlap(r.claim, r.symbol_node)


LINKS_SQL = """active_by_path AS (SELECT DISTINCT path AS nbr, change_id AS b FROM claim WHERE state = 'active'),
direct AS (SELECT DISTINCT waiter AS a, holder AS b FROM raw_waits),
pair_links AS (SELECT DISTINCT change_id AS a, b FROM adjacent JOIN active_by_path USING (nbr) WHERE change_id <> b UNION SELECT a, b FROM direct)"""


def _links(r: Relations, adjacency: DataFrame | None = None) -> DataFrame:
    """Every direct wait, proven disjoint or not, and every coupling links."""
    return contention.change_links(contention.waits(r.claim), _adjacency(r) if adjacency is None else adjacency, r.claim)


@query(
    f"""WITH RECURSIVE {ADJ_SQL}, {RAW_WAITS_SQL}, {LINKS_SQL}, sides AS (SELECT a, b FROM pair_links UNION SELECT b, a FROM pair_links), nodes AS (SELECT DISTINCT change_id AS node FROM claim),
    reach(x, y) AS (SELECT node, node FROM nodes UNION SELECT r.x, s.b FROM reach r JOIN sides s ON s.a = r.y) SELECT x AS node, min(y) AS component FROM reach GROUP BY x"""
)
def inflight_components(spark, sf_dir):
    r = Stored(spark, sf_dir)
    return components.connected_components(r.claim.select(F.col("change_id").alias("node")).distinct(), _links(r))


DEPS_SQL = "deps AS (SELECT DISTINCT waiter AS node, holder AS needs FROM raw_waits WHERE length(waiter) > length(holder) OR (length(waiter) = length(holder) AND waiter > holder)), nodes AS (SELECT DISTINCT change_id AS node FROM claim)"


@query(
    f"""WITH RECURSIVE {RAW_WAITS_SQL}, {DEPS_SQL}, walk(node, needs, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT w.node, p.needs, w.d + 1 FROM walk w JOIN deps p ON p.node = w.needs WHERE w.d < 64)
    SELECT node, max(d) AS depth FROM walk GROUP BY node"""
)
def landing_depth(spark, sf_dir):
    claims = Stored(spark, sf_dir).claim
    nodes = claims.select(F.col("change_id").alias("node")).distinct()
    return components.depths(nodes, _deps(claims))


def _deps(claims: DataFrame) -> DataFrame:
    """A wait of a later change needs the earlier one landed: every direct wait, so that ties in it are no cycle."""
    later = "length(waiter) > length(holder) or (length(waiter) = length(holder) and waiter > holder)"
    return contention.waits(claims).where(later).select(F.col("waiter").alias("node"), F.col("holder").alias("needs")).distinct()


VERDICT_SQL = f"""{ADJ_SQL}, {WAITS_SQL}, {DAMP_SQL}, {BASKET_SQL}, {EDGES_SQL},
changes AS (SELECT change_id, any_value(repo) AS repo FROM claim GROUP BY change_id), own AS (SELECT DISTINCT change_id, path FROM claim),
w AS (SELECT waiter AS change_id, bool_or(NOT cross_draft AND NOT low_value AND NOT append_soft AND NOT advisory) AS hard, bool_or(NOT cross_draft) AS soft, bool_or(cross_draft) AS draft FROM wait_rows GROUP BY waiter),
con AS (SELECT DISTINCT a.change_id, true AS contested FROM adjacent a JOIN claim c ON c.path = a.nbr AND c.state = 'active' AND c.change_id <> a.change_id),
doubt AS (SELECT path, analysis_status IN ('failed', 'incomplete') AS loss FROM file_node WHERE analysis_status IS NOT NULL UNION SELECT src, false FROM edges WHERE reference_status IN ('ambiguous', 'unresolved')
  UNION SELECT path, false FROM file_node WHERE path IN (SELECT dst FROM edges WHERE reference_status = 'ambiguous')),
doubts AS (SELECT path, bool_or(loss) AS loss FROM doubt GROUP BY path),
facts AS (SELECT change_id, bool_or(f.path IS NULL) AS absent, bool_or(d.path IS NOT NULL) AS uncertain, coalesce(bool_or(d.loss), false) AS loss FROM own LEFT JOIN file_node f USING (path) LEFT JOIN doubts d USING (path) GROUP BY change_id),
d AS (SELECT change_id, true AS dampened, bool_or(EXISTS (SELECT 1 FROM scored s WHERE s.path_a = least(f, nbr) AND s.path_b = greatest(f, nbr) AND s.co >= 3 AND s.lift >= 2)) AS borne_out FROM damp GROUP BY change_id),
loss AS (SELECT repo, bool_or(loss) AS any_loss FROM facts JOIN changes USING (change_id) GROUP BY repo),
ladder AS (SELECT change_id, CASE WHEN hard THEN 1 WHEN soft THEN 2 WHEN draft THEN 3 WHEN contested THEN 4 WHEN absent THEN 5 WHEN borne_out THEN 6 WHEN any_loss THEN 7 WHEN uncertain THEN 8 WHEN dampened THEN 9 ELSE 10 END AS step,
    coalesce(any_loss, false) AND NOT (coalesce(soft, false) OR coalesce(draft, false) OR contested IS NOT NULL OR absent OR coalesce(borne_out, false) OR uncertain OR dampened IS NOT NULL) AS promoted
  FROM changes LEFT JOIN w USING (change_id) LEFT JOIN con USING (change_id) LEFT JOIN facts USING (change_id) LEFT JOIN d USING (change_id) JOIN loss USING (repo)),
judged AS (SELECT change_id, step, promoted, (['serialize', 'serialize_soft', 'warn', 'warn', 'unknown', 'warn', 'unknown', 'unknown', 'unknown', 'clear'])[step] AS verdict FROM ladder)"""


def _facts(r: Relations, adjacency: DataFrame | None = None) -> DataFrame:
    return contention.change_facts(r.claim, r.file_node, _waits(r), _adjacency(r) if adjacency is None else adjacency, _dampened(r), _pairs(r, 3, 2.0), _edges(r))


@query(f"WITH {VERDICT_SQL} SELECT change_id, verdict, cast(step AS int) AS step FROM judged")
def verdicts(spark, sf_dir):
    return contention.verdicts(_facts(Stored(spark, sf_dir)))


@query(f"WITH {VERDICT_SQL} SELECT change_id FROM judged WHERE promoted")
def inflight_loss_promoted(spark, sf_dir):
    return contention.loss_promoted(_facts(Stored(spark, sf_dir)))


@query(
    f"""WITH {EDGES_SQL} SELECT path, CASE analysis_status WHEN 'failed' THEN 'analysis_failed' WHEN 'ambiguous' THEN 'analysis_ambiguous' ELSE 'analysis_incomplete' END AS reason FROM file_node WHERE analysis_status IS NOT NULL
    UNION SELECT src, 'reference_' || reference_status FROM edges WHERE reference_status IN ('ambiguous', 'unresolved')
    UNION SELECT path, 'reference_ambiguous' FROM file_node WHERE path IN (SELECT dst FROM edges WHERE reference_status = 'ambiguous')"""
)
def uncertain_paths(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return contention.uncertain_paths(r.file_node, _edges(r))


@query(f"WITH {DEFS_SQL}, {DAMP_SQL}, {BASKET_SQL} SELECT damp.*, EXISTS (SELECT 1 FROM scored s WHERE s.path_a = least(f, nbr) AND s.path_b = greatest(f, nbr) AND s.co >= 2 AND s.lift >= 1.5) AS corroborated FROM damp")
def corroborated_dampened(spark, sf_dir):
    r = Stored(spark, sf_dir)
    return contention.corroborated(_dampened(r), _pairs(r, 2, 1.5), min_co=2, min_lift=1.5)


@query(
    f"""WITH RECURSIVE {VERDICT_SQL}, {LINKS_SQL}, sides AS (SELECT a, b FROM pair_links UNION SELECT b, a FROM pair_links),
    reach(x, y) AS (SELECT change_id, change_id FROM changes UNION SELECT r.x, s.b FROM reach r JOIN sides s ON s.a = r.y),
    member AS (SELECT x AS change_id, min(y) AS component FROM reach GROUP BY x),
    sized AS (SELECT component, count(*) AS size, (['serialize', 'serialize_soft', 'warn', 'unknown', 'clear'])[min(list_position(['serialize', 'serialize_soft', 'warn', 'unknown', 'clear'], verdict))] AS worst FROM member JOIN judged USING (change_id) GROUP BY component HAVING count(*) >= 2),
    spots AS (SELECT component, path FROM claim JOIN member USING (change_id) GROUP BY component, path HAVING count(DISTINCT change_id) >= 2)
    SELECT component, any_value(size) AS size, any_value(worst) AS worst, count(path) AS hotspots FROM sized LEFT JOIN spots USING (component) GROUP BY component"""
)
def cluster_rollup(spark, sf_dir):
    r = Stored(spark, sf_dir)
    near = components.cut(_adjacency(r))
    parts = components.connected_components(r.claim.select(F.col("change_id").alias("node")).distinct(), _links(r, near))
    return contention.cluster_rollup(parts, contention.verdicts(_facts(r, near)), r.claim)


@query(
    f"""WITH {VERDICT_SQL}, added AS (SELECT DISTINCT path FROM claim WHERE claim_id % 2 = 0), cut_short AS (SELECT DISTINCT change_id, true AS truncated FROM claim WHERE claim_id % 13 = 0),
    seen AS (SELECT change_id, bool_and(path IN (SELECT path FROM added)) FILTER (WHERE f.path IS NULL) AS all_new, bool_or(f.path IS NOT NULL) AS some_known FROM own LEFT JOIN (SELECT path FROM file_node) f USING (path) GROUP BY change_id),
    lone AS (SELECT change_id, true AS lone FROM damp WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.path_a = least(f, nbr) AND s.path_b = greatest(f, nbr) AND s.co >= 3 AND s.lift >= 2) GROUP BY change_id)
    SELECT change_id, verdict, CASE WHEN verdict <> 'unknown' THEN CASE WHEN lone OR (verdict = 'clear' AND truncated) THEN 'unknown' ELSE verdict END
      WHEN dampened IS NULL AND truncated IS NULL AND all_new AND some_known THEN 'clear' ELSE 'unknown' END AS effective
    FROM judged LEFT JOIN seen USING (change_id) LEFT JOIN d USING (change_id) LEFT JOIN lone USING (change_id) LEFT JOIN cut_short USING (change_id)"""
)
def effective_verdicts(spark, sf_dir):
    r = Stored(spark, sf_dir)
    added = r.claim.where("claim_id % 2 = 0").select("path").distinct()
    truncated = r.claim.where("claim_id % 13 = 0").select("change_id").distinct()
    damp = contention.corroborated(_dampened(r), _pairs(r, 3, 2.0))
    return contention.effective_verdicts(contention.verdicts(_facts(r)), r.claim, r.file_node, damp, added, truncated)


@query(
    f"""WITH RECURSIVE {ADJ_SQL}, {RAW_WAITS_SQL}, {LINKS_SQL}, {DEPS_SQL}, sides AS (SELECT a, b FROM pair_links UNION SELECT b, a FROM pair_links),
    reach(x, y) AS (SELECT node, node FROM nodes UNION SELECT r.x, s.b FROM reach r JOIN sides s ON s.a = r.y), member AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x),
    walk(node, needs, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT w.node, p.needs, w.d + 1 FROM walk w JOIN deps p ON p.node = w.needs WHERE w.d < 64), depth AS (SELECT node, max(d) AS depth FROM walk GROUP BY node),
    impact AS (SELECT change_id, count(DISTINCT nbr) AS impact FROM adjacent WHERE dir IN ('down', 'shared') GROUP BY change_id)
    SELECT component, node AS change_id, depth, coalesce(impact, 0) AS impact, row_number() OVER (PARTITION BY component ORDER BY depth DESC, coalesce(impact, 0) DESC, node) AS position
    FROM depth JOIN member USING (node) LEFT JOIN impact ON change_id = node"""
)
def suggested_order(spark, sf_dir):
    r = Stored(spark, sf_dir)
    nodes = r.claim.select(F.col("change_id").alias("node")).distinct()
    near = components.cut(_adjacency(r))
    return contention.suggested_order(components.depths(nodes, _deps(r.claim)), contention.impacts(near), components.connected_components(nodes, _links(r, near)))


@query("SELECT claim_id, path, change_id, row_number() OVER (PARTITION BY path ORDER BY claimed_at, claim_id) AS position FROM claim WHERE state = 'waiting'")
def queue_positions(spark, sf_dir):
    return graph.queue_positions(Relations(spark, sf_dir).claim)


FINDINGS_SQL = """findings AS (SELECT change_id || '-' || (event_id % 10) AS producer_pr, 'PR-' || ((event_id * 7) % 6 * 10 + event_id % 10) || '-' || (event_id % 10) AS consumer_pr,
  CASE event_id % 3 WHEN 0 THEN 'required_arg_added' WHEN 1 THEN 'kwonly_renamed' ELSE 'varargs_removed' END AS rule_id, CASE event_id % 4 WHEN 0 THEN 'risky' WHEN 1 THEN 'unknown' ELSE 'breaking' END AS compat_result FROM event_log WHERE kind = 'warned')"""


def _findings(r: Relations) -> DataFrame:
    rule = F.when(F.col("event_id") % 3 == 0, "required_arg_added").when(F.col("event_id") % 3 == 1, "kwonly_renamed").otherwise("varargs_removed")
    result = F.when(F.col("event_id") % 4 == 0, "risky").when(F.col("event_id") % 4 == 1, "unknown").otherwise("breaking")
    group = F.col("event_id") % 10
    consumer = F.concat_ws("-", F.lit("PR"), (F.col("event_id") * 7) % 6 * 10 + F.col("event_id") % 10, group)
    return r.event_log.where("kind = 'warned'").select(F.concat_ws("-", "change_id", group).alias("producer_pr"), consumer.alias("consumer_pr"), rule.alias("rule_id"), result.alias("compat_result"))


#: Findings in small clusters of six changes for each landing, of all classes by the landing's number.
PLANS_SQL = """typed AS (SELECT 'L' || (event_id // 12) || '-' || (event_id % 5) AS producer_pr, 'L' || (event_id // 12) || '-' || ((event_id + CASE WHEN event_id // 12 % 7 = 3 THEN 1 + event_id % 2 * 3 ELSE 1 + event_id // 12 % 3 END) % 5 + CASE WHEN event_id // 12 % 4 = 0 AND event_id % 5 >= 3 THEN 5 ELSE 0 END) AS consumer_pr,
  CASE WHEN event_id % 7 = 0 THEN 'consumer_call_mismatch' ELSE 'required_arg_added' END AS rule_id, CASE WHEN event_id // 12 % 7 = 3 THEN 'breaking' WHEN event_id % 9 = 0 AND event_id // 12 % 5 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'risky' ELSE 'breaking' END AS compat_result,
  CASE WHEN event_id % 11 = 0 AND event_id // 12 % 2 = 0 THEN 'rebase_needed' END AS evidence_class, CASE WHEN event_id % 7 = 0 THEN 'arity' END AS reason_detail FROM event_log)"""
PLAN_SQL = f"""{PLANS_SQL}, marked AS (SELECT *, coalesce(evidence_class, CASE WHEN rule_id = 'consumer_call_mismatch' THEN rule_id END, '') AS e FROM typed WHERE producer_pr <> consumer_pr),
flagged AS (SELECT producer_pr AS p, consumer_pr AS c, compat_result = 'unknown' OR (e = 'consumer_call_mismatch' AND reason_detail IS NULL) AS unknown, e = 'rebase_needed' AS rebase, e = 'consumer_call_mismatch' AND compat_result = 'breaking' AND reason_detail IS NOT NULL AS revise, compat_result FROM marked),
dir AS (SELECT p, c, bool_or(unknown) AS unknown, bool_or(rebase) AS rebase, bool_or(revise) AS revise, bool_or(NOT unknown AND NOT rebase) AS live, bool_or(NOT unknown AND NOT rebase AND compat_result = 'breaking') AS hard FROM flagged GROUP BY p, c),
mut AS (SELECT x.p, x.c FROM dir x JOIN dir y ON x.p = y.c AND x.c = y.p WHERE x.hard AND y.hard),
step AS (SELECT p, c FROM dir WHERE live AND NOT EXISTS (SELECT 1 FROM mut WHERE mut.p = dir.p AND mut.c = dir.c)),
plan_nodes AS (SELECT p AS x FROM dir UNION SELECT c FROM dir), ends AS (SELECT p AS a, c AS b FROM dir UNION SELECT c, p FROM dir),
reach(x, y) AS (SELECT x, x FROM plan_nodes UNION SELECT r.x, e.b FROM reach r JOIN ends e ON e.a = r.y), part AS (SELECT x, min(y) AS component FROM reach GROUP BY x),
down(x, y) AS (SELECT p, c FROM step UNION SELECT d.x, s.c FROM down d JOIN step s ON s.p = d.y),
classes AS (SELECT component, count(DISTINCT part.x) AS changes, CASE WHEN bool_or(dir.unknown) THEN 'unknown' WHEN bool_or(EXISTS (SELECT 1 FROM mut WHERE mut.p = dir.p AND mut.c = dir.c)) THEN 'mutual'
  WHEN bool_or(EXISTS (SELECT 1 FROM down WHERE down.x = part.x AND down.y = part.x)) THEN 'cycle' WHEN bool_or(dir.rebase) THEN 'rebase' WHEN bool_or(dir.revise) THEN 'ordered_with_revision' ELSE 'ordered' END AS plan
  FROM part LEFT JOIN dir ON dir.p = part.x GROUP BY component)"""


def _typed_findings(r: Relations) -> DataFrame:
    return r.query("SELECT * FROM (" + PLANS_SQL.removeprefix("typed AS (").removesuffix(")").replace("//", "DIV") + ")", "event_log")


LEDGES_SQL = f"""{FINDINGS_SQL}, ledges AS (SELECT producer_pr AS producer, consumer_pr AS consumer, bool_or(compat_result = 'breaking') AS hard, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules
  FROM findings WHERE producer_pr <> consumer_pr AND compat_result IN ('breaking', 'risky') GROUP BY ALL)"""


@query(f"WITH {LEDGES_SQL} SELECT * FROM ledges")
def landing_order_edges(spark, sf_dir):
    return landing.landing_edges(_findings(Relations(spark, sf_dir)))


@query(f"WITH {LEDGES_SQL} SELECT x.producer AS a, x.consumer AS b FROM ledges x JOIN ledges y ON x.producer = y.consumer AND x.consumer = y.producer WHERE x.hard AND y.hard AND x.producer < x.consumer")
def landing_mutual_pairs(spark, sf_dir):
    return landing.mutual_pairs(landing.landing_edges(_findings(Relations(spark, sf_dir))))


@query(f"WITH RECURSIVE {PLAN_SQL} SELECT component, plan, changes FROM classes")
def landing_plan_classes(spark, sf_dir):
    plan = landing.landing_plan(_typed_findings(Relations(spark, sf_dir)))
    return plan.groupBy("component", "plan").agg(F.count("*").alias("changes"))


def _lane(change):
    """The lane a change lands in, of 35."""
    return F.regexp_extract(change, "^L([0-9]+)", 1).cast("long") % 35


@query(
    f"""WITH RECURSIVE {PLAN_SQL}, orders AS (SELECT down.x, down.y, component FROM down JOIN part USING (x) JOIN classes USING (component) WHERE plan IN ('ordered', 'ordered_with_revision')),
    lane_plans AS (SELECT regexp_extract(component, '^L([0-9]+)', 1)::BIGINT % 35 AS lane, count(*) AS clusters, min(list_position(['unknown', 'mutual', 'cycle', 'rebase', 'ordered_with_revision', 'ordered'], plan)) AS worst FROM classes GROUP BY 1),
    lane_pairs AS (SELECT regexp_extract(component, '^L([0-9]+)', 1)::BIGINT % 35 AS lane, count(*) AS ordered_pairs FROM orders GROUP BY 1),
    lane_skips AS (SELECT regexp_extract(producer_pr, '^L([0-9]+)', 1)::BIGINT % 35 AS lane, count(*) FILTER (WHERE producer_pr = consumer_pr) AS skipped FROM typed GROUP BY 1)
    SELECT lane, clusters, coalesce(ordered_pairs, 0) AS ordered_pairs, skipped, CASE WHEN skipped > 0 THEN 'unknown' ELSE (['unknown', 'mutual', 'cycle', 'rebase', 'ordered_with_revision', 'ordered'])[worst] END AS classification
    FROM lane_plans LEFT JOIN lane_pairs USING (lane) JOIN lane_skips USING (lane)"""
)
def landing_plan_summary(spark, sf_dir):
    """Each lane's class, and how many pairs of changes must land in the order given: all that follow each other over live findings."""
    findings = _typed_findings(Relations(spark, sf_dir))
    plan = components.cut(landing.landing_plan(findings))
    steps = landing.plan_edges(findings).where("live").select("producer", "consumer")
    place = plan.where("position is not null").select("component", "change_id", "position")
    a, b = place.withColumnsRenamed({"change_id": "producer", "position": "x"}), place.withColumnsRenamed({"change_id": "consumer", "position": "y"})
    pairs = components.cut(steps.join(a, "producer").join(b, ["component", "consumer"]).where("x < y").select("producer", "consumer"))
    for _ in range(3):  # ways of up to eight steps; a cluster has at most six changes
        pairs = components.cut(pairs.union(pairs.join(pairs.select(F.col("producer").alias("consumer"), F.col("consumer").alias("next")), "consumer").select("producer", F.col("next").alias("consumer"))).distinct())
    counted = pairs.groupBy(_lane(F.col("producer")).alias("lane")).agg(F.count("*").alias("ordered_pairs"))
    return landing.plan_summary(findings, plan, _lane).join(counted, "lane", "left").na.fill(0, ["ordered_pairs"]).select("lane", "clusters", "ordered_pairs", "skipped", "classification")


@query()
def landing_plan(spark, sf_dir):
    return landing.landing_plan(_findings(Relations(spark, sf_dir)))


# ---- compatibility ---------------------------------------------------------------------------------------------

SHAPES_SQL = """SELECT p_partkey AS symbol, p_partkey % 11 = 0 AS gone, p_partkey % 23 = 0 AS broken, p_size % 4 AS n1, (p_size + p_partkey) % 4 AS n2, p_partkey % 3 AS r1, p_size % 3 AS r2, p_partkey % 5 = 0 AS v1, p_size % 5 = 0 AS v2, p_partkey % 6 AS k1, p_size % 6 AS k2 FROM part"""


def _shape(names: str, required: str, varargs: str, kw: str):
    params = F.slice(F.array(*[F.lit(x) for x in "abc"]), F.lit(1), F.col(names))
    arity = F.least(F.col(required), F.col(names)).cast("int")
    kws = F.when(F.col(kw) == 0, F.array(F.lit("x"))).when(F.col(kw) == 1, F.array(F.lit("y"))).otherwise(F.expr("cast(array() as array<string>)"))
    mark = F.concat_ws("/", F.array_join(params, ","), arity, F.array_join(kws, ","), F.col(varargs))
    return F.struct(params.alias("param_names"), kws.alias("kwonly_names"), arity.alias("required_arity"), F.col(varargs).alias("has_varargs"), mark.alias("shape_fingerprint"))


@query(
    f"""WITH s AS ({SHAPES_SQL}), t AS (SELECT symbol, gone, broken, (['a', 'b', 'c'])[1:n1] AS p1, (['a', 'b', 'c'])[1:n2] AS p2, least(r1, n1) AS q1, least(r2, n2) AS q2, v1, v2,
      CASE k1 WHEN 0 THEN ['x'] WHEN 1 THEN ['y'] ELSE []::VARCHAR[] END AS w1, CASE k2 WHEN 0 THEN ['x'] WHEN 1 THEN ['y'] ELSE []::VARCHAR[] END AS w2 FROM s),
    r AS (SELECT *, p1 = p2 AND q1 = q2 AND w1 = w2 AND v1 = v2 AS same,
      len(list_filter(p2[1:q2], lambda x: NOT list_contains(list_concat(p1, w1), x))) > 0 OR q2 > q1 AS a1, len(list_filter(p2[1:q2], lambda x: list_contains(p1[q1 + 1:], x))) > 0 AS a2,
      len(list_filter(w1, lambda x: NOT list_contains(w2, x))) > 0 AND len(list_filter(w2, lambda x: NOT list_contains(w1, x))) > 0 AS a3,
      len(list_filter(p1[1:q1], lambda x: NOT list_contains(list_concat(p2, w2), x))) > 0 OR q2 < q1 AS a4, v1 AND NOT v2 AS a5 FROM t)
    SELECT symbol, CASE WHEN gone THEN 'breaking' WHEN broken THEN 'unknown' WHEN same THEN 'compatible' WHEN a1 OR a2 OR a3 THEN 'breaking' WHEN a4 OR a5 THEN 'risky' ELSE 'compatible' END AS compat_result,
      CASE WHEN gone THEN 'exported_symbol_removed' WHEN broken THEN 'unparseable_shape' WHEN same THEN '' ELSE concat_ws(',', CASE WHEN a1 THEN 'required_arg_added' END, CASE WHEN a2 THEN 'optional_to_required' END,
      CASE WHEN a3 THEN 'kwonly_renamed' END, CASE WHEN a4 THEN 'required_arg_removed' END, CASE WHEN a5 THEN 'varargs_removed' END) END AS rules FROM r"""
)
def shape_compare(spark, sf_dir):
    rows = spark.sql(SHAPES_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    before, after = _shape("n1", "r1", "v1", "k1"), _shape("n2", "r2", "v2", "k2")
    pairs = rows.select(F.col("symbol"), before.alias("before"), F.when(~F.col("gone"), F.when(F.col("broken"), after.withField("param_names", F.lit(None).cast("array<string>"))).otherwise(after)).alias("after"))
    return compat.compare_shapes(pairs).select("symbol", "compat_result", F.array_join("rules", ",").alias("rules"))


POINTS_SQL = "SELECT p_partkey AS qual, nullif(p_partkey % 4, 3) AS head_a, nullif(p_size % 4, 3) AS head_b, nullif(p_partkey % 3, 2) AS base_a, nullif(p_size % 3, 2) AS base_b FROM part"


@query(
    f"""SELECT qual, CASE WHEN head_a IS NOT DISTINCT FROM head_b THEN NULL WHEN head_a IS DISTINCT FROM base_a AND head_b IS DISTINCT FROM base_b THEN 'divergent_definitions'
    WHEN head_a IS NOT DISTINCT FROM base_a AND head_b IS NOT DISTINCT FROM base_b THEN 'rebase_needed' WHEN base_a IS DISTINCT FROM base_b THEN 'unknown_baseline' WHEN base_a IS NULL THEN NULL
    WHEN head_a IS DISTINCT FROM base_a THEN 'contract_delta:a' ELSE 'contract_delta:b' END AS claim FROM ({POINTS_SQL})"""
)
def pair_classification(spark, sf_dir):
    rows = spark.sql(POINTS_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return compat.classify_pairs(rows).select("qual", "claim")


@query("SELECT claim_id, sha1(concat_ws('|', least(base_hash, change_id), greatest(base_hash, change_id), path)) AS fingerprint FROM claim")
def finding_fingerprints(spark, sf_dir):
    return Relations(spark, sf_dir).claim.select("claim_id", compat.finding_fingerprint(F.col("base_hash"), F.col("change_id"), F.col("path")).alias("fingerprint"))


@query(
    """WITH def AS (SELECT 'db/c' || p_partkey || '.sql' AS path, 't' || p_partkey || '.' || unnest(['id', 'name_' || (p_partkey % 5), 'price']) AS contract, true AS creates FROM part UNION ALL SELECT 'db/c' || p_partkey || '.sql', 't' || (p_partkey + 1) || '.extra_' || (p_partkey % 3), false FROM part WHERE p_partkey % 4 = 0
      UNION ALL SELECT 'db/d' || p_partkey || '.sql', 't' || p_partkey || '.id', true FROM part WHERE p_partkey % 10 = 0),
    used AS (SELECT 'app/q' || l_orderkey || '_' || l_linenumber || '.py' AS path, unnest(['t' || l_partkey || '.id', 't' || (l_partkey * 3 + 1) || '.price', 't' || l_partkey || '.name_' || (l_partkey % 5), 't' || (l_partkey * 3 + 1) || '.name_' || (l_partkey % 5), 't' || l_suppkey || '.id', 't' || l_partkey || '.price', 't' || l_partkey || '.extra_' || (l_orderkey % 3)]) AS contract FROM lineitem),
    known AS (SELECT contract, CASE WHEN count(*) FILTER (WHERE creates) > 1 THEN 'ambiguous' END AS reference_status FROM def GROUP BY contract)
    SELECT DISTINCT path AS src, kind, 'column::' || contract AS dst, reference_status FROM (SELECT path, contract, 'alters' AS kind FROM def UNION ALL SELECT path, contract, 'queries' FROM used) m JOIN known USING (contract)"""
)
def sql_column_edges(spark, sf_dir):
    found = columns.mentions_of(components.cut(columns.column_rows(_dealt(spark, sf_dir, "sql_file"))))
    none = spark.createDataFrame([], "substrate string")
    return extract.link_contracts(found, none).select("src", "kind", "dst", "reference_status")


# ---- compatibility of open changes: what their Python files define, import and call ------------------------------


class Compat:
    """What the changed files and the baselines tell, each file read once and one row, with no more of its evidence than a query asks for."""

    def __init__(self, spark, sf_dir, *wanted: str):
        self.r, self.wanted = Relations(spark, sf_dir), wanted
        self.heads = components.cut(calls.file_evidence(self.r.changed_file.select("repo", "change_id", "base", "path", "text"), *wanted))
        self.touched = self.heads.select("repo", "change_id", "base", "path")

    def calls(self) -> DataFrame:
        return calls.file_calls(self.heads.select("change_id", "path", "calls")).select("change_id", "path", "call.*")

    def meeting(self, based: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What candidate_ways and candidate_pairs take; based are the files of the main branch's baseline, with what they load."""
        loads = lambda f, *names: calls.loaded_modules(f.select(*names, "loads")).select(*names, module_stem(F.col("name")).alias("stem"))
        stems = based.select(F.col("path").alias("imported"), path_stem(F.col("path")).alias("stem"))
        links = loads(based, "path").join(stems, "stem").where("path <> imported").select("imported", F.col("path").alias("importer")).distinct()
        impact = self.touched.join(links, F.col("path") == F.col("imported")).select("repo", "change_id", F.col("importer").alias("path"))
        return self.touched, impact, loads(self.heads, "repo", "change_id")

    def main(self) -> DataFrame:
        """The baseline whose graph is the repository's."""
        return components.cut(calls.file_evidence(self.r.based_file.where("base = 'b0'").select("path", "text"), "loads"))

    def claims(self) -> tuple[DataFrame, DataFrame]:
        """The claims, and all files of heads and baselines (version, path) with their evidence."""
        kept = [w for w in self.wanted if w != "calls"]
        based = components.cut(calls.file_evidence(self.r.based_file.select("base", "path", "text"), *kept))
        pairs = compat.candidate_pairs(*self.meeting(based.where("base = 'b0'")))
        both = self.heads.select(F.col("change_id").alias("version"), "path", "lost", *kept).unionByName(based.withColumnRenamed("base", "version"))
        return compat.claims_of_prints(pairs, self.touched, self.touched.select("change_id", "base").distinct(), compat.read_prints(both)), both


SIDES_SQL = """heads AS (SELECT repo, change_id, base, path, f, j, v, s, path LIKE '%.py' AND text IS NOT NULL AND lost = 1 AS lost, path LIKE '%.py' AND text IS NOT NULL AND lost = 0 AS read, text IS NULL AS gone FROM changed_file),
py AS (SELECT * FROM heads WHERE path LIKE '%.py'), pull AS (SELECT * FROM heads WHERE change_id LIKE 'PR-%'),
near AS (SELECT DISTINCT h.repo, h.change_id, b.path FROM py h JOIN based_file b ON b.repo = h.repo AND b.j = h.f AND b.f <> h.f WHERE b.base = 'b0' AND b.path LIKE '%.py'),
ways AS (SELECT a.change_id AS acting, b.change_id AS sibling, 1 AS rank, a.path, NULL AS owner FROM py a JOIN pull b ON a.repo = b.repo AND a.path = b.path
  UNION SELECT a.change_id, b.change_id, 2, NULL, a.change_id FROM near a JOIN pull b ON a.repo = b.repo AND a.path = b.path
  UNION SELECT a.change_id, b.change_id, 2, NULL, b.change_id FROM heads a JOIN near b ON a.repo = b.repo AND a.path = b.path WHERE b.change_id LIKE 'PR-%'
  UNION SELECT a.change_id, b.change_id, 3, b.path, NULL FROM py a JOIN pull b ON a.repo = b.repo AND a.j = b.f WHERE a.read AND b.path LIKE '%.py'
  UNION SELECT a.change_id, b.change_id, 4, a.path, NULL FROM py a JOIN pull b ON a.repo = b.repo AND b.j = a.f WHERE b.read),
offered AS (SELECT acting, sibling, rank, coalesce(w.path, p.path) AS path FROM ways w LEFT JOIN py p ON p.change_id = w.owner WHERE acting <> sibling AND coalesce(w.path, p.path) IS NOT NULL),
paired AS (SELECT DISTINCT acting, sibling, rank, path, CASE rank WHEN 1 THEN 'shared' WHEN 2 THEN 'main_graph' ELSE 'import_scan' END AS via FROM offered QUALIFY rank = min(rank) OVER (PARTITION BY acting, sibling)),
named AS (SELECT DISTINCT change_id, base FROM heads), places AS (SELECT DISTINCT acting, sibling, via, path FROM paired),
four AS (SELECT p.*, a.base AS base_a, b.base AS base_b, x.v AS va, y.v AS vb, x.gone AS gone_a, y.gone AS gone_b, cast(regexp_extract(p.path, 'f([0-9]+)[.]', 1) AS int) % 2 = 0 AS even
  FROM places p JOIN named a ON a.change_id = acting JOIN named b ON b.change_id = sibling LEFT JOIN heads x ON x.change_id = acting AND x.path = p.path LEFT JOIN heads y ON y.change_id = sibling AND y.path = p.path WHERE NOT coalesce(x.lost, false) AND NOT coalesce(y.lost, false)),
runs AS (SELECT *, CASE WHEN base_a = 'b1' AND even THEN 'ab' ELSE 'ab?' END AS ra, CASE WHEN base_b = 'b1' AND even THEN 'ab' ELSE 'ab?' END AS rb FROM four),
marks AS (SELECT acting, sibling, via, path, 'run' AS qual, ra AS ba, rb AS bb, CASE WHEN gone_a THEN NULL ELSE CASE va WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN 'a*m' WHEN 4 THEN 'ab?' ELSE ra END END AS ha, CASE WHEN gone_b THEN NULL ELSE CASE vb WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN 'a*m' WHEN 4 THEN 'ab?' ELSE rb END END AS hb FROM runs
  UNION ALL SELECT acting, sibling, via, path, 'C.make', 'sa', 'sa', CASE WHEN gone_a THEN NULL WHEN va = 4 THEN 'sab' ELSE 'sa' END, CASE WHEN gone_b THEN NULL WHEN vb = 4 THEN 'sab' ELSE 'sa' END FROM runs),
claimed AS (SELECT *, CASE WHEN ha IS NOT DISTINCT FROM hb THEN NULL WHEN ha IS DISTINCT FROM ba AND hb IS DISTINCT FROM bb THEN 'divergent_definitions' WHEN ha IS NOT DISTINCT FROM ba AND hb IS NOT DISTINCT FROM bb THEN 'rebase_needed'
  WHEN ba <> bb THEN 'unknown_baseline' WHEN ha IS DISTINCT FROM ba THEN 'contract_delta:a' ELSE 'contract_delta:b' END AS claim FROM marks)"""


@query(
    """WITH way AS (SELECT * FROM (VALUES (0, '', 'run', 2, '', false), (1, '', 'run', 1, 'b', false), (2, '', 'run', 0, '', true), (3, '', 'run', 1, '', false), (4, '.C', 'make', 2, '', false), (4, '', 'C.make', 2, '', false)) t(s, tail, qual, "positional", keywords, starred))
    SELECT change_id, path, repo || '.d' || (j % 7) || '.f' || j || tail AS module, qual, "positional", keywords, starred FROM changed_file JOIN way USING (s) WHERE path LIKE '%.py' AND text IS NOT NULL AND lost = 0"""
)
def call_expectations(spark, sf_dir):
    r = Relations(spark, sf_dir)
    found = calls.file_calls(calls.file_evidence(r.changed_file.select("change_id", "path", "text"), "calls")).select("change_id", "path", "call.*")
    return found.select("change_id", "path", "module", "qual", "positional", F.array_join("keywords", ",").alias("keywords"), "starred")


@query(f"WITH {SIDES_SQL} SELECT acting, sibling, via, path FROM places")
def compat_candidates(spark, sf_dir):
    c = Compat(spark, sf_dir, "loads")
    return compat.candidate_pairs(*c.meeting(c.main())).select("acting", "sibling", "via", "path").distinct()


@query(
    f"""WITH {SIDES_SQL}, lame AS (SELECT change_id, repo, bool_or(lost) AS lost FROM heads GROUP BY ALL), size AS (SELECT repo, count(*) FILTER (WHERE change_id LIKE 'PR-%') AS pulls, count(*) FILTER (WHERE change_id LIKE 'PR-%' AND lost) AS bad FROM lame GROUP BY repo),
    each AS (SELECT acting, sibling, via, rank FROM paired GROUP BY ALL), sums AS (SELECT acting, count(*) FILTER (WHERE via = 'shared') AS shared, count(*) FILTER (WHERE via = 'main_graph') AS main_graph, count(*) FILTER (WHERE via = 'import_scan') AS import_scan, count(*) FILTER (WHERE lost AND rank < 4) AS settled FROM each JOIN lame ON sibling = change_id GROUP BY acting),
    told AS (SELECT change_id, coalesce(shared, 0) AS shared, coalesce(main_graph, 0) AS main_graph, coalesce(import_scan, 0) AS import_scan, CASE WHEN lost THEN pulls - (change_id LIKE 'PR-%')::INT - coalesce(shared, 0) - coalesce(main_graph, 0) ELSE bad - coalesce(settled, 0) END AS unknown FROM lame JOIN size USING (repo) LEFT JOIN sums ON acting = change_id)
    SELECT *, unknown = 0 AS complete FROM told"""
)
def compat_candidacy(spark, sf_dir):
    c = Compat(spark, sf_dir, "loads")
    return compat.candidacy(c.touched, compat.candidate_ways(*c.meeting(c.main())), c.heads.where("lost").select("change_id"))


@query(f"WITH {SIDES_SQL} SELECT acting, sibling, via, path, qual, claim FROM claimed WHERE claim IS NOT NULL")
def compat_claims(spark, sf_dir):
    return Compat(spark, sf_dir, "loads", "prints").claims()[0].select("acting", "sibling", "via", "path", "qual", "claim")


@query(
    f"""WITH {SIDES_SQL}, deltas AS (SELECT acting, sibling, path, qual, CASE WHEN claim = 'contract_delta:a' THEN acting ELSE sibling END AS producer, CASE WHEN claim = 'contract_delta:a' THEN sibling ELSE acting END AS consumer, ba AS old, CASE WHEN claim = 'contract_delta:a' THEN ha ELSE hb END AS new FROM claimed WHERE claim LIKE 'contract_delta:%')
    SELECT DISTINCT acting, sibling, d.path, qual, producer, consumer, CASE WHEN new IS NULL THEN 'callee_removed' WHEN new = 'a*m' THEN 'missing_required_kwonly' ELSE 'positional_shortfall' END AS mismatch
    FROM deltas d JOIN heads h ON h.change_id = consumer AND h.read AND d.path = h.repo || '/d' || (h.j % 7) || '/f' || h.j || '.py' AND qual = CASE WHEN s = 4 THEN 'C.make' ELSE 'run' END
    WHERE new IS NULL OR (s <> 2 AND (new = 'a*m' OR new = 'sab' OR (new = 'abc' AND (old = 'ab?' OR s <> 3))))"""
)
def consumer_mismatches(spark, sf_dir):
    c = Compat(spark, sf_dir, "loads", "prints", "shapes", "calls")
    claims, files = c.claims()
    used = c.calls().select("change_id", module_stem(F.col("module")).alias("stem"), "qual", "positional", "keywords", "starred")
    points = compat.with_shapes(claims, calls.file_shapes(files.select("version", "path", "shapes")))
    return compat.consumer_mismatches(points, used)


# ---- event log -------------------------------------------------------------------------------------------------

WITHIN = "occurred_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {0} DAY AND occurred_at <= TIMESTAMP '2024-01-31 00:00:00'"


@query(
    f"""SELECT agent, count(*) AS held, count(*) FILTER (WHERE {WITHIN.format(7)}) AS held_recent,
      count(*) FILTER (WHERE EXISTS (SELECT 1 FROM event_log p WHERE p.kind = 'pushed' AND p.agent = e.agent AND p.path <> e.path AND p.occurred_at >= e.occurred_at)) AS steered
    FROM event_log e WHERE kind = 'collision_held' AND counterparty IS DISTINCT FROM agent GROUP BY agent"""
)
def collision_summary(spark, sf_dir):
    return surfaces.collision_summary(Relations(spark, sf_dir).event_log, AS_OF)


@query("SELECT agent AS blocked, counterparty AS holder, path, occurred_at FROM event_log WHERE kind = 'collision_held' AND counterparty IS DISTINCT FROM agent ORDER BY occurred_at DESC, event_id DESC LIMIT 20")
def recent_collisions(spark, sf_dir):
    return surfaces.recent_collisions(Relations(spark, sf_dir).event_log)


@query(
    f"""WITH base AS (SELECT account, count(*) FILTER (WHERE kind IN ('collision_held', 'warned')) AS interventions, count(*) FILTER (WHERE kind IN ('collision_held', 'warned') AND {WITHIN.format(7)}) AS recent FROM event_log GROUP BY account),
    l AS (SELECT * FROM event_log WHERE kind = 'landed'), hit AS (SELECT account, count(*) AS occurred FROM l WHERE EXISTS (SELECT 1 FROM l o WHERE o.account = l.account AND o.path = l.path AND o.agent <> l.agent AND o.occurred_at < l.occurred_at AND o.occurred_at >= l.occurred_at - INTERVAL 14 DAY) GROUP BY account)
    SELECT account, interventions, recent, coalesce(occurred, 0) AS occurred FROM base LEFT JOIN hit USING (account)"""
)
def effect_counters(spark, sf_dir):
    return surfaces.effect_counters(Relations(spark, sf_dir).event_log, AS_OF)


@query(f"SELECT path, count(DISTINCT agent) AS agents FROM event_log WHERE kind = 'landed' AND {WITHIN.format(20)} GROUP BY path HAVING count(DISTINCT agent) >= 2")
def collisions_on_main(spark, sf_dir):
    return surfaces.collisions_on_main(Relations(spark, sf_dir).event_log, AS_OF, 20)


@query(
    f"""SELECT path, count(*) FILTER (WHERE {WITHIN.format(7)}) AS recent, count(*) FILTER (WHERE occurred_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY AND occurred_at <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS prior
    FROM event_log WHERE kind = 'landed' GROUP BY path HAVING recent > 0 OR prior > 0"""
)
def repo_hotspots_recent_prior(spark, sf_dir):
    return surfaces.recent_prior(Relations(spark, sf_dir).event_log, AS_OF, 7)


@query("SELECT path, count(*) AS events, count(DISTINCT agent) AS agents, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM event_log GROUP BY path")
def file_insights(spark, sf_dir):
    return surfaces.file_insights(Relations(spark, sf_dir).event_log)


@query("SELECT path, count(DISTINCT change_id) AS changes FROM claim_history WHERE claimed_at <= TIMESTAMP '2024-01-15 00:00:00' AND claimed_at + INTERVAL 14400 MINUTE > TIMESTAMP '2024-01-15 00:00:00' GROUP BY path HAVING count(DISTINCT change_id) >= 2")
def now_contended(spark, sf_dir):
    return surfaces.now_contended(Relations(spark, sf_dir).claim_history, "2024-01-15 00:00:00", 14400)


@query(
    """WITH c AS (SELECT *, claimed_at + INTERVAL 5760 MINUTE > TIMESTAMP '2024-01-30 00:00:00' AS live FROM claim WHERE claimed_at <= TIMESTAMP '2024-01-30 00:00:00')
    SELECT path, change_id, 'abandoned' AS why FROM c WHERE state = 'active' AND NOT live AND path NOT IN (SELECT path FROM c WHERE state = 'active' AND live)
    UNION ALL SELECT path, change_id, 'starved' FROM c WHERE state = 'waiting' AND claimed_at < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 60 MINUTE"""
)
def stalled_work(spark, sf_dir):
    return surfaces.stalled_work(Relations(spark, sf_dir).claim, "2024-01-30 00:00:00", 5760)


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY change_id, path ORDER BY occurred_at DESC, event_id DESC) AS rn FROM event_log WHERE kind = 'pr_failing'),
    l AS (SELECT change_id, path, max(occurred_at) AS landed_at FROM event_log WHERE kind = 'landed' GROUP BY ALL)
    SELECT change_id, path, occurred_at AS failing_since FROM f LEFT JOIN l USING (change_id, path) WHERE rn = 1 AND (landed_at IS NULL OR landed_at < occurred_at)"""
)
def stuck_changes(spark, sf_dir):
    return surfaces.stuck_changes(Relations(spark, sf_dir).event_log)


DETAIL_SQL = """outcomes AS (SELECT event_id, 'pred=' || CASE event_id % 5 WHEN 0 THEN 'clear' WHEN 1 THEN 'warn' WHEN 2 THEN 'serialize' ELSE 'unknown' END || ';adv=' || CASE event_id % 3 WHEN 0 THEN 'ignored' ELSE 'followed' END
  || ';land=' || CASE event_id % 7 WHEN 0 THEN 'conflicted' WHEN 1 THEN 'reverted' ELSE 'clean' END || ';conf=observed' AS detail FROM event_log WHERE kind = 'landed')"""


def _outcomes(r: Relations) -> DataFrame:
    e = F.col("event_id")
    pred = F.when(e % 5 == 0, "clear").when(e % 5 == 1, "warn").when(e % 5 == 2, "serialize").otherwise("unknown")
    land = F.when(e % 7 == 0, "conflicted").when(e % 7 == 1, "reverted").otherwise("clean")
    detail = F.concat(F.lit("pred="), pred, F.lit(";adv="), F.when(e % 3 == 0, "ignored").otherwise("followed"), F.lit(";land="), land, F.lit(";conf=observed"))
    return r.event_log.where("kind = 'landed'").select("event_id", detail.alias("detail"))


@query(f"WITH {DETAIL_SQL} SELECT regexp_extract(detail, 'pred=([a-z_]+)', 1) AS pred, regexp_extract(detail, 'land=([a-z_]+)', 1) AS land, count(*) AS n FROM outcomes GROUP BY ALL")
def outcome_matrix(spark, sf_dir):
    return surfaces.outcome_matrix(_outcomes(Relations(spark, sf_dir)))


@query(
    f"""WITH {DETAIL_SQL}, p AS (SELECT regexp_extract(detail, 'pred=([a-z_]+)', 1) AS pred, regexp_extract(detail, 'adv=([a-z_]+)', 1) = 'ignored' AS ign, regexp_extract(detail, 'land=([a-z_]+)', 1) IN ('conflicted', 'reverted') AS bad FROM outcomes)
    SELECT pred, count(*) AS n, count(*) FILTER (WHERE ign) AS ignored, count(*) FILTER (WHERE ign AND bad) AS bad_when_ignored, count(*) FILTER (WHERE pred = 'clear' AND bad) AS silent_misses FROM p GROUP BY pred"""
)
def ignored_advice_rate(spark, sf_dir):
    return surfaces.ignored_advice(_outcomes(Relations(spark, sf_dir)))


@query("SELECT change_id, arg_min(event_id, (occurred_at, event_id)) AS event_id, min(occurred_at) AS occurred_at FROM event_log WHERE kind = 'warned' GROUP BY change_id")
def first_predictions(spark, sf_dir):
    return surfaces.first_predictions(Relations(spark, sf_dir).event_log)


@query(f"SELECT count(DISTINCT agent) AS seats FROM (SELECT agent FROM event_log WHERE {WITHIN.format(5)} UNION SELECT agent FROM claim_history WHERE {WITHIN.format(5).replace('occurred_at', 'claimed_at')}) WHERE agent NOT LIKE '%[bot]'")
def seat_count(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return surfaces.seat_count(r.event_log, r.claim_history, AS_OF, 5)


@query("SELECT account, count(*) AS events, count(DISTINCT path) AS paths, count(*) * 100.0::DOUBLE / 1500 AS share, count(*) > 1500 AS over FROM event_log GROUP BY account")
def account_cost(spark, sf_dir):
    return surfaces.account_cost(Relations(spark, sf_dir).event_log, 1500).withColumn("share", F.col("share").cast("double"))


@query(
    """WITH f AS (SELECT account, count(DISTINCT path) AS files FROM event_log GROUP BY account), l AS (SELECT account, CASE account WHEN 'acct0' THEN 10 WHEN 'acct1' THEN count(*) * 3 // 4 WHEN 'acct2' THEN count(*) * 3 END AS file_limit FROM event_log WHERE account <> 'acct5' GROUP BY account)
    SELECT account, files, file_limit, greatest(coalesce(files - file_limit, 0), 0) AS over_by, coalesce(files * 5 >= file_limit * 4 AND files <= file_limit, false) AS near FROM f LEFT JOIN l USING (account)"""
)
def account_coverage(spark, sf_dir):
    log = Relations(spark, sf_dir).event_log
    n = F.count("*")
    limit = F.when(F.col("account") == "acct0", 10).when(F.col("account") == "acct1", F.floor(n * 3 / 4)).when(F.col("account") == "acct2", n * 3)
    return surfaces.coverage(log, log.where("account <> 'acct5'").groupBy("account").agg(limit.cast("long").alias("file_limit")))


@query(
    """WITH f AS (SELECT account, agent, min(occurred_at) AS s FROM event_log WHERE kind = 'pushed' GROUP BY ALL), t AS (SELECT f.account, f.agent, min(e.occurred_at) AS l, any_value(s) AS s FROM f JOIN event_log e ON e.account = f.account AND e.agent = f.agent AND e.kind = 'landed' AND e.occurred_at >= s GROUP BY ALL)
    SELECT account, count(*) AS n, quantile_cont(secs::DOUBLE, 0.5) AS p50, quantile_cont(secs::DOUBLE, 0.9) AS p90 FROM (SELECT account, epoch(date_trunc('second', l)) - epoch(date_trunc('second', s)) AS secs FROM t) GROUP BY account"""
)
def activation_latency_percentiles(spark, sf_dir):
    return surfaces.activation_latency(Relations(spark, sf_dir).event_log)


STAGES_SQL = """living AS (SELECT account, min(created_at) AS installed_at FROM install WHERE NOT revoked GROUP BY account),
started AS (SELECT account, repo, max(activated_at) AS start FROM activation GROUP BY ALL),
fenced AS (SELECT c.* FROM act c LEFT JOIN started s USING (account, repo) WHERE NOT EXISTS (SELECT 1 FROM tombstone t WHERE t.account = c.account AND t.repo = c.repo) AND (start IS NULL OR acted_at >= start)),
moved AS (SELECT * FROM fenced WHERE kind IN ('warn_issued', 'collision_held') OR (kind = 'claim' AND change_id LIKE 'PR-%')),
ones AS (SELECT account, repo, min(acted_at) AS one FROM moved GROUP BY ALL), twos AS (SELECT m.account, m.repo, min(m.acted_at) AS two FROM moved m JOIN ones o ON m.account = o.account AND m.repo = o.repo AND m.acted_at > o.one GROUP BY ALL),
back AS (SELECT DISTINCT account FROM ones JOIN twos USING (account, repo) WHERE two <= one + INTERVAL 7 DAY), span AS (SELECT account, min(acted_at) AS first_at, max(acted_at) AS last_at FROM moved GROUP BY account),
prs AS (SELECT account, min(acted_at) AS first_pr FROM fenced WHERE kind = 'claim' AND change_id LIKE 'PR-%' GROUP BY account), sigs AS (SELECT account, count(*) FILTER (WHERE kind = 'warn_issued') AS warns, count(*) FILTER (WHERE kind = 'collision_held') AS serializes FROM moved GROUP BY account),
checks AS (SELECT account, acted_at AS first_check, CASE WHEN detail IN ('clear', 'heads_up', 'wait_in_line', 'paused') THEN detail ELSE 'unknown' END AS signal FROM fenced WHERE kind = 'check_published' AND change_id LIKE 'PR-%' QUALIFY row_number() OVER (PARTITION BY account ORDER BY acted_at, coalesce(detail, '')) = 1),
stage AS (SELECT account, installed_at, EXISTS (SELECT 1 FROM activation v WHERE v.account = living.account AND NOT EXISTS (SELECT 1 FROM tombstone t WHERE t.account = v.account AND t.repo = v.repo)) AS selected, first_pr, first_check, signal, coalesce(warns, 0) AS warns, coalesce(serializes, 0) AS serializes,
  account IN (SELECT account FROM back) AS repeated, first_at, last_at, greatest(epoch(first_pr) - epoch(installed_at), 0)::BIGINT AS to_pr, greatest(epoch(first_check) - epoch(installed_at), 0)::BIGINT AS to_check, greatest(epoch(first_check) - epoch(first_pr), 0)::BIGINT AS pr_to_check
  FROM living LEFT JOIN prs USING (account) LEFT JOIN checks USING (account) LEFT JOIN sigs USING (account) LEFT JOIN span USING (account)),
gaps AS (SELECT * REPLACE (CASE WHEN first_pr IS NULL THEN NULL ELSE to_pr END AS to_pr, CASE WHEN first_check IS NULL THEN NULL ELSE to_check END AS to_check, CASE WHEN first_pr IS NULL OR first_check IS NULL THEN NULL ELSE pr_to_check END AS pr_to_check) FROM stage)"""
LATENCY_SQL = ", ".join(f"count({c}) AS {c}_n, round(quantile_cont({c}::DOUBLE, 0.5))::BIGINT AS {c}_p50, round(quantile_cont({c}::DOUBLE, 0.9))::BIGINT AS {c}_p90" for c in ("to_pr", "to_check", "pr_to_check"))


def _stages(r: Relations) -> DataFrame:
    return components.cut(funnel.activation_stages(r.install, r.activation, r.tombstone, r.act))


@query(f"WITH {STAGES_SQL} SELECT * FROM gaps")
def activation_stages(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return funnel.activation_stages(r.install, r.activation, r.tombstone, r.act)


@query(
    f"""WITH {STAGES_SQL} SELECT (SELECT count(*) FROM install) AS installs_total, (SELECT count(*) FROM install WHERE NOT revoked) AS installs_live, count(*) AS live_accounts, count(*) FILTER (WHERE account NOT IN (SELECT account FROM own_account)) AS external_accounts,
    count(*) FILTER (WHERE account IN (SELECT account FROM own_account)) AS owner_accounts, count(*) FILTER (WHERE selected) AS a2_selected_repo, count(first_pr) AS a3_first_pr, count(first_check) AS a4_first_check, count(*) FILTER (WHERE warns + serializes > 0) AS a5_first_signal,
    count(*) FILTER (WHERE repeated) AS a9_repeat_7d, count(*) FILTER (WHERE signal = 'clear') AS a4_clear, count(*) FILTER (WHERE signal = 'heads_up') AS a4_heads_up, count(*) FILTER (WHERE signal = 'wait_in_line') AS a4_wait_in_line, count(*) FILTER (WHERE signal = 'paused') AS a4_paused,
    count(*) FILTER (WHERE signal = 'unknown') AS a4_unknown, sum(warns)::BIGINT AS warns, sum(serializes)::BIGINT AS serializes, {LATENCY_SQL}, count(*) FILTER (WHERE to_pr < 3600) AS under_1h, count(*) FILTER (WHERE to_pr >= 3600 AND to_pr < 86400) AS h1_to_1d,
    count(*) FILTER (WHERE to_pr >= 86400 AND to_pr < 604800) AS d1_to_7d, count(*) FILTER (WHERE to_pr >= 604800) AS over_7d, min(first_at) AS first_at, max(last_at) AS last_at FROM gaps"""
)
def activation_funnel(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return funnel.activation_funnel(_stages(r), r.install, r.own_account)


@query(
    """WITH last AS (SELECT account, detail FROM act WHERE kind = 'human_judgment' AND account IN (SELECT account FROM install WHERE NOT revoked) QUALIFY row_number() OVER (PARTITION BY account, repo, change_id ORDER BY acted_at DESC, coalesce(detail, '') DESC) = 1)
    SELECT nullif(regexp_extract(detail, 'judgment=([a-z-]+)', 1), '') AS judgment, nullif(regexp_extract(detail, 'action=([a-z-]+)', 1), '') AS action, count(*) AS total, count(*) FILTER (WHERE account NOT IN (SELECT account FROM own_account)) AS external
    FROM last WHERE detail LIKE '%judgment=%' GROUP BY 1, 2"""
)
def human_judgments(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return funnel.judgments(r.act, _stages(r), r.own_account)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY account, agent ORDER BY occurred_at, event_id) AS rn FROM event_log), p AS (SELECT account, agent, min(occurred_at) FILTER (WHERE rn = 1) AS one, min(occurred_at) FILTER (WHERE rn = 2) AS two FROM r GROUP BY ALL)
    SELECT account, count(*) AS agents, count(*) FILTER (WHERE two <= one + INTERVAL 1 DAY) AS repeated FROM p GROUP BY account"""
)
def repeat_within_1d(spark, sf_dir):
    return surfaces.repeat_within(Relations(spark, sf_dir).event_log, 1)


@query("SELECT event_id, kind FROM event_log WHERE kind NOT IN ('pushed', 'warned') OR (kind = 'pushed' AND occurred_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) OR (kind = 'warned' AND occurred_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY)")
def retention_prune(spark, sf_dir):
    return surfaces.retention_prune(Relations(spark, sf_dir).event_log, AS_OF, {"pushed": 7, "warned": 14}).select("event_id", "kind")


@query("SELECT event_id, account FROM event_log WHERE account <> 'acct4' AND (account <> 'acct1' OR occurred_at >= TIMESTAMP '2024-01-10 00:00:00')")
def generation_filter(spark, sf_dir):
    bounds = spark.sql("SELECT 'acct1' AS account, timestamp_ntz'2024-01-10 00:00:00' AS active_from")
    return surfaces.generation_filter(Relations(spark, sf_dir).event_log, bounds, spark.sql("SELECT 'acct4' AS account"), "account", "occurred_at").select("event_id", "account")


@query("SELECT account, path, date_trunc('day', occurred_at) AS batch, arg_max(event_id, (occurred_at, event_id)) AS event_id, count(*) - 1 AS skipped, count(*) > 1 AS \"full\" FROM event_log WHERE kind = 'pushed' GROUP BY ALL")
def push_coalesce(spark, sf_dir):
    pushes = Relations(spark, sf_dir).event_log.where("kind = 'pushed'")
    return surfaces.push_coalesce(pushes, ["account", "path"], F.date_trunc("day", "occurred_at").cast("timestamp_ntz"))


@query("SELECT agent, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'waiting') AS waiting, coalesce(string_agg(DISTINCT CASE WHEN state = 'active' THEN path END, ',' ORDER BY CASE WHEN state = 'active' THEN path END), '') AS paths FROM claim GROUP BY agent")
def board(spark, sf_dir):
    return surfaces.board(Relations(spark, sf_dir).claim)


@query("SELECT DISTINCT path FROM event_log WHERE path > 'src/m3/' ORDER BY path LIMIT 21")
def keyset_page(spark, sf_dir):
    return surfaces.page(Relations(spark, sf_dir).event_log.select("path").distinct(), "path", "src/m3/", 20)


# ---- routes, imports, contracts from paths ---------------------------------------------------------------------

HREF_SQL = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), urls AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS route FROM pages)"""
NORM_SQL = r"""lower(regexp_replace(CASE WHEN length(s) > 1 THEN regexp_replace(s, '/+$', '') ELSE s END, '/{2,}', '/', 'g'))"""
STEPS_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '[?#](.|\n)*$', '')), '\$\{[^}]*\}', '{}', 'g'), ':[A-Za-z_]\w*', '{}', 'g'), '\{[^}]*\}', '{}', 'g'), '<[^>]*>', '{}', 'g'), '\[\.\.\.[^\]]*\]', '{}', 'g'), '\[[^\]]*\]', '{}', 'g'), '\(\?[^)]*\)|\(\.\*\)|\^|\$', '', 'g')"""
RAW_SQL = r"""raw AS (SELECT DISTINCT page_id, x FROM (SELECT page_id, route || CASE page_id % 4 WHEN 0 THEN '/{id}' WHEN 1 THEN '/:id/edit' WHEN 2 THEN '//items/<int:k>/' ELSE '?a=1' END AS x FROM urls) y),
norm AS (SELECT page_id, x, CASE WHEN x IS NULL OR x = '' THEN '' ELSE """ + NORM_SQL + r""" END AS route FROM (SELECT page_id, x, CASE WHEN t LIKE '/%' THEN t ELSE '/' || t END AS s FROM (SELECT page_id, x, """ + STEPS_SQL + r""" AS t FROM raw)))"""


def _raw_routes(r: Relations) -> DataFrame:
    i = F.col("page_id") % 4
    tail = F.when(i == 0, "/{id}").when(i == 1, "/:id/edit").when(i == 2, "//items/<int:k>/").otherwise("?a=1")
    return r.table("pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), tail).alias("x")).distinct()


@query(f"WITH {HREF_SQL}, {RAW_SQL} SELECT page_id, x, route FROM norm")
def route_normalize(spark, sf_dir):
    return _raw_routes(Relations(spark, sf_dir)).select("page_id", "x", routes.normalize_route(F.col("x")).alias("route"))


SPECIFIC_SQL = f"""(route <> '' AND route NOT IN ({", ".join(f"'{u}'" for u in v.UBIQUITOUS_ROUTES)}) AND ((len(list_filter(string_split(route, '/'), lambda s: s <> '')) >= 2 AND list_filter(string_split(route, '/'), lambda s: s <> '')[1] <> '{{}}')
  OR (len(list_filter(string_split(route, '/'), lambda s: s <> '')) = 1 AND contains(route, '{{}}') AND route <> '/{{}}')))"""


@query(f"WITH {HREF_SQL}, {RAW_SQL} SELECT page_id, route, {SPECIFIC_SQL} AS specific FROM norm")
def route_specific(spark, sf_dir):
    rows = _raw_routes(Relations(spark, sf_dir)).select("page_id", routes.normalize_route(F.col("x")).alias("route"))
    return rows.select("page_id", "route", routes.is_specific(F.col("route")).alias("specific"))


SIDES_SQL = """defined AS (SELECT DISTINCT 'api/' || CASE WHEN length(split_part(p_name, ' ', 1)) % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 's' || (p_partkey % 40) END || '.py' AS path, '/api/' || split_part(p_name, ' ', 1) || '/{}/' || split_part(p_name, ' ', 2) AS route FROM part WHERE p_partkey % 2 = 0),
requested AS (SELECT DISTINCT 'web/c' || (p_partkey % 50) || '.ts' AS path, CASE p_partkey % 3 WHEN 0 THEN '/' ELSE '/v2/api/' END || split_part(p_name, ' ', 1) || '/' || (p_partkey % 9) || '/' || split_part(p_name, ' ', 2) AS route FROM part WHERE p_partkey % 2 = 1)"""
ALIGN_SQL = """len(a) = len(b) AND len(list_filter(list_zip(a, b), lambda z: NOT (z[1] = z[2] OR z[1] = '{}' OR z[2] = '{}'))) = 0 AND len(list_filter(list_zip(a, b), lambda z: z[1] = z[2] AND z[1] <> '{}')) > 0"""
MATCH_SQL = f"""{SIDES_SQL}, sides2 AS (SELECT d.path AS definer, q.path AS requester, d.route, q.route AS url, list_filter(string_split(d.route, '/'), lambda s: s <> '') AS ds, list_filter(string_split(q.route, '/'), lambda s: s <> '') AS qs FROM defined d CROSS JOIN requested q),
tails AS (SELECT *, CASE WHEN len(ds) <= len(qs) THEN ds ELSE ds[len(ds) - len(qs) + 1:] END AS a, CASE WHEN len(qs) <= len(ds) THEN qs ELSE qs[len(qs) - len(ds) + 1:] END AS b FROM sides2 WHERE len(ds) = len(qs) OR least(len(ds), len(qs)) >= 2),
matched AS (SELECT definer, requester, route, url FROM tails WHERE {ALIGN_SQL} AND ds[1] <> '{{}}' AND len(ds) >= 2 AND len(qs) >= 2)"""


def _route_sides(r: Relations) -> tuple[DataFrame, DataFrame]:
    part = r.table("part")
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    k = F.col("p_partkey")
    defined = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("api/"), F.when(F.length(word(0)) % 2 == 0, word(0)).otherwise(F.concat(F.lit("s"), k % 40)), F.lit(".py")).alias("path"), F.concat(F.lit("/api/"), word(0), F.lit("/{}/"), word(1)).alias("route")).distinct()
    start = F.when(k % 3 == 0, "/").otherwise("/v2/api/")
    asked = part.where("p_partkey % 2 = 1").select(F.concat(F.lit("web/c"), k % 50, F.lit(".ts")).alias("path"), F.concat(start, word(0), F.lit("/"), k % 9, F.lit("/"), word(1)).alias("route")).distinct()
    return defined, asked


@query(f"WITH {MATCH_SQL} SELECT * FROM matched")
def route_match(spark, sf_dir):
    return routes.match_pairs(*_route_sides(Relations(spark, sf_dir)))


@query(f"WITH {MATCH_SQL} SELECT definer, requester, route, url, count(DISTINCT definer) OVER (PARTITION BY url) = 1 AS sure FROM matched")
def route_single_definer(spark, sf_dir):
    return routes.single_definer(routes.match_pairs(*_route_sides(Relations(spark, sf_dir))))


@query(
    f"""WITH {SIDES_SQL}, r AS (SELECT DISTINCT route, list_filter(string_split(route, '/'), lambda s: s <> '') AS s FROM (SELECT route FROM defined UNION SELECT route || '/{{}}' FROM requested)),
    c AS (SELECT route, s[1:list_max(list_filter(range(1, len(s) + 1), lambda i: s[i] <> '{{}}'))] AS core FROM r),
    k AS (SELECT route, core, unnest(list_filter(range(1, len(core)), lambda i: core[i] <> '{{}}')[1:5]) AS i FROM c) SELECT route, array_to_string(core[i:], '/') AS key FROM k"""
)
def route_suffix_keys(spark, sf_dir):
    defined, asked = _route_sides(Relations(spark, sf_dir))
    rows = defined.select("route").union(asked.select(F.concat("route", F.lit("/{}")))).distinct()
    return rows.select("route", F.explode(routes.suffix_keys(F.col("route"))).alias("key"))


IMPORTS_SQL = f"""files AS (SELECT path, language AS family FROM file_node),
asked AS (SELECT src, CASE WHEN n % 4 = 0 THEN './' || regexp_replace(regexp_replace(dst, '^.*/', ''), '\\.[a-z]+$', '') WHEN n % 8 = 1 THEN regexp_replace(regexp_replace(dst, '^.*/', ''), '\\.[a-z]+$', '') WHEN n % 4 = 1 THEN replace(regexp_replace(dst, '\\.[a-z]+$', ''), '/', '.') WHEN n % 4 = 2 THEN '@/' || dst ELSE 'lib' || n END AS module, language AS family
  FROM (SELECT src, dst, length(src) + length(dst) * 3 AS n FROM import_edge) e JOIN file_node ON path = src)"""


def _asked(r: Relations) -> DataFrame:
    n = F.length("src") + F.length("dst") * 3
    stem = F.regexp_replace("dst", r"\.[a-z]+$", "")
    module = F.when(n % 4 == 0, F.concat(F.lit("./"), F.regexp_replace(stem, "^.*/", ""))).when(n % 8 == 1, F.regexp_replace(stem, "^.*/", "")).when(n % 4 == 1, F.translate(stem, "/", ".")).when(n % 4 == 2, F.concat(F.lit("@/"), F.col("dst"))).otherwise(F.concat(F.lit("lib"), n))
    asked = resolve.meet(r.import_edge, r.file_node.withColumnRenamed("path", "src"), ["src"])
    return asked.select("src", module.alias("module"), F.col("language").alias("family"))


@query(
    rf"""WITH {IMPORTS_SQL}, q AS (SELECT DISTINCT src, module, family, module LIKE './%' AS rel, module LIKE '@/%' AS loc FROM asked),
    t AS (SELECT *, CASE WHEN rel THEN regexp_replace(src, '/[^/]*$', '') || substr(module, 2) WHEN loc THEN substr(module, 3) ELSE replace(module, '.', '/') END AS target FROM q),
    endings AS (SELECT path, family, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '/'))) AS ending, unnest(range(1, len(p) + 1)) AS i FROM (SELECT path, family, string_split(regexp_replace(path, '\.[a-z]+$', ''), '/') AS p FROM files)),
    cand AS (SELECT t.*, f.path, 0 AS rank FROM t JOIN files f ON f.path = t.target
      UNION SELECT t.*, f.path, 1 FROM t JOIN endings f ON f.family = t.family AND ending = CASE WHEN rel THEN target ELSE regexp_replace(target, '\.[a-z]+$', '') END WHERE NOT rel OR i = 1),
    c AS (SELECT * FROM cand WHERE path <> src), best AS (SELECT src, module, min(rank) AS r, bool_and(path LIKE 'tests/%') AS tt FROM c GROUP BY ALL),
    kept AS (SELECT DISTINCT c.src, c.module, c.path FROM c JOIN best b ON b.src = c.src AND b.module = c.module AND c.rank = b.r AND (c.path LIKE 'tests/%') = b.tt),
    n AS (SELECT src, module, count(*) AS n FROM kept GROUP BY ALL)
    SELECT src, module, path AS dst, CASE WHEN n > 1 THEN 'ambiguous' END AS reference_status FROM kept JOIN n USING (src, module) WHERE n <= 8
    UNION ALL SELECT src, module, module, 'ambiguous' FROM n WHERE n > 8
    UNION ALL SELECT src, module, module, CASE WHEN rel OR loc THEN 'unresolved' END FROM q WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.src = q.src AND n.module = q.module)"""
)
def import_suffix_resolve(spark, sf_dir):
    r = Stored(spark, sf_dir)
    return resolve.resolve_imports(_asked(r), r.file_node.select("path", F.col("language").alias("family")))


@query(
    rf"""WITH f AS (SELECT DISTINCT language AS family, regexp_extract(path, '/p(\d+)\.', 1)::BIGINT AS k, 'p' || floor(sqrt(regexp_extract(path, '/p(\d+)\.', 1)::BIGINT))::BIGINT AS stem FROM file_node)
    SELECT family, stem, count(*) AS n, CASE WHEN count(*) > {v.MAX_BARE_FANOUT} THEN 'raw' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'resolved' END AS fate FROM f GROUP BY ALL"""
)
def bare_fanout_cap(spark, sf_dir):
    """Bare imports of every stem: one raw edge, several ambiguous ones or one resolved. A stem's files grow with the root of the key."""
    r = Relations(spark, sf_dir)
    key = F.regexp_extract("path", r"/p(\d+)\.", 1).cast("long")
    stem = F.concat(F.lit("p"), F.floor(F.sqrt("k")))
    rows = r.file_node.select(F.col("language").alias("family"), key.alias("k")).distinct().select("family", stem.alias("stem"), F.concat(F.lit("src/m"), "k", F.lit("/"), stem, F.lit(".py")).alias("path"))
    n = rows.groupBy("family", "stem").agg(F.count("*").alias("n"))
    asked = n.select(F.concat(F.lit("main/"), "family").alias("src"), F.col("stem").alias("module"), "family")
    raw = F.bool_or(F.col("dst") == F.col("module"))
    edges = resolve.resolve_imports(asked, rows.select("path", "family")).groupBy("src", "module").agg(F.when(raw, "raw").when(F.bool_or(F.col("reference_status") == "ambiguous"), "ambiguous").otherwise("resolved").alias("fate"))
    fates = edges.select(F.substring("src", 6, 1000).alias("family"), F.col("module").alias("stem"), "fate")
    return n.join(fates, ["family", "stem"]).select("family", "stem", "n", "fate")


@query(
    f"""WITH f AS (SELECT CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.ts' END AS ext, split_part(p_name, ' ', 2) AS word, floor(sqrt(p_partkey))::BIGINT AS r, p_partkey AS k FROM part WHERE p_partkey % 4 <> 2),
    s AS (SELECT 'sibling_stem::' || CASE ext WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' ELSE 'web' END || '::src::' || word || '-' || r AS contract,
      'src/' || CASE k % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END || '/x' || k || '/' || word || '_' || r || CASE WHEN k % 5 = 0 THEN '.service' ELSE '' END || ext AS path FROM f)
    SELECT contract, path FROM s WHERE contract IN (SELECT contract FROM s GROUP BY contract HAVING count(*) BETWEEN 2 AND {v.MAX_GROUP_FILES})"""
)
def sibling_stem_groups(spark, sf_dir):
    """One file per part; a stem is a word of its name and the root of its key, so that groups grow with the table, past the cap."""
    part, k = Relations(spark, sf_dir).table("part"), F.col("p_partkey")
    place = F.when(k % 4 == 0, "alpha").when(k % 4 == 1, "beta").when(k % 4 == 2, "docs").otherwise("gamma")
    ext = F.when(F.col("p_size") % 3 == 0, ".py").when(F.col("p_size") % 3 == 1, ".go").otherwise(".ts")
    stem = F.concat(F.get(F.split("p_name", " "), F.lit(1)), F.lit("_"), F.floor(F.sqrt(k)))
    files = part.select(F.concat(F.lit("src/"), place, F.lit("/x"), k, F.lit("/"), stem, F.when(k % 5 == 0, ".service").otherwise(""), ext).alias("path")).distinct()
    return contracts.sibling_stems(files)


@query(
    f"""WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) || 's' AS b, 'feat' || floor(sqrt(p_partkey))::BIGINT AS c, CASE p_size % 2 WHEN 0 THEN '.tsx' ELSE '.vue' END AS ext FROM part WHERE p_partkey % 3 < 2),
    f AS (SELECT k % 3 AS role, 'frontend/src/' || CASE k % 3 WHEN 0 THEN 'pages' ELSE 'components' END || '/x' || k || '/' || a || '_' || b || '_' || c || ext AS path, unnest([a, b, c]) AS raw FROM p),
    t AS (SELECT DISTINCT path, role, CASE WHEN raw LIKE '%ies' AND length(raw) > 4 THEN left(raw, -3) || 'y' WHEN raw LIKE '%ses' AND length(raw) > 4 THEN left(raw, -2) WHEN raw LIKE '%s' AND raw NOT LIKE '%ss' AND length(raw) > 4 THEN left(raw, -1) ELSE raw END AS token FROM f),
    u AS (SELECT * FROM t WHERE length(token) >= 4 AND token NOT IN ({", ".join(f"'{x}'" for x in v.ROLE_TOKEN_STOP)})), g AS (SELECT token FROM u GROUP BY token HAVING count(DISTINCT role) = 2 AND count(DISTINCT path) <= 30)
    SELECT DISTINCT 'role_feature::web_frontend::frontend::src::components__pages::' || token AS contract, path FROM u JOIN g USING (token)"""
)
def role_feature_pairs(spark, sf_dir):
    """One file per part; beside two words of its name, a token of the root of its key, whose files grow with the table, past the cap."""
    part, k = Relations(spark, sf_dir).table("part"), F.col("p_partkey")
    role = F.when(k % 3 == 0, "pages").when(k % 3 == 1, "components").otherwise("hooks")
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    ext = F.when(F.col("p_size") % 2 == 0, ".tsx").otherwise(".vue")
    stem = F.concat(word(0), F.lit("_"), word(1), F.lit("s_feat"), F.floor(F.sqrt(k)))
    files = part.select(F.concat(F.lit("frontend/src/"), role, F.lit("/x"), k, F.lit("/"), stem, ext).alias("path")).distinct()
    return contracts.role_features(files, most=30)


@query(
    r"""WITH dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir, path AS dst FROM go_file WHERE path LIKE '%.go' AND path NOT LIKE '%\_test.go' ESCAPE '\'),
    names AS (SELECT module, string_split(module, '/') AS p FROM (SELECT DISTINCT module FROM go_import WHERE module LIKE '%/%')),
    ends AS (SELECT module, unnest(range(1, len(p) + 1)) AS i, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '/'))) AS dir FROM names),
    found AS (SELECT module, arg_min(dir, i) AS dir FROM ends WHERE dir IN (SELECT dir FROM dirs) GROUP BY module)
    SELECT src, module, dst, NULL::VARCHAR AS reference_status FROM go_import JOIN found USING (module) JOIN dirs USING (dir) WHERE src <> dst
    UNION ALL SELECT src, module, module, NULL FROM go_import WHERE module NOT IN (SELECT module FROM found)"""
)
def go_package_resolve(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return packages.go_packages(r.go_import, r.go_file)


@query(
    rf"""WITH own AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path AS dst FROM cs_file WHERE NOT regexp_matches(lower(path), '(^|/)(tests?|specs?|__tests__|examples?)/')),
    dots AS (SELECT DISTINCT dir, replace(dir, '/', '.') AS name FROM own), names AS (SELECT DISTINCT module FROM cs_import WHERE module LIKE '%.%'),
    tries AS (SELECT module, module AS space, NULL AS type FROM names UNION ALL SELECT module, regexp_replace(module, '\.[^.]*$', ''), regexp_extract(module, '([^.]*)$', 1) FROM names WHERE regexp_replace(module, '\.[^.]*$', '') LIKE '%.%'),
    ends AS (SELECT dir, i = 1 AS exact, array_to_string(p[i:], '.') AS space FROM (SELECT dir, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT dir, string_split(name, '.') AS p FROM dots))),
    spots AS (SELECT module, type, dir, exact, bool_or(exact) OVER (PARTITION BY module, type) AS any_exact FROM tries JOIN ends USING (space)),
    hits AS (SELECT module, type, dir, dst FROM spots JOIN own USING (dir) WHERE exact = any_exact AND (type IS NULL OR regexp_replace(dst, '^.*/', '') = type || '.cs')),
    kept AS (SELECT * FROM hits h WHERE type IS NULL OR NOT EXISTS (SELECT 1 FROM hits g WHERE g.module = h.module AND g.type IS NULL)),
    n AS (SELECT module, count(DISTINCT dir) AS dirs, count(DISTINCT dst) AS n FROM kept GROUP BY module)
    SELECT DISTINCT src, module, dst, CASE WHEN dirs > 1 THEN 'ambiguous' END AS reference_status FROM cs_import JOIN n USING (module) JOIN kept USING (module) WHERE src <> dst AND (dirs = 1 OR n <= {v.MAX_BARE_FANOUT})
    UNION ALL SELECT src, module, module, 'ambiguous' FROM cs_import JOIN n USING (module) WHERE dirs > 1 AND n > {v.MAX_BARE_FANOUT}
    UNION ALL SELECT src, module, module, NULL FROM cs_import WHERE module NOT IN (SELECT module FROM n)"""
)
def csharp_namespace_resolve(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return packages.csharp_namespaces(r.cs_import, r.cs_file)


@query(
    rf"""WITH stems AS (SELECT path AS dst, regexp_replace(path, '\.[A-Za-z0-9]+$', '') AS key FROM ws_file), names AS (SELECT module, string_split(module, '/') AS p FROM (SELECT DISTINCT module FROM ws_import)),
    pre AS (SELECT module, i, array_to_string(p[1:i], '/') AS name, array_to_string(p[i + 1:], '/') AS rest FROM (SELECT module, p, unnest(range(1, len(p) + 1)) AS i FROM names)),
    known AS (SELECT module, root, rest FROM (SELECT *, max(i) OVER (PARTITION BY module) AS most FROM pre JOIN ws_package USING (name)) WHERE i = most),
    base AS (SELECT module, rest, root || '/src' AS b, 1 AS place FROM known UNION ALL SELECT module, rest, root, 2 FROM known),
    keys AS (SELECT module, b || '/' || rest AS key, 0 AS rank FROM base WHERE rest <> '' UNION ALL SELECT module, b || '/' || rest || '/index', 0 FROM base WHERE rest <> '' UNION ALL SELECT module, b || '/index', place FROM base WHERE rest = ''),
    hits AS (SELECT module, dst FROM (SELECT module, dst, rank, min(rank) OVER (PARTITION BY module) AS least FROM keys JOIN stems USING (key)) WHERE rank = least), n AS (SELECT module, count(DISTINCT dst) AS n FROM hits GROUP BY module)
    SELECT DISTINCT src, module, dst, CASE WHEN n > 1 THEN 'ambiguous' END AS reference_status FROM ws_import JOIN n USING (module) JOIN hits USING (module) WHERE src <> dst AND n <= {v.MAX_BARE_FANOUT}
    UNION ALL SELECT src, module, module, 'ambiguous' FROM ws_import JOIN n USING (module) WHERE n > {v.MAX_BARE_FANOUT}
    UNION ALL SELECT src, module, module, CASE WHEN module IN (SELECT module FROM known) THEN 'unresolved' END FROM ws_import WHERE module NOT IN (SELECT module FROM n)"""
)
def workspace_resolve(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return packages.workspace_imports(r.ws_import, r.ws_package, r.ws_file)


# ---- graph store ------------------------------------------------------------------------------------------------

PATCHED_SQL = """old AS (SELECT regexp_extract(src, 'm([0-9]+)/', 1) AS c, src, dst, 'imports' AS kind, reference_status FROM import_edge),
one AS (SELECT * FROM old WHERE length(src) % 4 <> 0 AND length(dst) % 9 <> 0 AND length(src) % 9 <> 0 UNION ALL SELECT c, src, dst || '.new', kind, reference_status FROM old WHERE length(src) % 4 = 0 AND length(src) % 9 <> 0),
two AS (SELECT * FROM one WHERE c::INT % 2 = 1 OR length(src) % 5 <> 0 UNION ALL SELECT c, src, dst || '.two', kind, reference_status FROM old WHERE c::INT % 2 = 0 AND length(src) % 5 = 0)"""


@query(f"WITH {PATCHED_SQL} SELECT c AS coordinate, src, dst, kind, reference_status, (2 + CASE WHEN c::INT % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS revision FROM two")
def graph_store_patches(spark, sf_dir):
    """Every repository's graph ingested, an older one refused, patched, the patch sent again, one on a wrong base refused, and half of them patched again."""
    repo = lambda c: F.regexp_extract(c, "m([0-9]+)/", 1).alias("coordinate")
    edges = components.cut(Relations(spark, sf_dir).import_edge.select(repo("src"), "src", "dst", F.lit("imports").alias("kind"), "reference_status"))
    nodes = edges.select("coordinate", F.col("src").alias("id"), F.col("src").alias("path")).distinct()
    graphs = edges.select("coordinate").distinct()
    at = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz").alias("captured_at")
    text = lambda x, name: F.lit(x).alias(name)
    kept = store.GraphStore(spark, f"{components.cut_dir(spark)}/graphs-{uuid.uuid4().hex}")
    kept.ingest(graphs.select("coordinate", text("c1", "commit"), at(2)), nodes, edges)
    kept.ingest(graphs.select("coordinate", text("c0", "commit"), at(1)), nodes.limit(0), edges.limit(0))
    length = F.length("src")
    touched = nodes.select("coordinate", "path", (F.length("path") % 9 == 0).alias("removed")).where("length(path) % 4 = 0 or removed")
    gone = edges.where("length(dst) % 9 = 0").select("coordinate", F.col("dst").alias("path"), F.lit(True).alias("removed"))
    fresh = edges.where((length % 4 == 0) & (length % 9 != 0)).withColumn("dst", F.concat("dst", F.lit(".new")))
    first = graphs.select("coordinate", text("c2", "commit"), at(3), text("c1", "base_commit"), F.lit(1).cast("long").alias("base_revision"))
    for _ in range(2):
        kept.patch(first, touched.unionByName(gone), nodes.where("length(path) % 4 = 0 and length(path) % 9 <> 0"), fresh)
    kept.patch(first.withColumn("commit", F.lit("c9")), touched, nodes.limit(0), edges.limit(0))
    fifth = nodes.where("length(path) % 5 = 0")
    second = graphs.where("cast(coordinate as int) % 2 = 0").select("coordinate", text("c3", "commit"), at(4), text("c2", "base_commit"), F.lit(2).cast("long").alias("base_revision"))
    kept.patch(second, fifth.select("coordinate", "path", F.lit(False).alias("removed")), fifth, edges.where(length % 5 == 0).withColumn("dst", F.concat("dst", F.lit(".two"))))
    return kept.table("edge").join(kept.table("version").select("coordinate", "revision"), "coordinate").select("coordinate", "src", "dst", "kind", "reference_status", "revision")


# ---- the whole graph of a tree ----------------------------------------------------------------------------------

BUILD_SQL = """k AS (SELECT p_partkey AS k, p_partkey * 3 + 1 AS j, 'pkg' || (p_partkey % 7) || '/m' || p_partkey || '.py' AS path, p_partkey % 101 = 7 AS broken FROM part), py AS (SELECT * FROM k WHERE NOT broken),
page AS (SELECT page_id AS g, page_id % 20 AS i, 'web/c' || page_id || '.ts' AS path FROM pages), srv AS (SELECT DISTINCT page_id % 30 AS i, 'srv/s' || (page_id % 30) || '.py' AS path FROM pages UNION SELECT page_id % 30, 'srv/z' || (page_id % 30) || '.py' FROM pages WHERE page_id % 30 % 4 = 0),
made AS (SELECT 'db/t' || k || '.sql' AS path, 't' || k AS t, true AS creates FROM k UNION SELECT 'db/t' || k || '.sql', 't' || (k + 1), true FROM k WHERE k % 10 = 0 UNION SELECT 'db/t' || k || '.sql', 't' || (k + 1), false FROM k WHERE k % 5 = 1 AND k % 10 <> 0),
creators AS (SELECT t, count(DISTINCT path) FILTER (WHERE creates) AS n FROM made GROUP BY t), used AS (SELECT DISTINCT path, 't' || unnest([k, j]) AS t FROM py),
keyed AS (SELECT 'conf/e' || k || '.env' AS path, 'KEY_W' || k AS c FROM k UNION SELECT 'conf/e' || k || '.env', 'KEY_W' || (k + 1) FROM k WHERE k % 9 = 0), setters AS (SELECT c, count(DISTINCT path) AS n FROM keyed GROUP BY c),
graph_edges AS (
  SELECT path AS src, path || '::' || unnest(['f' || k, 'C' || k]) AS dst, 'contains' AS kind, NULL AS reference_status FROM py UNION ALL SELECT path, unnest(['getenv', 'f' || j, 'Base' || (k % 3)]), 'calls', NULL FROM py
  UNION ALL SELECT path, unnest(['os', 'pkg' || (j % 7)]), 'imports', NULL FROM py UNION ALL SELECT py.path, coalesce(o.path, 'pkg' || (py.j % 7) || '.m' || py.j), 'imports', NULL FROM py LEFT JOIN k o ON o.k = py.j
  UNION ALL SELECT path, 'table::' || t, 'alters', CASE WHEN n > 1 THEN 'ambiguous' END FROM made JOIN creators USING (t) UNION ALL SELECT path, 'table::' || t, 'queries', CASE WHEN n > 1 THEN 'ambiguous' END FROM used JOIN creators USING (t)
  UNION ALL SELECT path, 'config::' || c, 'alters', CASE WHEN n > 1 THEN 'ambiguous' END FROM keyed JOIN setters USING (c) UNION ALL SELECT path, 'config::KEY_W' || (k % 50), 'reads_config', CASE WHEN n > 1 THEN 'ambiguous' END FROM py JOIN setters ON c = 'KEY_W' || (k % 50)
  UNION ALL SELECT path, path || '::g' || g, 'contains', NULL FROM page UNION ALL SELECT path, 'fetch', 'calls', NULL FROM page UNION ALL SELECT path, path || '::h' || i, 'contains', NULL FROM srv UNION ALL SELECT path, 'get', 'calls', NULL FROM srv
  UNION ALL SELECT p.path, s.path, 'imports', CASE WHEN i % 4 = 0 THEN 'ambiguous' END FROM page p JOIN srv s USING (i)),
graph_rows AS (SELECT DISTINCT * FROM graph_edges), doubted AS (SELECT DISTINCT src AS path FROM graph_rows WHERE reference_status = 'ambiguous'),
graph_nodes AS (SELECT path AS id, 'file' AS kind, path, path AS name, CASE WHEN path IN (SELECT path FROM k WHERE broken) THEN 'failed' WHEN path LIKE 'web/%' AND (SELECT bool_or(broken) FROM k) THEN 'incomplete' WHEN path IN (SELECT path FROM doubted) THEN 'ambiguous' END AS analysis_status
    FROM (SELECT path FROM k UNION SELECT path FROM made UNION SELECT path FROM keyed UNION SELECT path FROM page UNION SELECT path FROM srv)
  UNION ALL SELECT path || '::f' || k, 'def', path, 'f' || k, NULL FROM py UNION ALL SELECT path || '::C' || k, 'class', path, 'C' || k, NULL FROM py UNION ALL SELECT path || '::g' || g, 'def', path, 'g' || g, NULL FROM page UNION ALL SELECT path || '::h' || i, 'def', path, 'h' || i, NULL FROM srv
  UNION ALL SELECT DISTINCT 'table::' || t, 'table', path, t, NULL FROM made UNION ALL SELECT 'config::' || c, 'config_key', path, c, NULL FROM keyed)"""


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _dealt(spark, sf_dir, "source_file")
    return files.select("path", F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))


@query(f"WITH {BUILD_SQL} SELECT * FROM graph_nodes")
def build_graph_nodes(spark, sf_dir):
    return build.build_graph(_source_files(spark, sf_dir)).nodes


@query(f"WITH {BUILD_SQL} SELECT * FROM graph_rows")
def build_graph_edges(spark, sf_dir):
    return build.build_graph(_source_files(spark, sf_dir)).edges.select("src", "dst", "kind", "reference_status")


# ---- meter -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {BASKET_SQL}, named AS (SELECT DISTINCT name, path FROM symbol_node WHERE NOT starts_with(name, '__') AND lower(name) NOT IN ({STOP})),
    defs AS (SELECT name, path FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) <= 3)),
    raw AS (SELECT src, dst, 'import' AS label FROM import_edge UNION ALL SELECT c.src, d.path, 'call' FROM call_edge c JOIN defs d ON d.name = c.dst),
    prs AS (SELECT DISTINCT least(src, dst) AS path_a, greatest(src, dst) AS path_b, label FROM raw WHERE src <> dst AND src IN (SELECT path FROM file_node) AND dst IN (SELECT path FROM file_node)),
    res AS (SELECT * FROM resource_edge WHERE src IN (SELECT path FROM file_node)), k AS (SELECT dst, count(DISTINCT src) AS n, bool_or(kind = 'alters') AND bool_or(kind = 'queries') AS two FROM res GROUP BY dst),
    cool AS (SELECT DISTINCT src, dst FROM res WHERE dst IN (SELECT dst FROM k WHERE n BETWEEN 2 AND {HUB})),
    links AS (SELECT path_a, path_b FROM prs WHERE label = 'import' UNION SELECT a.src, b.src FROM cool a JOIN cool b ON a.dst = b.dst AND a.src < b.src),
    one AS (SELECT (SELECT count(*) FROM file_node) AS n, (SELECT sum(loc)::BIGINT FROM file_node) AS loc, (SELECT count(*) FROM k WHERE n >= 2) + (SELECT count(*) FROM k WHERE two) AS xs, (SELECT count(*) FROM prs WHERE label = 'call') AS calls,
      (SELECT count(*) FROM prs WHERE label = 'import' AND regexp_replace(path_a, '/[^/]*$', '') <> regexp_replace(path_b, '/[^/]*$', '')) AS xdir, 2 * (SELECT count(*) FROM links) AS ends,
      (SELECT count(*) FROM (SELECT dst FROM import_edge WHERE dst IN (SELECT path FROM file_node) GROUP BY dst HAVING count(DISTINCT src) > {HUB})) + (SELECT count(*) FROM k WHERE n > {HUB}) AS conc,
      (SELECT count(*) FROM scored s WHERE co >= 2 AND lift >= 2 AND NOT EXISTS (SELECT 1 FROM prs p WHERE p.path_a = s.path_a AND p.path_b = s.path_b)) AS blind),
    m AS (SELECT loc, xs / n AS xs_intensity, calls / n AS call_density, xdir / n AS xdir_density, ends / n AS blast_mean, blind / n AS blind_density, CASE WHEN conc = 0 THEN 0 WHEN conc <= 3 THEN 1 WHEN conc <= 10 THEN 2 ELSE 3 END AS hub_bucket FROM one),
    p AS (SELECT *, 1.0::DOUBLE + 2.0::DOUBLE * xs_intensity + 0.35::DOUBLE * least(call_density, 3.0::DOUBLE) + 0.3::DOUBLE * least(xdir_density, 3.0::DOUBLE) + 0.03::DOUBLE * least(blast_mean, 10.0::DOUBLE) + 0.15::DOUBLE * hub_bucket + 0.5::DOUBLE * least(blind_density, 2.0::DOUBLE) AS raw_premium FROM m)
    SELECT loc, xs_intensity, call_density, xdir_density, blast_mean, blind_density, hub_bucket, least(raw_premium, cap) AS premium, raw_premium > cap + 1e-9 AS premium_capped, floor(loc * least(raw_premium, cap))::BIGINT AS units FROM p, (SELECT unnest([4.0::DOUBLE, 9.0::DOUBLE]) AS cap)"""
)
def units_components(spark, sf_dir):
    """The meter under its own policy and under one with a higher cap."""
    r = Stored(spark, sf_dir)
    parts = components.cut(adj.meter_components(r.file_node, r.symbol_node, r.call_edge, r.import_edge, r.resource_edge, _pairs(r), degree=HUB))
    return adj.meter(parts).unionByName(adj.meter(parts, {"cap_premium": 9.0}))


# ---- validation and evaluation ---------------------------------------------------------------------------------


@query(
    f"""WITH {EDGES_SQL}, s AS (SELECT *, CASE kind WHEN 'imports' THEN 'imports' WHEN 'calls' THEN 'calls' WHEN 'reads_config' THEN 'config' ELSE 'database' END AS substrate FROM edges)
    SELECT substrate, count(*) AS edges, count(*) FILTER (WHERE reference_status = 'unresolved') AS unresolved, count(*) FILTER (WHERE reference_status = 'ambiguous') AS ambiguous FROM s GROUP BY substrate"""
)
def substrate_metrics(spark, sf_dir):
    return validation.metrics(_edges(Relations(spark, sf_dir)))


@query(
    f"""WITH {EDGES_SQL}, nodes AS (SELECT path AS id, 'file' AS kind, path FROM file_node UNION ALL SELECT path, 'file', path FROM file_node WHERE loc % 3 = 0 UNION ALL SELECT '', 'gizmo', '/' || path FROM file_node WHERE loc % 5 = 0),
    e AS (SELECT src, dst, CASE WHEN length(src) % 7 = 0 THEN 'likes' ELSE kind END AS kind, CASE WHEN length(dst) % 11 = 0 THEN 'odd' ELSE reference_status END AS reference_status FROM edges),
    r AS (SELECT 'repeated_node' AS rule, count(*) AS n FROM (SELECT id FROM nodes GROUP BY id, kind, path HAVING count(*) > 1) UNION ALL SELECT 'unknown_node_kind', count(*) FROM nodes WHERE kind = 'gizmo' UNION ALL SELECT 'bad_id', count(*) FROM nodes WHERE id = ''
      UNION ALL SELECT 'bad_path', count(*) FROM nodes WHERE path LIKE '/%' UNION ALL SELECT 'unknown_edge_kind', count(*) FROM e WHERE kind = 'likes' UNION ALL SELECT 'bad_reference_status', count(*) FROM e WHERE reference_status = 'odd')
    SELECT * FROM r WHERE n > 0"""
)
def graph_validation(spark, sf_dir):
    r = Relations(spark, sf_dir)
    files = r.file_node
    node = lambda d, i, k, p: d.select(i.alias("id"), F.lit(k).alias("kind"), p.alias("path"))
    path = F.col("path")
    nodes = node(files, path, "file", path).unionAll(node(files.where("loc % 3 = 0"), path, "file", path)).unionAll(node(files.where("loc % 5 = 0"), F.lit(""), "gizmo", F.concat(F.lit("/"), path)))
    edges = _edges(r).withColumns({"kind": F.when(F.length("src") % 7 == 0, "likes").otherwise(F.col("kind")), "reference_status": F.when(F.length("dst") % 11 == 0, "odd").otherwise(F.col("reference_status"))})
    return validation.validation_errors(nodes, edges)


KEYS_SQL = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'column' WHEN 2 THEN 'config_key' WHEN 3 THEN 'iac_resource' WHEN 4 THEN 'job_task' ELSE 'api_type' END AS kind, CASE p_partkey % 6 WHEN 1 THEN 'column::' WHEN 3 THEN 'iac_resource::' WHEN 4 THEN 'job::' ELSE '' END || p_brand AS id, p_name AS name FROM part"


@query(f"SELECT p_partkey, CASE WHEN kind IN ('table', 'config_key') THEN name WHEN kind IN ('column', 'iac_resource') THEN regexp_replace(id, '^[a-z_]+::', '') ELSE id END AS canonical_key FROM ({KEYS_SQL})")
def canonical_keys(spark, sf_dir):
    rows = spark.sql(KEYS_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return rows.select("p_partkey", validation.canonical_key(F.col("kind"), F.col("id"), F.col("name")).alias("canonical_key"))


@query(f"WITH k AS (SELECT kind, CASE WHEN kind IN ('table', 'config_key') THEN name WHEN kind IN ('column', 'iac_resource') THEN regexp_replace(id, '^[a-z_]+::', '') ELSE id END AS canonical_key FROM ({KEYS_SQL})) SELECT canonical_key, count(DISTINCT kind) AS kinds FROM k GROUP BY 1 HAVING count(DISTINCT kind) > 1")
def cross_kind_collisions(spark, sf_dir):
    rows = spark.sql(KEYS_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return validation.cross_kind_collisions(rows.withColumn("canonical_key", validation.canonical_key(F.col("kind"), F.col("id"), F.col("name"))))


CONTROLS_SQL = """n_files AS (SELECT greatest(0, floor(log2(count(*) / 1000) / 4))::INT AS digits FROM file_node), hashed AS (SELECT path, md5('7:' || path) AS h, left(md5('7:' || path), digits) AS block FROM file_node, n_files),
ordered AS (SELECT path, lead(path, 1) OVER w AS x, lead(path, 2) OVER w AS y FROM hashed WINDOW w AS (PARTITION BY block ORDER BY h, path)), paired AS (SELECT path, x AS other FROM ordered UNION ALL SELECT path, y FROM ordered),
controls AS (SELECT DISTINCT least(path, other) AS path_a, greatest(path, other) AS path_b FROM paired WHERE other IS NOT NULL)"""
RATES_SQL = f"""{BASKET_SQL}, {CONTROLS_SQL}, labelled AS (SELECT DISTINCT least(src, dst) AS path_a, greatest(src, dst) AS path_b, 'coupled' AS label FROM import_edge WHERE src <> dst AND reference_status IS NULL UNION ALL SELECT *, 'control' FROM controls),
rates AS (SELECT label, regexp_replace(path_a, '/[^/]*$', '') <> regexp_replace(path_b, '/[^/]*$', '') AS cross_dir, count(*) AS pairs, count(co.co) AS together FROM labelled LEFT JOIN co USING (path_a, path_b) GROUP BY ALL)"""


def _labelled(r: Relations) -> DataFrame:
    """Resolved imports, and control pairs by a seeded hash order."""
    return cc.structural_pairs(graph.usable(r.import_edge)).withColumn("label", F.lit("coupled")).unionByName(evaluation.controls(r.file_node).withColumn("label", F.lit("control")))


@query(f"WITH {RATES_SQL} SELECT label, cross_dir, pairs, together FROM rates")
def evaluation_rates(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return evaluation.change_rates(_labelled(r), cc.pair_counts(cc.baskets(r.touch))).withColumnRenamed("cross", "cross_dir")


@query(
    f"""WITH {RATES_SQL}, one AS (SELECT sum(together) FILTER (WHERE label = 'coupled') / sum(pairs) FILTER (WHERE label = 'coupled') AS coupled, sum(together) FILTER (WHERE label = 'control') / sum(pairs) FILTER (WHERE label = 'control') AS control,
      sum(together) FILTER (WHERE label = 'coupled' AND cross_dir) / sum(pairs) FILTER (WHERE label = 'coupled' AND cross_dir) AS coupled_cross, sum(together) FILTER (WHERE label = 'control' AND cross_dir) / sum(pairs) FILTER (WHERE label = 'control' AND cross_dir) AS control_cross,
      coalesce(sum(pairs) FILTER (WHERE label = 'coupled' AND cross_dir), 0)::BIGINT AS cross_pairs FROM rates)
    SELECT *, cross_pairs >= 20 AND control_cross > 0 AS applicable, cross_pairs >= 20 AND control_cross > 0 AND coupled > 1.3::DOUBLE * control AND coupled_cross > 1.3::DOUBLE * control_cross AS "real" FROM one"""
)
def evaluation_verdict(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return evaluation.verdict(evaluation.change_rates(_labelled(r), cc.pair_counts(cc.baskets(r.touch))))


@query(f"WITH {CONTROLS_SQL} SELECT * FROM controls")
def evaluation_controls(spark, sf_dir):
    """Control pairs by a seeded hash order."""
    return evaluation.controls(Relations(spark, sf_dir).file_node)


@query(
    """WITH h AS (SELECT path, md5('7:' || path) AS h, regexp_replace(path, '(^|/)[^/]*$', '') AS dir FROM file_node), o AS (SELECT path, lead(path, 1) OVER w AS x, lead(path, 2) OVER w AS y FROM h WINDOW w AS (PARTITION BY dir ORDER BY h, path)),
    p AS (SELECT path, x AS other FROM o UNION ALL SELECT path, y FROM o) SELECT DISTINCT least(path, other) AS path_a, greatest(path, other) AS path_b FROM p WHERE other IS NOT NULL"""
)
def evaluation_controls_same_dir(spark, sf_dir):
    return evaluation.controls(Relations(spark, sf_dir).file_node, within=dirname(F.col("path")))


@query(
    f"""WITH {BASKET_SQL}, {STRUCT_SQL}, labelled AS (SELECT DISTINCT least(src, dst) AS path_a, greatest(src, dst) AS path_b, length(src) % 2 = 0 AS related FROM call_edge JOIN file_node ON path = src WHERE src < dst),
    hist AS (SELECT path_a, path_b FROM scored WHERE co >= 2 AND lift >= 2), f AS (SELECT src AS path_a, dst AS path_b, length(src) % 2 = 0 AS related FROM (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM import_edge WHERE src <> dst)),
    g AS (SELECT related, s.path_a IS NOT NULL AS g, h.path_a IS NOT NULL AS h FROM f LEFT JOIN structure s USING (path_a, path_b) LEFT JOIN hist h USING (path_a, path_b)),
    m AS (SELECT related, unnest([{{'mode': 'graph', 'said': g}}, {{'mode': 'cochange', 'said': h}}, {{'mode': 'union', 'said': g OR h}}, {{'mode': 'corroborated', 'said': g AND h}}]) AS u FROM g)
    SELECT u.mode AS mode, count(*) FILTER (WHERE u.said AND related) AS tp, count(*) FILTER (WHERE u.said AND NOT related) AS fp, count(*) FILTER (WHERE NOT u.said AND related) AS fn, count(*) FILTER (WHERE NOT u.said AND NOT related) AS tn FROM m GROUP BY 1"""
)
def detector_scores(spark, sf_dir):
    r = Stored(spark, sf_dir)
    labelled = r.import_edge.where("src <> dst").select(F.least("src", "dst").alias("path_a"), F.greatest("src", "dst").alias("path_b")).distinct().withColumn("related", F.length("path_a") % 2 == 0)
    return evaluation.detector_scores(labelled, cc.structural_pairs(graph.usable(r.import_edge)), _pairs(r))


@query(
    f"""WITH {BASKET_SQL}, {STRUCT_SQL}, hist AS (SELECT path_a, path_b FROM scored WHERE co >= 2 AND lift >= 2), me AS (SELECT '{{path}}' AS p),
    s AS (SELECT DISTINCT CASE WHEN path_a = p THEN path_b ELSE path_a END AS candidate FROM structure, me WHERE p IN (path_a, path_b)), h AS (SELECT DISTINCT CASE WHEN path_a = p THEN path_b ELSE path_a END AS candidate FROM hist, me WHERE p IN (path_a, path_b))
    SELECT candidate, CASE WHEN s.candidate IS NULL THEN 'not_observed' ELSE 'observed' END AS static, CASE WHEN h.candidate IS NULL THEN 'not_observed' ELSE 'observed' END AS historical FROM s FULL JOIN h USING (candidate)""".replace("{path}", "src/m1/d2/p12.py")
)
def review_file(spark, sf_dir):
    r = Relations(spark, sf_dir)
    return evaluation.review("src/m1/d2/p12.py", cc.structural_pairs(graph.usable(r.import_edge)), _pairs(r))


@query(
    f"""WITH {ADJ_SQL}, c AS (SELECT DISTINCT change_id, f || '|' || nbr || '|' || dir AS c FROM adjacent)
    SELECT change_id, count(*) AS couplings, sha256(string_agg(c, chr(10) ORDER BY c)) AS snapshot FROM c GROUP BY change_id"""
)
def coupling_snapshot(spark, sf_dir):
    return contention.coupling_snapshot(_adjacency(Stored(spark, sf_dir)))


@query(
    f"""WITH {ADJ_SQL}, {WAITS_SQL}, i AS (SELECT change_id, count(DISTINCT nbr) AS impact FROM adjacent WHERE dir IN ('down', 'shared') GROUP BY change_id),
    w AS (SELECT waiter AS change_id, string_agg(DISTINCT '"' || holder || '"', ',' ORDER BY '"' || holder || '"') AS h, count(DISTINCT path) AS n FROM wait_rows GROUP BY waiter)
    SELECT change_id, '{{"verdict":"' || CASE WHEN h IS NULL THEN 'clear' ELSE 'serialize' END || '","waits_for":[' || coalesce(h, '') || '],"contended_paths":' || coalesce(n, 0) || ',"impact":' || coalesce(impact, 0) || '}}' AS brief
    FROM (SELECT DISTINCT change_id FROM claim) LEFT JOIN w USING (change_id) LEFT JOIN i USING (change_id)"""
)
def coordination_brief(spark, sf_dir):
    r = Stored(spark, sf_dir)
    rows = _waits(r)
    waiting = rows.select(F.col("waiter").alias("change_id")).distinct().withColumn("w", F.lit(True))
    verdict = r.claim.select("change_id").distinct().join(waiting, "change_id", "left").select("change_id", F.when(F.col("w"), "serialize").otherwise("clear").alias("verdict"))
    return contention.coordination_brief(verdict, rows, contention.impacts(_adjacency(r)))


@query("SELECT event_id, CASE account WHEN 'acct1' THEN 'acct9' WHEN 'acct2' THEN 'acct8' ELSE account END AS account FROM event_log")
def renamed_coordinates(spark, sf_dir):
    names = spark.sql("SELECT * FROM VALUES ('acct1', 'acct9'), ('acct2', 'acct8') AS t(old, new)")
    return surfaces.rekey(Relations(spark, sf_dir).event_log, names, "account").select("event_id", "account")


@query("SELECT event_id, account, turn FROM (SELECT event_id, account, row_number() OVER (PARTITION BY account ORDER BY occurred_at, event_id) AS turn FROM event_log WHERE kind = 'pushed') WHERE turn <= 50")
def fair_queue_order(spark, sf_dir):
    return surfaces.fair_order(Relations(spark, sf_dir).event_log.where("kind = 'pushed'"), 50)
