"""The whole graph of a source tree in one call: parse, find contracts, resolve, link, mark what was lost, and measure.

Pass 1 turns each file into rows, one task a file batch; its output is written once. Pass 2 is relational: references meet the known definers.
Where pass 1 lost a file of a language that may define contracts of a substrate, every file with a candidate reference of that
substrate is incomplete, as what it refers to may be what was lost.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions.paths import basename, dirname
from sparkweft.operators import graph, packages, resolve, routes, validation
from sparkweft.operators.components import cut
from sparkweft.sources import extract
from sparkweft.sources.tree import guarded

#: What kind of node a contract of each substrate is; routes have none.
NODE_KIND = {"table": "table", "config": "config_key", "graphql": "api_type", "proto": "api_message", "terraform": "iac_resource", "tauri": "app_command", "job": "job_task", "queue": "job_queue", "openapi": "api_operation", "script": "ci_script"}
#: Languages whose files import each other.
FAMILIES = {"javascript": "web", "typescript": "web", "vue": "web", "svelte": "web", "astro": "web", "cpp": "c", "scss": "css", "sass": "css", "less": "css"}


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame
    hash: DataFrame


def may_define() -> dict[str, list[str]]:
    """Language to the substrates that its files may define."""
    out = {"json": {"config", "script", "openapi"}} | {x: {"config"} for x in ("env", "ini", "toml", "yaml")}
    for substrate, role, languages, _ in extract.CONTRACTS:
        if role != "uses":
            for language in languages:
                out.setdefault(language, set()).add(substrate)
    return {k: sorted(x) for k, x in out.items()}


def lost_substrates(files: DataFrame) -> DataFrame:
    """(substrate): what files (language, lost) that were lost might have defined."""
    known = F.create_map(*[x for k, s in may_define().items() for x in (F.lit(k), F.array(*[F.lit(n) for n in s]))])
    return files.where("lost").select(F.explode(known[F.col("language")]).alias("substrate")).distinct()


def declared_packages(files: DataFrame) -> DataFrame:
    """(name, root, family) of manifests: scoped names of package.json files below the top, crates of Cargo.toml, with _ for -."""
    text = F.col("content").cast("string")
    npm = files.where((basename(F.col("path")) == "package.json") & F.contains("path", F.lit("/"))).select(F.get_json_object(text, "$.name").alias("name"), dirname(F.col("path")).alias("root"), F.lit("web").alias("family")).where("name like '@%/%'")
    section = F.regexp_extract(text, r"(?ms)^\[(?:lib)\]\s*?$[^\[]*?^name\s*=\s*[\"']([^\"']+)", 1)
    crate = F.coalesce(F.nullif(section, F.lit("")), F.regexp_extract(text, r"(?ms)^\[package\]\s*?$[^\[]*?^name\s*=\s*[\"']([^\"']+)", 1))
    rust = files.where(basename(F.col("path")) == "Cargo.toml").select(F.translate(crate, "-", "_").alias("name"), dirname(F.col("path")).alias("root"), F.lit("rust").alias("family")).where("name <> ''")
    return npm.unionByName(rust)


def resolved_imports(edges: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, reference_status) of import edges (src, dst, family) over files (path, family): each family by its own rules; declared
    packages known (name, root, family) go before other names. Each step's rows are written once, so that plans stay small."""
    asked = edges.select("src", F.when(F.col("family") == "rust", F.replace("dst", F.lit("::"), F.lit("/"))).otherwise(F.col("dst")).alias("module"), "family", F.lit(False).alias("local")).distinct()
    of = lambda rows, *f: rows.where(F.col("family").isin(*f))
    parts = [packages.go_packages(of(asked, "go"), of(files, "go")), packages.csharp_namespaces(of(asked, "csharp"), of(files, "csharp"))]
    prefix = lambda n: F.array_join(F.slice(F.split("module", "/"), 1, n), "/")
    for family, depth, entries, members in (("web", 2, ("index",), False), ("rust", 1, ("lib", "main", "mod"), True)):
        own = of(known, family)
        asked = cut(asked.join(own.select(F.col("name").alias("declared")).distinct(), prefix(depth) == F.col("declared"), "left").withColumn("local", F.col("local") | (F.col("declared").isNotNull() & (F.col("family") == family))).drop("declared"))
        parts.append(packages.workspace_imports(of(asked, family).where("local"), own, of(files, family), entries, members))
    parts.append(resolve.resolve_imports(asked.where(~F.col("family").isin("go", "csharp") & ~F.col("local")), files))
    out = None
    for p in parts:
        done = cut(p.select("src", "dst", "reference_status"))
        out = done if out is None else out.unionByName(done)
    return out


def build_graph(files: DataFrame) -> Graph:
    """The graph of files (path, content binary, length): nodes (id, kind, path, name, analysis_status), edges (src, dst, kind, reference_status),
    metrics by substrate and a hash in one row that neither partitions nor order change.

    A file that can't be read or parsed is a bare node. Paths that repeat are one file each by their content; an empty table gives empty ones.
    """
    source = guarded(files)
    family = F.coalesce(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.col("language")], F.col("language"))
    found_nodes, found_edges = extract.code_graph(source, cut)
    mentions = cut(extract.mentions(source))
    mine = cut(source.select("path", "language", family.alias("family")))
    documents = found_nodes.where("kind = 'file'").select("path", "analysis_status")
    lost = cut(lost_substrates(documents.where("analysis_status is not null").join(mine, "path").select("language", F.lit(True).alias("lost"))))

    imports = cut(found_edges.where("kind = 'imports'").join(mine.select(F.col("path").alias("src"), "family"), "src").select("src", "dst", "family"))
    imports = resolved_imports(imports, mine.select("path", "family"), cut(declared_packages(source))).withColumn("kind", F.lit("imports"))
    linked = extract.link_contracts(mentions.where("substrate <> 'route'"), lost).select("src", "dst", "kind", "reference_status")
    route = mentions.where("substrate = 'route'").select("path", "role", routes.normalize_route(F.col("contract")).alias("route"))
    pairs = routes.single_definer(routes.match_pairs(route.where("role = 'defines'"), route.where("role = 'uses'")))
    routed = pairs.select(F.col("requester").alias("src"), F.col("definer").alias("dst"), F.lit("imports").alias("kind"), F.when(~F.col("sure"), "ambiguous").alias("reference_status"))
    none = F.lit(None).cast("string")
    plain = found_edges.where("kind in ('contains', 'calls')").select("src", F.when(F.col("kind") == "contains", F.concat_ws("::", "src", "dst")).otherwise(F.col("dst")).alias("dst"), "kind", none.alias("reference_status"))
    edges = cut(graph.dedupe_edges(plain.unionByName(imports).unionByName(linked).unionByName(routed)))

    incomplete = mentions.where("role = 'uses'").join(lost, "substrate", "left_semi").select("path").distinct().withColumn("gone", F.lit(True))
    status = graph.propagate_status(documents, edges).join(incomplete, "path", "left")
    worst = F.when(F.col("gone") & ~F.coalesce(F.col("analysis_status") == "failed", F.lit(False)), "incomplete").otherwise(F.col("analysis_status"))
    kind: Column = F.create_map(*[F.lit(x) for kv in NODE_KIND.items() for x in kv])[F.col("substrate")]
    contract = mentions.where("role <> 'uses' and substrate <> 'route'").select(F.concat_ws("::", "substrate", "contract").alias("id"), kind.alias("kind"), "path", F.col("contract").alias("name"), none.alias("analysis_status"))
    symbols = found_nodes.where("kind <> 'file'").select(F.concat_ws("::", "path", "name").alias("id"), "kind", "path", "name", none.alias("analysis_status"))
    nodes = cut(status.select(F.col("path").alias("id"), F.lit("file").alias("kind"), "path", F.col("path").alias("name"), worst.alias("analysis_status")).unionByName(symbols).unionByName(contract).distinct())
    both = graph.graph_hash(nodes).select(F.to_json(F.struct("*")).alias("n")).crossJoin(F.broadcast(graph.graph_hash(edges).select(F.to_json(F.struct("*")).alias("e"))))  # one row each
    return Graph(nodes, edges, validation.metrics(edges), both.select(F.sha2(F.concat("n", "e"), 256).alias("hash")))
