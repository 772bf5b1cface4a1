"""Imports that name a package and not a file: Go package directories, C# namespaces, declared workspaces and crates.

What is imported is worked out once for each distinct name: its prefixes or suffixes are rows that meet the packages in an
equi-join, and the longest one wins. Only then do the packages' files and the importing files come to it.

Results are (src, module, dst, reference_status). An import that names no package of the repository stays as it is, without a status.
A file is never its own import. Imports that repeat count once; a null src or module matches nothing and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.functions.paths import basename, dirname
from sparkweft.operators.resolve import strip_extension


def _asked(imports: DataFrame) -> DataFrame:
    return imports.where("src is not null and module is not null").select("src", "module").distinct()


def _endings(name: Column, sep: str) -> Column:
    """(i, ending) for each run of segments up to the end, the whole name first."""
    parts = F.split(name, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, i, F.size(parts)), sep.replace("\\", "")).alias("ending")))


def _raw(asked: DataFrame, found: DataFrame, status: Column | None = None) -> DataFrame:
    """The imports whose name found (module) does not have, as they are."""
    none = F.lit(None).cast("string") if status is None else status
    return asked.join(found.select("module").distinct(), "module", "left_anti").select("src", "module", F.col("module").alias("dst"), none.alias("reference_status"))


def go_packages(imports: DataFrame, files: DataFrame) -> DataFrame:
    """A Go import of several segments means all files, tests apart, of the directory that is its longest ending: all are resolved.

    files (path) may hold other languages too. A single segment is the standard library.
    """
    own = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go") & F.contains("path", F.lit("/"))).select(dirname(F.col("path")).alias("dir"), F.col("path").alias("dst")).distinct()
    asked = _asked(imports)
    names = asked.where(F.contains("module", F.lit("/"))).select("module").distinct().select("module", F.explode(_endings(F.col("module"), "/")).alias("e"))
    hits = names.select("module", "e.i", F.col("e.ending").alias("dir")).join(own.select("dir").distinct(), "dir")
    found = hits.groupBy("module").agg(F.min_by("dir", "i").alias("dir"))
    edges = asked.join(found, "module").join(own, "dir").where("src <> dst").select("src", "module", "dst", F.lit(None).cast("string").alias("reference_status"))
    return edges.unionByName(_raw(asked, found))


#: Directories that are no part of a production namespace.
TEST_SEGMENTS = ("test", "tests", "spec", "specs", "__tests__", "examples", "example")


def csharp_namespaces(imports: DataFrame, files: DataFrame, max_fanout: int = v.MAX_BARE_FANOUT) -> DataFrame:
    """A C# using of several segments means the directory with exactly its name (slashes read as dots), else every directory that ends in it.

    Where there is none, its last segment may be a type: the file of that name in the directories of the rest. Files of one
    directory are all resolved; those of several compete: up to max_fanout are ambiguous edges, more are one raw ambiguous edge.
    """
    folder = dirname(F.col("path"))
    plain = ~F.arrays_overlap(F.split(F.lower(folder), "/"), F.array(*[F.lit(s) for s in TEST_SEGMENTS]))
    own = files.where(F.col("path").endswith(".cs") & F.contains("path", F.lit("/"))).where(plain).select(folder.alias("dir"), F.translate(folder, "/", ".").alias("name"), F.col("path").alias("dst")).distinct()
    index = own.select("dir", F.explode(_endings(F.col("name"), "\\.")).alias("e")).distinct().select("dir", F.col("e.ending").alias("space"), (F.col("e.i") > 1).cast("int").alias("rank"))
    asked = _asked(imports)
    names = asked.where(F.contains("module", F.lit("."))).select("module").distinct()
    head = F.regexp_replace("module", r"\.[^.]*$", "")
    tries = names.select("module", F.explode(F.array(F.struct(F.col("module").alias("space"), F.lit(None).cast("string").alias("type")), F.struct(F.when(F.contains(head, F.lit(".")), head).alias("space"), F.regexp_extract("module", r"([^.]*)$", 1).alias("type")))).alias("t"))
    dirs = tries.select("module", "t.*").join(index, "space")
    # a type is looked for where the whole name is no directory, and an exact directory beats endings in either case
    best = dirs.groupBy("module", "type").agg(F.min("rank").alias("rank"))
    same = best.select(F.col("module").alias("m"), F.col("type").alias("t"), F.col("rank").alias("least"))
    dirs = dirs.join(same, (F.col("module") == F.col("m")) & F.col("type").eqNullSafe(F.col("t")) & (F.col("rank") == F.col("least"))).select("module", "type", "dir")
    hits = dirs.join(own.select("dir", "dst"), "dir").where(F.col("type").isNull() | (basename(F.col("dst")) == F.concat("type", F.lit(".cs"))))
    whole = hits.where("type is null").select("module").distinct()
    hits = hits.where("type is null").unionByName(hits.where("type is not null").join(whole, "module", "left_anti"))
    size = hits.groupBy("module").agg(F.countDistinct("dir").alias("dirs"), F.countDistinct("dst").alias("n")).withColumn("many", (F.col("dirs") > 1) & (F.col("n") > max_fanout))
    few = hits.select("module", "dst").distinct().join(size.where("not many"), "module")
    edges = asked.join(few, "module").where("src <> dst").select("src", "module", "dst", F.when(F.col("dirs") > 1, "ambiguous").alias("reference_status"))
    raw = asked.join(size.where("many").select("module"), "module", "left_semi").select("src", "module", F.col("module").alias("dst"), F.lit("ambiguous").alias("reference_status"))
    return edges.unionByName(raw).unionByName(_raw(asked, size))


def workspace_imports(imports: DataFrame, packages: DataFrame, files: DataFrame, entries: tuple[str, ...] = ("index",), members: bool = False, max_fanout: int = v.MAX_BARE_FANOUT) -> DataFrame:
    """Imports of declared packages (name, root), such as @scope/pkg/sub or a crate's a/b/Type: the longest declared name that is a prefix, by segments.

    What is left is looked for under root/src and root, as a file (extensions apart) or a directory's entry file; with members
    its last segment may be a member of the file before it, or of the package's entry. Nothing left means the entry, the one under src first.
    A declared name whose rest is no file is unresolved and never looked for elsewhere; names of other packages stay as they are.
    One file is resolved, up to max_fanout are ambiguous, more are one raw ambiguous edge. Rust paths come with / for ::.
    """
    asked = _asked(imports)
    parts = F.split("module", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("name"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))
    names = asked.select("module").distinct().select("module", F.explode(prefixes).alias("p")).select("module", "p.*")
    hits = names.join(packages.select("name", "root").distinct(), "name")
    longest = hits.groupBy("module").agg(F.max("i").alias("i"))
    known = hits.join(longest, ["module", "i"]).select("module", "root", "rest")
    under = F.array(F.concat("root", F.lit("/src")), F.col("root"))
    keyed = lambda tail, rank: F.transform(under, lambda r: F.struct(tail(r).alias("key"), rank(r).alias("rank")))

    def at(rest: Column, rank: int) -> list[Column]:
        """The file that rest is, or the entry files of the directory that it is."""
        own = join_to(rest)
        return [keyed(own, lambda _: F.lit(rank))] + [keyed(then(own, e), lambda _: F.lit(rank)) for e in entries]

    join_to = lambda rest: lambda r: F.when(rest == "", r).otherwise(F.concat(r, F.lit("/"), rest))
    then = lambda own, e: lambda r: F.concat(own(r), F.lit(f"/{e}"))
    # an entry file is the first that there is: below src, then in the root, entries in their order
    place = lambda i: lambda r: F.array_position(under, r).cast("int") * 10 + (100 + i)
    first = F.flatten(F.array(*[keyed(then(lambda r: r, e), place(i)) for i, e in enumerate(entries)]))
    named = F.concat(*at(F.col("rest"), 0), *(at(dirname(F.col("rest")), 1) if members else []))
    named = F.concat(F.filter(named, lambda k: F.col("rest") != ""), first) if members else F.when(F.col("rest") == "", first).otherwise(named)
    keys = known.select("module", F.explode(F.array_distinct(named)).alias("k")).select("module", "k.*")
    found = keys.join(files.select(strip_extension(F.col("path")).alias("key"), F.col("path").alias("dst")), "key")
    best = found.groupBy("module").agg(F.min("rank").alias("rank"))
    found = found.join(best, ["module", "rank"]).select("module", "dst").distinct()
    size = found.groupBy("module").agg(F.count("*").alias("n"))
    edges = asked.join(found.join(size.where(F.col("n") <= max_fanout), "module"), "module").where("src <> dst").select("src", "module", "dst", F.when(F.col("n") > 1, "ambiguous").alias("reference_status"))
    raw = asked.join(size.where(F.col("n") > max_fanout).select("module"), "module", "left_semi").select("src", "module", F.col("module").alias("dst"), F.lit("ambiguous").alias("reference_status"))
    lost = _raw(asked.join(longest.select("module"), "module", "left_semi"), size, F.lit("unresolved"))
    return edges.unionByName(raw).unionByName(lost).unionByName(_raw(asked, longest))
