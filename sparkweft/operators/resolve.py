"""Import resolution: module names to files through keys that both sides share, never by testing every ending.

Every file stands under all suffixes of its path, an import under what it asks for, and they meet in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.functions.paths import dirname, is_test_path, normalize_parts
from sparkweft.operators.components import cut


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def suffix_index(files: DataFrame) -> DataFrame:
    """(key, path, family): each file under every suffix of its path without extension, and under its directory where it is an index file."""
    stem = strip_extension(F.col("path"))
    parts = F.split(F.regexp_replace(stem, "/(index|__init__)$", ""), "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select(F.explode(keys).alias("key"), "path", "family")


def relative_target(src: Column, module: Column) -> Column:
    """The path that a ./ or ../ import means from its file."""
    return normalize_parts(F.concat_ws("/", dirname(src), module))


def dotted_target(src: Column, module: Column) -> Column:
    """The path that a Python module with leading dots means: one dot is the file's directory, each more its parent."""
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    rest = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    return normalize_parts(F.concat_ws("/", dirname(src), F.repeat(F.lit("../"), dots - 1), rest))


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An equi-join without a broadcast: paths are many times larger in memory than in their files, by whose size Spark decides."""
    return left.join(right.hint("merge"), on)


def resolve_imports(imports: DataFrame, files: DataFrame, max_fanout: int = v.MAX_BARE_FANOUT) -> DataFrame:
    """(src, module, dst, reference_status) of imports (src, module, family).

    Relative ones (./, ../, and leading dots in Python) take the exact path, then the same path without extension or as an index
    file; bare and dotted ones any file of the family under that suffix, test files only where there is nothing else. In Python, where
    nothing is found under a dotted name, its last part may be a member: the name without it is tried. None found: a local one is
    unresolved, a bare one external with no status. One: resolved. Up to max_fanout: all, ambiguous. More: one raw ambiguous
    edge; suffixes that are too common are told by their count alone and never joined with their files.
    """
    slashed = F.col("module").rlike(r"^\.\.?(/|$)") & ~((F.col("family") == "python") & F.col("module").rlike(r"^\.+$"))
    dotted = (F.col("family") == "python") & F.col("module").rlike(r"^\.+([A-Za-z_]|$)")
    aliased = F.col("module").rlike(r"^[@~]/")
    rows = imports.select("src", "module", "family").distinct().withColumns({"whole": slashed | dotted, "local": slashed | dotted | aliased})
    target = (
        F.when(slashed, relative_target(F.col("src"), F.col("module"))).when(dotted, dotted_target(F.col("src"), F.col("module")))
        .when(aliased, F.regexp_replace(F.col("module"), r"^[@~]/", "")).otherwise(F.translate("module", ".", "/"))
    )
    # written once: else each of the joins below works out the distinct imports and, for each mention of the target, the target again
    rows = cut(rows.withColumn("target", target).withColumn("k", strip_extension(F.col("target"))))
    hit = lambda d, rank: d.select("src", "module", "dst", rank.alias("rank"), is_test_path(F.col("dst")).cast("int").alias("test"))
    exact = meet(rows, files.select(F.col("path").alias("target"), F.col("path").alias("dst")), ["target"])
    asked = rows.select("src", "module", "family", "whole", "k", F.lit(1).alias("rank"))
    stem = strip_extension(F.regexp_replace(F.col("path"), r"/(index|__init__)(\.[A-Za-z0-9]+)$", "$2"))
    full = meet(asked.where("whole"), files.select(stem.alias("k"), "family", F.col("path").alias("dst")), ["k", "family"])
    member = (F.col("family") == "python") & F.col("module").rlike(r"^\.*[^./]+\.[^/]+$") & F.col("k").contains("/")
    names = asked.withColumn("tries", F.when(member, F.array(F.struct("k", "rank"), F.struct(dirname(F.col("k")).alias("k"), F.lit(2).alias("rank")))).otherwise(F.array(F.struct("k", "rank"))))
    names = names.select("src", "module", "family", "whole", F.explode("tries").alias("t")).select("src", "module", "family", "whole", "t.k", "t.rank")
    parents = meet(names.where("whole and rank = 2"), files.select(stem.alias("k"), "family", F.col("path").alias("dst")), ["k", "family"])
    # each suffix once: how common it is over the files that are no tests, or over all where only tests have it, and its files up to the cap
    index = suffix_index(files).select("key", "family", "path", is_test_path(F.col("path")).cast("int").alias("test"))
    sizes = index.groupBy("key", "family").agg(F.count_if(F.col("test") == 0).alias("plain"), F.count("*").alias("n"))
    some = F.when(F.col("plain") > 0, F.col("plain")).otherwise(F.col("n"))
    sizes = sizes.select(F.col("key").alias("k"), "family", (F.col("plain") == 0).cast("int").alias("test"), (some > max_fanout + 1).alias("common"))  # the file that asks is no answer
    sized = meet(names.where("not whole"), sizes, ["k", "family"])
    loose = meet(sized.where("not common"), index.withColumnsRenamed({"key": "k", "path": "dst"}), ["k", "family", "test"])
    none = F.lit(None).cast("string")
    found = (
        hit(exact, F.lit(0)).unionAll(hit(full, F.col("rank"))).unionAll(hit(parents, F.col("rank"))).unionAll(hit(loose, F.col("rank"))).where("src <> dst")
        .unionAll(sized.where("common").select("src", "module", none.alias("dst"), "rank", F.lit(0).alias("test")))
    )
    # at most a few times the cap of rows for each import: they meet in one array
    each = rows.select("src", "module", "local", F.lit(None).cast("struct<dst:string,rank:int,test:int>").alias("hit")).unionAll(found.select("src", "module", F.lit(None).cast("boolean"), F.struct("dst", "rank", "test")))
    each = each.groupBy("src", "module").agg(F.bool_or("local").alias("local"), F.collect_set("hit").alias("hits"))
    best = each.withColumn("hits", F.filter("hits", lambda h: h["rank"] == F.array_min(F.transform("hits", lambda x: x["rank"]))))
    kept = best.withColumn("dsts", F.array_distinct(F.transform(F.filter("hits", lambda h: h["dst"].isNotNull() & (h["test"] == F.array_min(F.transform("hits", lambda x: x["test"])))), lambda h: h["dst"])))
    raw = lambda status: F.array(F.struct(F.col("module").alias("dst"), status.alias("reference_status")))
    many = F.exists("hits", lambda h: h["dst"].isNull()) | (F.size("dsts") > max_fanout)
    edges = (
        F.when(F.size("hits") == 0, raw(F.when(F.col("local"), "unresolved"))).when(many, raw(F.lit("ambiguous")))
        .otherwise(F.transform("dsts", lambda d: F.struct(d.alias("dst"), F.when(F.size("dsts") > 1, "ambiguous").alias("reference_status"))))
    )
    return kept.select("src", "module", F.explode(edges).alias("e")).select("src", "module", "e.dst", "e.reference_status")
