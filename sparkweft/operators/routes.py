"""Cross-tier routes: their segments, specificity, matching by the places where both sides are concrete, cross-repository suffix keys.

A route is an array of segments; a segment is concrete or a parameter, written {}. Everything here reads those arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v

# How frameworks write a parameter, and what of a pattern is no part of a path.
PARAMETER = r"\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_]\w*|<[^>]*>|\[[^\]]*\]"
NO_PATH = r"\(\?[^)]*\)|\(\.\*\)|\^|\$"
ANY = "{}"


def segments(route: Column) -> Column:
    """The segments of a route as it is written: query and fragment dropped, parameters as {}, in lower case; null for none."""
    path = F.trim(F.regexp_extract(route, r"^([^?#]*)", 1))
    plain = F.lower(F.regexp_replace(F.regexp_replace(path, PARAMETER, ANY), NO_PATH, ""))
    return F.when(route != "", F.filter(F.split(plain, "/"), lambda s: s != ""))


def normalize_route(route: Column) -> Column:
    """The route as one string from its segments; empty for null and empty."""
    return F.coalesce(F.concat(F.lit("/"), F.array_join(segments(route), "/")), F.lit(""))


def is_specific(route: Column) -> Column:
    """Names a resource: not a common route, two segments with a concrete first, or one that is a parameter in part."""
    parts = F.filter(F.split(route, "/"), lambda s: s != "")
    first = F.get(parts, F.lit(0))
    named = F.when(F.size(parts) > 1, first != ANY).otherwise(first.contains(ANY) & (first != ANY))
    return F.coalesce(named & ~route.isin(v.UBIQUITOUS_ROUTES), F.lit(False))


def from_the_end(route: Column) -> Column:
    return F.reverse(F.filter(F.split(route, "/"), lambda s: s != ""))


def match_routes(a: Column, b: Column) -> Column:
    """The same contract: place by place from the end a parameter or equal, equal at one place; if one is longer, two places at least."""
    x, y = from_the_end(a), from_the_end(b)
    place = lambda p, q: F.when((p == ANY) | (q == ANY), 0).when(p == q, 1).when(p != q, -1)
    places = F.zip_with(x, y, place)  # null where only one side has a segment
    long = (F.size(x) == F.size(y)) | ((F.size(x) > 1) & (F.size(y) > 1))
    return F.coalesce(long & (F.array_min(places) >= 0) & (F.array_max(places) == 1), F.lit(False))


def _shaped(rows: DataFrame, name: str) -> DataFrame:
    """(name, parts, shape): distinct specific routes with their segments from the end, and 1 for each concrete one, 0 for each parameter."""
    parts = from_the_end(F.col("route"))
    one = rows.select("route").distinct().where(is_specific(F.col("route"))).select(F.col("route").alias(name), parts.alias("parts"))
    return one.withColumn("shape", F.array_join(F.transform("parts", lambda s: F.when(s == ANY, "0").otherwise("1")), ""))


def match_pairs(defined: DataFrame, requested: DataFrame) -> DataFrame:
    """(definer, requester, route, url): routes and urls that match.

    For each pair of shapes that occur, routes and urls of them meet by an equi-join on all segments at the places where both
    are concrete, which is the whole condition. So a segment that all share, such as api, is never a key alone, and every
    row of the join is a match. Shapes are few, whatever the routes: one string of 0 and 1 for each way parameters lie in them.
    """
    d, u = _shaped(defined, "r"), _shaped(requested, "u")
    n = F.least(F.length("ds"), F.length("us"))
    common = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when((F.substring("ds", i, F.lit(1)) == "1") & (F.substring("us", i, F.lit(1)) == "1"), "1").otherwise("0")), "")
    shapes = d.select(F.col("shape").alias("ds")).distinct().join(u.select(F.col("shape").alias("us")).distinct(), (F.length("ds") == F.length("us")) | (F.least(F.length("ds"), F.length("us")) > 1))
    shapes = shapes.select("ds", "us", common.alias("common")).where(F.col("common").contains("1"))
    places = F.filter(F.transform(F.split("common", ""), lambda c, i: F.when(c == "1", F.get("parts", i))), lambda s: s.isNotNull())
    keyed = lambda side, own, name: side.join(shapes, side["shape"] == shapes[own]).select(name, "ds", "us", F.array_join(places, "/").alias("key"))
    pairs = keyed(d, "ds", "r").join(keyed(u, "us", "u"), ["ds", "us", "key"]).select("r", "u")
    # distinct routes meet first; files come back to those that match
    d = defined.select(F.col("path").alias("definer"), F.col("route").alias("r")).distinct()
    q = requested.select(F.col("path").alias("requester"), F.col("route").alias("u")).distinct()
    hit = pairs.join(d, "r").join(q, "u").where("definer <> requester")
    return hit.select("definer", "requester", F.col("r").alias("route"), F.col("u").alias("url"))


def single_definer(pairs: DataFrame) -> DataFrame:
    """Adds whether the url has one definer only; with several it is ambiguous."""
    n = pairs.groupBy("url").agg(F.countDistinct("definer").alias("n"))
    return pairs.join(n, "url").select("definer", "requester", "route", "url", (F.col("n") == 1).alias("sure"))


def suffix_keys(route: Column, most: int = 5) -> Column:
    """Tails of a route that start at a concrete segment and end at its last one, two segments at least, the longest first, at most so many
    (the key's own definition)."""
    back = from_the_end(route)
    skip = F.array_position(F.transform(back, lambda s: s != ANY), True)  # parameters behind the last concrete segment
    core = F.when(skip > 0, F.reverse(F.slice(back, skip.cast("int"), F.size(back)))).otherwise(F.expr("cast(array() as array<string>)"))
    tails = F.transform(core, lambda s, i: F.when((s != ANY) & (i < F.size(core) - 1), F.array_join(F.slice(core, i + 1, F.size(core)), "/")))
    return F.slice(F.filter(tails, lambda t: t.isNotNull()), 1, most)
