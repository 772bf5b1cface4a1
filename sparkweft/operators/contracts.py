"""Contracts that paths alone show: sibling files of the same stem, and role directories that share a feature token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v
from sparkweft.functions.paths import basename, dirname


def _family() -> Column:
    ext = F.regexp_extract(basename(F.col("path")), r"(\.[^.]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in v.STEM_FAMILY.items() for x in kv])[ext]


def _skipped() -> Column:
    parts = F.split(F.lower("path"), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in v.STEM_SKIP_DIRS])) | F.lower(basename(F.col("path"))).rlike(r"\.(test|spec)(\.|$)")


def stem_scope(path: Column) -> Column:
    """The package of a path of at least three parts: its first part, or frontend/src and the like."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    tier = first.isin("frontend", "backend", "server", "client", "web", "ui") & (F.size(parts) >= 4) & (F.get(parts, F.lit(1)) == "src")
    return F.when(F.size(parts) < 3, None).when(tier, F.concat(first, F.lit("/src"))).otherwise(first)


def normal_stem(path: Column) -> Column:
    """The file's stem in lower case without role suffix, _ as -; null where it is generic, short or a placeholder."""
    stem = F.lower(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", ""))
    ends = "|".join(s[1:] for s in sorted(v.STEM_SUFFIXES, key=len, reverse=True))
    stem = F.translate(F.regexp_replace(stem, rf"(?<=.)\.({ends})$", ""), "_", "-")
    return F.when(~stem.isin(v.GENERIC_STEMS) & (F.length(stem) >= 3) & ~stem.rlike(r"^[\[$-]"), stem)


def sibling_stems(files: DataFrame, most: int = v.MAX_GROUP_FILES) -> DataFrame:
    """(contract, path): files of one scope, family and stem, 2 to most of them, in at least two directories."""
    rows = files.where(~_skipped()).select("path", stem_scope(F.col("path")).alias("scope"), _family().alias("family"), normal_stem(F.col("path")).alias("stem")).na.drop().distinct()
    keys = ["scope", "family", "stem"]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(dirname(F.col("path"))).alias("dirs")).where((F.col("n") >= 2) & (F.col("n") <= most) & (F.col("dirs") >= 2))
    contract = F.concat_ws("::", F.lit("sibling_stem"), "family", F.replace("scope", F.lit("/"), F.lit("::")), "stem")
    return rows.join(groups, keys).select(contract.alias("contract"), "path")


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("ses") & (n > 4), token.substr(F.lit(1), n - 2))
        .when(token.endswith("s") & ~token.endswith("ss") & (n > 4), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def feature_tokens(path: Column) -> Column:
    """Distinct telling tokens of a file's stem: camel and snake parts, singular, four letters, no stop words."""
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    spaced = F.lower(F.regexp_replace(stem, "(?<=[a-z0-9])(?=[A-Z])", "-"))
    tokens = F.transform(F.regexp_extract_all(spaced, F.lit("[a-z0-9]+"), F.lit(0)), singular)
    telling = F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(v.ROLE_TOKEN_STOP) & ~t.rlike("^[0-9]+$"))
    return F.when(stem.rlike(r"^[\[$]"), F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(telling))


def role_of(path: Column) -> Column:
    """(scope, role, kind) of a file in a known role directory, or null."""
    go = F.regexp_extract(path, r"^((?:.*/)?internal)/(db|duckdb|parser|postgres|server|sync)/[^/].*\.go$", 1)
    go_role = F.regexp_extract(path, r"^(?:.*/)?internal/(db|duckdb|parser|postgres|server|sync)/[^/].*\.go$", 1)
    web_role = F.regexp_extract(path, r"^frontend/src/(components|pages)/.+\.(?:tsx?|jsx?|svelte|vue)$", 1)
    made = lambda scope, role, kind: F.struct(scope.alias("scope"), role.alias("role"), F.lit(kind).alias("kind"))
    return (
        F.when(go_role != "", made(go, go_role, "go_internal"))
        .when(web_role != "", made(F.lit("frontend/src"), web_role, "web_frontend"))
        .when(path.rlike(r"^src-tauri/src/commands/.+\.rs$"), made(F.lit("tauri"), F.lit("commands"), "tauri_command_page"))
        .when(path.rlike(r"^src/pages/.+\.(tsx?|jsx?|svelte|vue)$"), made(F.lit("tauri"), F.lit("pages"), "tauri_command_page"))
    )


def role_features(files: DataFrame, most: int = v.MAX_GROUP_FILES) -> DataFrame:
    """(contract, path): files of two roles that go together and share a token, at most `most` files to a contract."""
    rows = files.where(~_skipped()).select("path", role_of(F.col("path")).alias("r"), feature_tokens(F.col("path")).alias("tokens")).where("r is not null")
    rows = rows.select("path", "r.*", F.explode("tokens").alias("token")).distinct()
    pairs = [("go_internal", a, b) for a, b in v.GO_ROLE_PAIRS] + [("web_frontend", "components", "pages"), ("tauri_command_page", "commands", "pages")]
    allowed = rows.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("role_a"), F.lit(b).alias("role_b")) for k, a, b in pairs])).alias("p")).select("p.*")
    sides = rows.join(F.broadcast(allowed), "kind").where("role = role_a or role = role_b")  # ten rows
    keys = ["kind", "scope", "role_a", "role_b", "token"]
    good = sides.groupBy(*keys).agg(F.countDistinct("role").alias("roles"), F.countDistinct("path").alias("n")).where((F.col("roles") == 2) & (F.col("n") <= most))
    contract = F.concat_ws("::", F.lit("role_feature"), "kind", F.replace("scope", F.lit("/"), F.lit("::")), F.concat_ws("__", "role_a", "role_b"), "token")
    return sides.join(good, keys).select(contract.alias("contract"), "path").distinct()
