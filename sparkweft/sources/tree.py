"""Source trees as DataFrames: a guarded binary scan of files, generated-file rules, and blob hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v

# Extensions with their language, and the limits of the guards.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".rb": "ruby",
    ".php": "php", ".cs": "csharp", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".kt": "kotlin", ".swift": "swift", ".dart": "dart", ".ex": "elixir",
    ".exs": "elixir", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".vue": "vue", ".svelte": "svelte", ".astro": "astro",
    ".tf": "terraform", ".proto": "protobuf", ".graphql": "graphql", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".env": "env", ".ini": "ini", ".cfg": "ini",
}
MAX_BYTES, MAX_SQL_BYTES, MAX_LINE, MAX_LINES, BINARY_PROBE = 1_500_000, 12_000_000, 250_000, 100_000, 8192


def scan(spark: SparkSession, root: str, hidden: list[str] | None = None) -> DataFrame:
    """(path relative to root, content, length) of all files below root but those in skipped directories.

    Spark's file listing leaves out names that start with a dot or an underscore; hidden names such files one by one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if hidden:
        files = files.unionAll(spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{h}" for h in hidden]))
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(path.alias("path"), "content", "length")
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in v.SKIP_DIRS])))


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def guarded(files: DataFrame) -> DataFrame:
    """files with language, guard (why a file is not read, or null) and blob (the version-control hash of its content)."""
    limit = F.when(F.lower("path").endswith(".sql"), MAX_SQL_BYTES).otherwise(MAX_BYTES)
    head = F.substring("content", 1, BINARY_PROBE)
    # only what is within the size limit is looked at as text
    text = F.when(F.col("length") <= limit, F.col("content").cast("string"))
    lines = F.split(text, "\n")
    guard = (
        F.when(F.col("length") > limit, "too_large")
        .when(F.contains(head, F.unhex(F.lit("00"))), "binary")
        .when(F.size(lines) > MAX_LINES, "too_many_lines")
        .when(F.array_max(F.transform(lines, F.length)) > MAX_LINE, "long_line")
    )
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "utf-8"), F.unhex(F.lit("00")), F.col("content")))
    return files.withColumns({"language": language_of(F.col("path")), "guard": guard, "blob": blob, "lines": F.size(lines)})


def glob_regex(pattern: str) -> str:
    """An attributes-file glob as a regular expression over whole relative paths: ** crosses directories, * and ? don't."""
    anchored = "/" in pattern.strip("/")
    out, i, p = "", 0, pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + "$"


def generated_rules(text: str) -> list[tuple[str, bool]]:
    """(regex, generated) for each line of an attributes file that marks generated or vendored files, in order."""
    out = []
    for line in text.splitlines():
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        for attr in parts[1:]:
            m = re.fullmatch(r"(-?)linguist-(?:generated|vendored)(?:=(true|false))?", attr)
            if m:
                out.append((glob_regex(parts[0]), not m[1] and m[2] != "false"))
    return out


def is_generated(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that fits decides; without one, known suffixes and directories."""
    out = path.rlike(r"(\.min\.(js|css)|\.pb\.go|_pb2\.py|\.g\.dart|\.generated\.[a-z]+)$|(^|/)(generated|__generated__|vendor|third_party)/")
    for regex, said in rules:
        out = F.when(path.rlike(regex), said).otherwise(out)
    return out
