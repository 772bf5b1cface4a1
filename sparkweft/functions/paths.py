"""Path predicates and parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)


def is_test_path(path: Column) -> Column:
    """A test directory on the way, or a test's file name; the CamelCase endings count by case."""
    in_dir = F.lower(path).rlike("(^|/)(tests?|specs?|__tests__|examples?|testing)/")
    named = basename(path).rlike(r"(^test_|_test\.|\.test\.|_spec\.|\.spec\.)|(Tests?\.|Specs?\.)")
    return F.coalesce((path != "") & (in_dir | named), F.lit(False))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def normalize_parts(path: Column) -> Column:
    """. and .. taken out of a slash-separated path, leading .. kept: what posixpath.normpath does to relative paths."""
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & last.isNotNull() & (last != ".."), F.slice(acc, 1, F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def module_stem(module: Column) -> Column:
    """A dotted module as a path without its ending."""
    return F.translate(module, ".", "/")


def path_stem(path: Column) -> Column:
    """The path under which a module finds a file: without its ending, a package's file by its directory."""
    return F.regexp_replace(path, r"(/__init__)?[.]py$", "")
