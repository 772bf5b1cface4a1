"""Offline evaluation: do coupled files change together more than controls do, and how well do detectors recall."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.paths import dirname

#: How many times a control's rate has to be beaten, and the fewest cross-directory pairs for a verdict.
BEATS, MIN_CROSS_PAIRS = 1.3, 20


def controls(files: DataFrame, per_file: int = 2, seed: int = 7, within: Column | None = None) -> DataFrame:
    """(path_a, path_b): control pairs. Files are put in an order by a seeded md5 and each is paired with the next ones: repeatable, and
    linear in the files. The order runs per block of the hash's first digits, so many that a block has some thousand files at any
    size. With within, files are paired inside its groups (a directory: same-directory controls)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), "path"))
    digits = max(0, math.floor(math.log(max(1, files.count()) / 1000, 16)))
    blocks = files.select("path", h.alias("h"), (F.substring(h, 1, digits) if within is None else within).alias("block")).distinct()
    order = Window.partitionBy("block").orderBy("h", "path")
    pairs = None
    for k in range(1, per_file + 1):
        one = blocks.select("path", F.lead("path", k).over(order).alias("other")).where("other is not null")
        pairs = one if pairs is None else pairs.unionAll(one)
    return pairs.select(F.least("path", "other").alias("path_a"), F.greatest("path", "other").alias("path_b")).where("path_a <> path_b").distinct()


def change_rates(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """(label, cross, pairs, together): of pairs (path_a, path_b, label), in one directory or across, how many ever change together."""
    rows = pairs.join(counted.select("path_a", "path_b", F.lit(1).alias("hit")), ["path_a", "path_b"], "left")
    cross = dirname(F.col("path_a")) != dirname(F.col("path_b"))
    return rows.groupBy("label", cross.alias("cross")).agg(F.count("*").alias("pairs"), F.count("hit").alias("together"))


def verdict(rates: DataFrame) -> DataFrame:
    """One row: rates of coupled and control pairs over all and across directories, whether the test applies, and its outcome."""
    rate = lambda label, cross: F.sum(F.when((F.col("label") == label) & (F.col("cross") if cross else F.lit(True)), F.col("together"))) / F.sum(F.when((F.col("label") == label) & (F.col("cross") if cross else F.lit(True)), F.col("pairs")))
    one = rates.agg(
        rate("coupled", False).alias("coupled"), rate("control", False).alias("control"), rate("coupled", True).alias("coupled_cross"), rate("control", True).alias("control_cross"),
        F.coalesce(F.sum(F.when((F.col("label") == "coupled") & F.col("cross"), F.col("pairs"))), F.lit(0)).alias("cross_pairs"),
    )
    applicable = F.coalesce((F.col("cross_pairs") >= MIN_CROSS_PAIRS) & (F.col("control_cross") > 0), F.lit(False))
    real = F.coalesce((F.col("coupled") > BEATS * F.col("control")) & (F.col("coupled_cross") > BEATS * F.col("control_cross")), F.lit(False))
    return one.select("*", applicable.alias("applicable"), (applicable & real).alias("real"))


def detector_scores(labelled: DataFrame, structure: DataFrame, history: DataFrame) -> DataFrame:
    """(mode, tp, fp, fn, tn) of labelled pairs (path_a, path_b, related) for graph, cochange, union and corroborated."""
    rows = labelled.join(structure.select("path_a", "path_b", F.lit(True).alias("g")), ["path_a", "path_b"], "left").join(history.select("path_a", "path_b", F.lit(True).alias("h")), ["path_a", "path_b"], "left").na.fill(False, ["g", "h"])
    modes = F.array(*[F.struct(F.lit(n).alias("mode"), c.alias("said")) for n, c in (("graph", F.col("g")), ("cochange", F.col("h")), ("union", F.col("g") | F.col("h")), ("corroborated", F.col("g") & F.col("h")))])
    long = rows.select("related", F.explode(modes).alias("m")).select("related", "m.*")
    said, true = F.col("said"), F.col("related")
    return long.groupBy("mode").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def review(path: str, structure: DataFrame, history: DataFrame) -> DataFrame:
    """(candidate, static, historical) for one file: whether each source observed a relation."""
    side = lambda d, name: d.where((F.col("path_a") == path) | (F.col("path_b") == path)).select(F.when(F.col("path_a") == path, F.col("path_b")).otherwise(F.col("path_a")).alias("candidate"), F.lit("observed").alias(name)).distinct()
    return side(structure, "static").join(side(history, "historical"), "candidate", "full").na.fill("not_observed")
