"""Graph contracts: canonical keys, substrates, validation, metrics and cross-kind collisions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions import vocabulary as v

#: The longest identifiers, paths and names of a valid graph.
MAX_ID, MAX_PATH, MAX_NAME = 1600, 1024, 512


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc_fold(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: nfc(F.col(c)) for c in columns})


def canonical_key(kind: Column, node_id: Column, name: Column) -> Column:
    """What edges call a resource: its name for tables and config keys, its id without prefix for columns and infrastructure,
    its whole id for the other contracts."""
    bare = F.regexp_replace(node_id, "^(column|iac_resource|k8s_resource)::", "")
    key = F.when(kind.isin("table", "config_key"), name).when(kind.isin("column", "iac_resource", "k8s_resource"), bare).otherwise(F.coalesce(node_id, name))
    return F.nullif(F.trim(key), F.lit(""))


def substrate_of_edge(kind: Column, dst: Column) -> Column:
    """code_structure, imports and calls by kind; contract edges by what their target's prefix says, else the database."""
    prefix = F.regexp_extract(dst, "^([a-z0-9_]+)::", 1)
    return (
        F.when(kind == "contains", "code_structure").when((kind == "imports") & (prefix == "route"), "routes").when(kind == "imports", "imports").when(kind == "calls", "calls")
        .when(kind == "reads_config", "config").when(kind.isin("alters_col", "queries_col"), "database").when(prefix.isin("", "table"), "database").otherwise(prefix)
    )


def validation_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule; no row where nothing is wrong."""
    twice = nodes.groupBy("id", "kind", "path").agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated_node").alias("rule"), F.count("*").alias("n"))
    bad = lambda rows, rule, cond: rows.where(cond).agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    out = twice
    for rows, rule, cond in (
        (nodes, "unknown_node_kind", ~F.col("kind").isin(v.NODE_KINDS)), (nodes, "bad_id", F.coalesce((F.length("id") == 0) | (F.length("id") > MAX_ID), F.lit(True))),
        (nodes, "bad_path", F.coalesce((F.length("path") == 0) | (F.length("path") > MAX_PATH) | F.col("path").startswith("/"), F.lit(True))),
        (edges, "unknown_edge_kind", ~F.col("kind").isin(v.EDGE_KINDS)), (edges, "bad_reference_status", ~F.col("reference_status").isin(v.REFERENCE_STATUS)),
    ):
        out = out.unionAll(bad(rows, rule, cond))
    return out.where("n > 0")


def cross_kind_collisions(nodes: DataFrame) -> DataFrame:
    """Canonical keys that nodes of several kinds own; their edges are ambiguous."""
    return nodes.where("canonical_key is not null").groupBy("canonical_key").agg(F.countDistinct("kind").alias("kinds")).where("kinds > 1")


def metrics(edges: DataFrame) -> DataFrame:
    """(substrate, edges, unresolved, ambiguous)."""
    rows = edges.withColumn("substrate", substrate_of_edge(F.col("kind"), F.col("dst")))
    return rows.groupBy("substrate").agg(F.count("*").alias("edges"), F.count_if(F.col("reference_status") == "unresolved").alias("unresolved"), F.count_if(F.col("reference_status") == "ambiguous").alias("ambiguous"))
