"""Texts to be parsed are spread over all cores, however few files and row groups their tables have."""

import os

import pytest

from sparkweft.plans import catalogue
from sparkweft.sources.projection import relation

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", ["source_file", "sql_file"])
def test_dealt_rows_are_the_same(spark, name):
    plain, dealt = relation(spark, DIR, name), relation(spark, DIR, name, parts=6)
    assert dealt.count() == plain.count() and dealt.exceptAll(plain).count() == 0


@pytest.mark.parametrize("query", ["build_graph_nodes", "build_graph_edges", "sql_column_edges"])
def test_parsing_uses_all_cores(spark, monkeypatch, query):
    parts = []

    def stop(s, d, n, parts_=None, **how):
        parts.append(how.get("parts"))
        raise StopIteration

    monkeypatch.setattr(catalogue, "relation", stop)
    with pytest.raises(StopIteration):
        catalogue.QUERIES[query](spark, DIR)
    assert parts == [2 * spark.sparkContext.defaultParallelism]
