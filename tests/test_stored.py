"""Queries that read a relation several times read what was written once."""

import os

import pytest

from sparkweft.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["claim_adjacency", "dampened_pairs"])
def test_relations_are_worked_out_once(spark, name):
    plan = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "user_id" not in plan


def test_one_table_for_all_uses(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalogue, "relation", lambda s, d, name: made.append(name) or s.range(3))
    r = catalogue.Stored(spark, "")
    assert r.claim.count() == r.claim.count() == 3 and r.claim is r.claim and made == ["claim"]
