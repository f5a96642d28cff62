"""Registered queries beside their SQL on the smallest tables, and the entry point."""

import os

import pytest

import __spark_entry__ as entry
from graphsieve.plans import queries as plans
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
#: Queries that SQL can't express, and the tests that check what they do.
COVERED = {
    **{n: "test_graph.py or test_fusion.py: trained methods" for n in plans.QUERIES if n.startswith("neural_")},
    "composed_method": "test_fusion.py: methods of parts",
    "peripheral_mismatch": "test_graph.py: detectors against numpy",
    "conformity": "test_graph.py: detectors against numpy",
    "isolation_conformity": "test_extensions.py: the registered query against walks by hand",
    "spectral_gap": "test_extensions.py: the registered query against a dense solver",
    "spectral": "test_graph.py: detectors against numpy",
    "label_propagation_communities": "test_graph.py: communities",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, con, name):
    assert difference(con, spark, FOLDER, name) == ""


def test_every_query_has_sql_or_a_test():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL) | set(COVERED) and not set(plans.ORACLE_SQL) & set(COVERED)


def test_entry(spark):
    assert len(entry.entry(spark).collect()) > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
