"""Every query with SQL gives the second engine's rows."""

import os

import pytest
from harness import differences, second_engine

from tidemark.plans import catalogue

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return second_engine(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert differences(df.collect(), df.columns, con, catalogue.ORACLE_SQL[name]) == ""


def test_names_and_flagship():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
