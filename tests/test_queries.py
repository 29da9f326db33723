"""Every ready-made query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from dossier import plans

from .oracle import connection, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, con, name):
    entry = plans.QUERIES[name]
    df = entry.build(spark, SF_DIR)
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, entry.sql) is None


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_result_does_not_depend_on_shuffle_partitions(spark):
    found = []
    for partitions in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = plans.QUERIES["best_documents"].build(spark, SF_DIR).collect()
        packed = plans.QUERIES["packed_blocks"].build(spark, SF_DIR).collect()
        found.append((sorted(rows), sorted(packed)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]
