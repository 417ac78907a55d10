"""Queries with SQL give the same columns, types and rows on given tables."""

import pytest
from compare import connect, difference

from surtscope.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    found = difference(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])
    assert found is None, found


@pytest.mark.parametrize("partitions", [12, 70, 600])
def test_exact_dedup_agrees_at_every_depth_of_the_tree(spark, partitions):
    """Two, three and four levels of merging."""
    name, before = "op7_tree_exact_dedup", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = difference(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found is None, found
