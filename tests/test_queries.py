"""Every query with an oracle gives the rows of its SQL."""

from pathlib import Path

import pytest

from tallyloom.plans import landed, landed_oracles, more, more_oracles, oracles, queries, runs, runs_oracles

ORACLES = oracles.ORACLES | more_oracles.ORACLES | landed_oracles.ORACLES | runs_oracles.ORACLES
QUERIES = queries.QUERIES | more.QUERIES | landed.QUERIES | runs.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(compare, name):
    compare(name)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_identities_are_made_in_many_tasks(spark):
    """Parts lie in one small file, but their keys and weights are made in as many tasks as a shuffle has."""
    from tallyloom.sources import adapter

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sf_dir = "/root/testdata/sf0.001"
    assert adapter.catalog(spark, sf_dir).rdd.getNumPartitions() == parts > 1
    assert adapter.catalog(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_feed_without_some_stores_equals_sql(compare, tmp_path):
    """Line items can name a supplier that is not there or none; their deals take no place in the order of stores."""
    import duckdb

    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if file.stem not in ("lineitem", "supplier"):
            (tmp_path / file.name).symlink_to(file)
    items = "select * replace (case when l_suppkey = 6 then null else l_suppkey end as l_suppkey) from '/root/testdata/sf0.001/lineitem.parquet'"
    duckdb.connect().sql(f"copy ({items}) to '{tmp_path}/lineitem.parquet'")
    duckdb.connect().sql(f"copy (from '/root/testdata/sf0.001/supplier.parquet' where s_suppkey % 5 <> 0) to '{tmp_path}/supplier.parquet'")
    assert 0 < compare("o7_deal_feed", str(tmp_path)) < compare("o7_deal_feed")
