"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(work / "warehouse"))
        .config("spark.checkpoint.dir", str(work / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def compare(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()

    def check(name: str, sf_dir: str = SF) -> int:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        df = queries[name](spark, sf_dir)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        made = con.sql(oracles[name])
        want = rows_of(made.columns, made.fetchall())
        assert got[0] == want[0], f"{name}: columns {got[0]} and {want[0]}"
        if got[1] != want[1]:
            extra = [r for r in got[1] if r not in set(want[1])][:3]
            lack = [r for r in want[1] if r not in set(got[1])][:3]
            raise AssertionError(f"{name}: {len(got[1])} and {len(want[1])} rows; only here {extra}; only there {lack}")
        return len(got[1])

    return check
