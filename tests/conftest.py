"""One local session for all tests, and the fixture tables in DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query's rows equal its SQL's, whatever their order."""

    def check(query, sql: str) -> None:
        got, want = query(spark, SF), duck.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        left = sorted(repr([r[n] for n in names]) for r in got.collect())
        at = [want.columns.index(n) for n in names]
        assert left == sorted(repr([r[i] for i in at]) for r in want.fetchall())

    return check
