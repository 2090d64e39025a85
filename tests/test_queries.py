"""Every registered query against its check SQL on the smallest data."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, bag
from conftest import DATA
from portlens.cases import inputs, queries
from portlens.cases.queries import Inputs, check_sql, registered

QUERIES = registered()
CHECKS = check_sql()


@pytest.fixture(scope="module")
def base() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def test_every_query_has_a_check() -> None:
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check(name, spark, base) -> None:
    frame = QUERIES[name](spark, DATA)
    columns = [d[0] for d in base.execute(CHECKS[name]).description]
    want = bag(columns, base.fetchall())
    assert sorted(frame.columns) == sorted(columns)
    assert bag(frame.columns, [tuple(r) for r in frame.collect()]) == want


def test_entry_runs(spark) -> None:
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["effective_complexity"] in ("Blocker", "High", "Medium")


def test_events_of_one_row_group_are_dealt_over_tasks(spark, tmp_path, monkeypatch) -> None:
    monkeypatch.setattr(queries, "EVENT_ROWS", 100, raising=False)
    spark.read.parquet(f"{DATA}/events.parquet").limit(1000).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = Inputs(spark, str(tmp_path))
    assert found.table("events").rdd.getNumPartitions() == 1
    assert len(found.profile.inputFiles()) == 10 and found.profile.count() == 1000
    assert found.view(inputs.SHAPE_EVENTS, dealt=True).rdd.getNumPartitions() == 10
