"""The operators' registered queries against their check SQL, and their columns."""

from __future__ import annotations

import duckdb
import pytest

from compare import TABLES, bag
from portlens.llm.queries import check_sql, registered

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator() -> None:
    assert sorted(int(name[2:].split("_")[0]) for name in registered() if name != "pipeline") == list(range(1, 14))
    assert set(check_sql()) <= set(registered())


@pytest.mark.parametrize("name", sorted(check_sql()))
def test_query_matches_check(name, spark) -> None:
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = registered()[name](spark, DATA)
    columns = [d[0] for d in base.execute(check_sql()[name]).description]
    assert bag(frame.columns, [tuple(r) for r in frame.collect()]) == bag(columns, base.fetchall())
