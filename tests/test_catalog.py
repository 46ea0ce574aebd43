"""Every catalog query against its DuckDB oracle on the smallest tables,
and the flagship entry point."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from parity import rows_of  # noqa: E402

from tidepool.sources.tables import DRIVER_TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _keys():
    from __spark_entry__ import queries

    return sorted(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["window_start", "window_end", "unit", "avg_heart_rate", "out_of_range_count", "reading_count"]
    assert df.count() > 0


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, con, key):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[key](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(key)
    if sql is None:
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, rows) == rows_of(dcols, cur.fetchall())
