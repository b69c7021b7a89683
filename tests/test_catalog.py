"""Every query with SQL against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from vane import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        df[k] = df[k].map(lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or x != x else repr(float(x) + 0.0) if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got.astype(str), want.astype(str))


#: Queries that may have no rows on the smallest tables.
MAY_BE_EMPTY = {"host_outliers", "lone_outliers", "slow_spans", "paging_examples", "paging_scores", "paging_readiness", "paging_answers", "rolling_accuracy"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(rows.columns) and (len(rows) or name in MAY_BE_EMPTY)


def test_orders(spark):
    rank = {"critical": 0, "warning": 1}
    rows = catalog.QUERIES["insights_ordered"](spark, SF).collect()
    assert len(rows) > 3 and [r.id for r in rows] == [r.id for r in sorted(sorted(rows, key=lambda r: r.id), key=lambda r: (rank[r.severity], -r.time.timestamp()))]
    times = [r.timestamp for r in catalog.QUERIES["query_metrics"](spark, "/root/testdata/sf0.01").collect()]
    assert len(times) > 3 and times == sorted(times)
    events = [r.time for r in catalog.QUERIES["timeline"](spark, SF).collect()]
    assert events == sorted(events, reverse=True)
