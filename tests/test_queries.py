"""Every registered query that has SQL agrees with DuckDB on the smallest tables; the others return rows."""

import math
import random
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def catalogue_names():
    from tessella.plans import catalogue_queries

    return sorted(catalogue_queries.queries())


@pytest.mark.parametrize("name", catalogue_names())
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_means_of_fifty_fall_where_the_sql_puts_them(spark, tmp_path):
    """Three values of exact mean 50, whose sum in doubles depends on the order: by event they come as click, view, click."""
    rng, found = random.Random(0), []
    while len(found) < 20:
        a, b = (round(rng.uniform(0.01, 75), 2) for _ in range(2))
        c = round(150 - a - b, 2)
        if ((a + b + c) / 3 > 50) != ((a + c + b) / 3 > 50) and c > 0:
            found.append((a, b, c))
    at = lambda i: datetime(2024, 1, 1, 12, 0, i)
    data = [(3 * u + i, at(i), u, "view" if i == 1 else "click", v, "{}") for u, x in enumerate(found) for i, v in enumerate(x)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(c.sql(entry.oracle_sql()["dose_response"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["dose_response"](spark, str(tmp_path)).collect()) == want
