"""Every query against its SQL in DuckDB, with names, rows and values."""

import datetime
import decimal

import duckdb
import pytest

from tallyloom import catalogue

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return ("number", str(x.normalize() + 0))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert df.columns
    if name not in catalogue.SQL:
        assert got
        return
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql()) and set(catalogue.QUERIES) <= set(__spark_entry__.queries())
