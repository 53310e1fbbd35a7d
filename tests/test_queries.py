"""Every registered catalog query against its oracle on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from corvane import queries as catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalog.ORACLES[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == columns
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    b = sorted(([plain(r[order.index(c)]) for c in columns] for r in want.fetchall()), key=repr)
    assert a == b


def test_bookmark_export_holds_whole_texts(spark):
    from corvane.queries.sources import _export

    t = catalog.Tables(spark, SF)
    got = _export(t)["posts"].filter("observed_at IS NOT NULL").select("native_id", "text").collect()
    want = t.documents.selectExpr("CAST(doc_id AS STRING)", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
