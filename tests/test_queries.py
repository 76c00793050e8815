"""All core queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

from banyan.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([cell(v) for v in x])
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    r = duck.execute(registry.SQL[name])
    cols = [c[0] for c in r.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(tuple(cell(row[i]) for i in order) for row in r.fetchall())


def test_blobs_hold_all_reviews(spark):
    blobs = registry.QUERIES["text_blob"](spark, D)
    r = spark.read.parquet(f"{D}/review_fact.parquet").filter("review_text is not null").selectExpr("sum(length(review_text)) n", "count(*) c", "count(distinct store_id) g").first()
    assert blobs.selectExpr("sum(length(text))").first()[0] == r.n + r.c - r.g


def test_dates_of_all_forms(spark):
    dates = registry.QUERIES["date_multi_parse"](spark, D)
    short = spark.read.parquet(f"{D}/be_ratings.parquet").filter("trim(rated_at) rlike '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2} '").join(dates, "rating_row")
    assert dates.count() == spark.read.parquet(f"{D}/be_ratings.parquet").count() and short.filter("at is null or at not like '20%'").count() == 0


def test_pages_hold_the_text(spark):
    from banyan.plans import base, scalar_queries

    page = scalar_queries._page(base.Tables(spark, D)).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert page.count() and page.filter("length(html) < length(text) + 100").count() == 0
