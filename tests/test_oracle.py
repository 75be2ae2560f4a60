"""Queries against the SQL that says the same, over the smallest tables."""

import os

import duckdb
import pytest
from burstline.plans import ORACLES, QUERIES

FOLDER = os.environ.get("BURSTLINE_TESTDATA", "/root/testdata/sf0.001")
#: The event pipeline is checked in two of its queries here; each of them plans all that is before it.
LONG = {"mutual_knn", "event_clusters", "event_ranking", "event_ratio_histogram", "event_size_distribution", "event_report", "segment_tfidf", "knn_edges", "gram_prob_semijoin", "gram_logprob"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    want = sorted((tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want and got
    spark.catalog.clearCache()
