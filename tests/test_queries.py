"""Every data-flow query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def _plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = sorted(got.columns)
    assert sorted(d[0] for d in want.description) == names
    places = {d[0]: i for i, d in enumerate(want.description)}
    left = sorted(repr([_plain(r[c]) for c in names]) for r in got.collect())
    right = sorted(repr([_plain(r[places[c]]) for c in names]) for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
