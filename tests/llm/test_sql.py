"""Operators that SQL can express against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = sorted(got.columns)
    assert sorted(d[0] for d in want.description) == names
    places = {d[0]: i for i, d in enumerate(want.description)}
    plain = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    assert sorted(repr([plain(r[c]) for c in names]) for r in got.collect()) == sorted(repr([plain(r[places[c]]) for c in names]) for r in want.fetchall())
