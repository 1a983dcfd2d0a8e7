"""Queries with SQL against the other engine over the smallest tables."""

from pathlib import Path

import pytest

from drawloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in found.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want
