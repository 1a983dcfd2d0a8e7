"""Every query with SQL against DuckDB over the smallest tables, and every query's schema."""

import hashlib
from difflib import SequenceMatcher
from pathlib import Path

import pytest

import __spark_entry__ as entry
from drawloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = db.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert [[str(x) for x in r] for r in got] == [[str(x) for x in r] for r in want]


def test_only_page_alignment_has_no_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"page_alignment"}


def test_page_alignment_restated(spark):
    """Pages of each pair by plain loops: all scores, the best first, higher page numbers first on ties."""

    def pages(gone):
        out = {}
        for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect():
            if gone not in r.url:
                own = out.setdefault(r.page_id // 8, [])
                own.append((int(hashlib.md5(r.url.encode()).hexdigest()[:16], 16), r.html[:1500]))
        return out

    before, after = pages("?page="), pages("#top")
    want = []
    for pair in before.keys() | after.keys():
        b, a = before.get(pair, []), after.get(pair, [])
        most = max(len(b), len(a))
        scored = []
        for i, (h, t) in enumerate(b):
            for j, (g, u) in enumerate(a):
                score = (1 - (h ^ g).bit_count() / 64) * 0.55 + SequenceMatcher(None, t, u).ratio() * 0.35 + 1.0 * 0.10 - abs(i - j) / most * 0.03
                if score >= 0.45:
                    scored.append((score, i, j))
        rows, columns = set(range(len(b))), set(range(len(a)))
        for score, i, j in sorted(scored, reverse=True):
            if i in rows and j in columns:
                rows.remove(i)
                columns.remove(j)
                want.append((pair, i, j, round(score, 9)))
        want += [(pair, i, None, None) for i in rows] + [(pair, None, j, None) for j in columns]
    found = catalog.QUERIES["page_alignment"](spark, SF).collect()
    got = [(r.pair_id, r.before_index, r.after_index, None if r.score is None else round(r.score, 9)) for r in found]
    assert len(got) > 10 and sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
