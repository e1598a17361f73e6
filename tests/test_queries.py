"""Every market query that has SQL gives the rows that the SQL gives on small tables."""

import math
import os

import duckdb
import pytest

from orderloom.plans import registry

SF = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_compared_replay_takes_every_event(spark, con):
    ords = [r[0] for r in con.execute("SELECT event_id FROM events ORDER BY 1").fetchall()]
    longest = max((n for n in SQL if n.startswith("mbp1_rebuild")), key=lambda n: registry.queries()[n](spark, SF).count())
    assert [r.ord for r in registry.queries()[longest](spark, SF).orderBy("ord").collect()] == ords and len(ords) > 600
