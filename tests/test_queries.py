"""Registered queries of the library against their SQL, on the smallest tables."""

import duckdb
import pytest

from luminode import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v.__class__.__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    answer = duck.execute(plans.ORACLE_SQL[name])
    order = [c[0] for c in answer.description]
    assert sorted(order) == names
    want = sorted(repr(tuple(plain(r[order.index(c)]) for c in names)) for r in answer.fetchall())
    assert got == want
