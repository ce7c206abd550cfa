import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_both_sides_of_every_flag(spark):
    for name in ("qa1_qa13_quality_flags", "tx9_tx16_characters", "ga1_ga13_flags"):
        df = entry.queries()[name](spark, SF)
        rows = df.collect()
        for c, kind in df.dtypes:
            if kind == "boolean" and c not in ("audit_sentence_incomplete", "audit_roundtrip_mismatch"):
                assert {True, False} <= {r[c] for r in rows}, (name, c)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
