"""Every query of the engine against its SQL in DuckDB, on the smallest data folder."""

import os

import duckdb
import pytest

from moraine.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)

    def one(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)):
            return "nan" if v != v else round(float(v), 6)
        return str(v)

    return sorted(str([one(r[i]) for i in at]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(names)
        assert plain(rows, df.columns) == plain(got.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
