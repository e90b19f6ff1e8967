"""What must hold when tables are large, or not on a local disk."""

import os
import re
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrameWriter

from moraine import Engine
from moraine.errors import ValidationError
from moraine.plans import predicates as P
from moraine.queries import QUERIES
from moraine.sources import metadata
from moraine.sources.commit import Change, Transaction
from moraine.sources.writer import Writer

from .lake import engine
from .test_queries import SF

MANY = 20_000


@pytest.fixture
def lake(spark, tmp_path):
    return engine(spark, tmp_path)


def rows(lake, name):
    return sorted(tuple(r) for r in lake.sql(f"SELECT * FROM {name}").collect())


def test_an_append_reads_no_old_manifest(lake, monkeypatch):
    lake.create_table("db.t", "k BIGINT", ["bucket(4, k)"])
    for k in range(5):
        lake.insert_into("db.t").sql(f"SELECT {k}L AS k").execute()
    t, read = lake.table("db.t"), []
    plain = metadata.Manifests.read
    monkeypatch.setattr(metadata.Manifests, "read", lambda self, path: (read.append(path), plain(self, path))[1])
    Transaction(t).commit([Change([metadata.DataFile("/none", t.meta.spec_id, [0], 1, 1, {}, [])])])
    assert read == []
    lake.insert_into("db.t").sql("SELECT 9L AS k").execute()
    assert len(read) == 2  # the writer's, for the size of rows
    assert "/data/" not in t.meta.to_json()  # versions don't list files


@pytest.mark.parametrize("columns", [["a"], ["a", "b"]])
def test_overwrite_by_more_values_than_a_filter_lists(lake, columns):
    lake.create_table("db.t", "a BIGINT, b STRING, v INT")
    lake.insert_into("db.t").sql(f"SELECT CASE WHEN id % 1000 = 7 THEN NULL ELSE id END AS a, CAST(id % 3 AS STRING) AS b, 0 AS v FROM range({2 * MANY})").execute()
    lake.insert_into("db.t").sql(f"SELECT CASE WHEN id % 1000 = 7 THEN NULL ELSE id END AS a, CAST(id % 3 AS STRING) AS b, 1 AS v FROM range({MANY})").overwrite_by_filter_columns(columns).execute()
    old = [(None if i % 1000 == 7 else i, str(i % 3)) for i in range(2 * MANY)]
    new = old[:MANY]
    gone = {tuple(r[: len(columns)]) for r in new}
    want = [(*r, 1) for r in new] + [(*r, 0) for r in old if tuple(r[: len(columns)]) not in gone]
    got = lake.sql("SELECT * FROM db.t").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_snapshot_over_more_values_than_a_filter_lists(lake):
    lake.create_table("db.t", "region BIGINT, k BIGINT, v INT")
    lake.insert_into("db.t").sql(f"SELECT id AS region, n AS k, 0 AS v FROM range({MANY + 500}) LATERAL VIEW explode(array(1L, 2L)) x AS n").execute()
    # regions of the source: all below MANY; each keeps k = 1 only, with a new value for some
    lake.apply_snapshot_as_scd1("db.t").table_filter_columns(["region"]).source_sql(f"SELECT id AS region, 1L AS k, CAST(id % 2 AS INT) AS v FROM range({MANY})").key_columns(["region", "k"]).execute()
    got = rows(lake, "db.t")
    assert got == sorted([(i, 1, i % 2) for i in range(MANY)] + [(i, k, 0) for i in range(MANY, MANY + 500) for k in (1, 2)])


@pytest.fixture
def remote(spark, tmp_path):
    """A folder that only Hadoop's file systems can open."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = f"m{tmp_path.name.replace('_', '')}"
    (tmp_path / "far").mkdir()
    conf.set(f"fs.viewfs.mounttable.{name}.link./far", f"file://{tmp_path}/far")
    return f"viewfs://{name}/far"


def test_no_commits_where_files_cannot_be_created_exclusively(spark, remote):
    with pytest.raises(ValidationError, match="commit_lock"):
        Engine(spark, remote).create_table("db.t", "k BIGINT")


def test_two_writers_off_the_local_disk(spark, remote, monkeypatch):
    one = threading.Lock()

    @contextmanager
    def lock(path):
        with one:
            yield

    a, b = (Engine(spark, remote, allow_full_scan=True, commit_lock=lock) for _ in range(2))
    a.create_table("db.t", "k BIGINT, s STRING", ["bucket(2, k)"], ["k"])
    whole = []
    plain = metadata.Files.read
    monkeypatch.setattr(metadata.Files, "read", lambda self, path: (whole.append(path), plain(self, path))[1])
    errors = []

    def write(engine, first):
        try:
            for k in range(first, first + 3):
                engine.insert_into("db.t").sql(f"SELECT {k}L AS k, 'x' AS s").execute()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=x) for x in ((a, 0), (b, 100))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert rows(a, "db.t") == [(k, "x") for k in (0, 1, 2, 100, 101, 102)]
    assert rows(b, "db.t") == rows(a, "db.t")
    a.delete_from("db.t").condition(P.less_than("k", 100)).execute()
    a.update("db.t").condition_sql("k = 101").update_sets({"s": "y"}).execute()
    assert rows(b, "db.t") == [(100, "x"), (101, "y"), (102, "x")]
    assert not [p for p in whole if "/data/" in p]  # footers come by seeks


def test_a_merge_with_many_rows_broadcasts_none(lake, monkeypatch):
    lake.create_table("db.t", "k BIGINT, v INT")
    lake.insert_into("db.t").sql(f"SELECT id AS k, 0 AS v FROM range({2 * MANY})").execute()
    plans = []
    plain_write, plain_parquet = Writer.write, DataFrameWriter.parquet
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Writer, "write", lambda self, df: (seen(df), plain_write(self, df))[1])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen(self._df), plain_parquet(self, *a, **b))[1])
    lake.apply_changes_as_scd1("db.t").table_filter(P.not_null("k")).source_sql(f"SELECT id AS k, 1 AS v FROM range({MANY})").key_columns(["k"]).execute()
    assert sum("SortMergeJoin" in p for p in plans) >= 2  # keys, and rows that stay
    assert not [p for p in plans if "Broadcast" in p]
    assert rows(lake, "db.t") == [(k, int(k < MANY)) for k in range(2 * MANY)]


def test_a_sorted_write_bounds_what_a_task_sorts(lake):
    """By memory: rows of few bytes as shuffled are many, each with its words and its partition's hash."""
    lake.create_table("db.t", "k BIGINT, big BOOLEAN, f BOOLEAN", ["big"])
    lake.insert_into("db.t").sql("SELECT id * 2654435761 % 4294967296 AS k, true AS big, id % 2 = 0 AS f FROM range(0, 3000000, 1, 8)").execute()
    t = lake.table("db.t")
    files = t.files(t.snapshot_of())
    assert sum(f.records for f in files) == 3_000_000 and max(f.records for f in files) < 2_000_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")
def test_no_distinct_value_carries_a_sketch(spark):
    plan = QUERIES["agg_approx_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = [re.search(r"keys=\[(.*?)\]", x)[1] for x in plan.split("\n") if "approx_count_distinct" in x]
    assert keys and not [k for k in keys if "o_custkey" in k]
