"""The merges over several steps, from events and from snapshots."""

import datetime as dt

import pytest

from moraine import ValidationError
from moraine.operators.merge import ValueColumn
from moraine.plans import predicates as P

from .lake import engine, rows, values

START = "(1L, 'John'), (2L, 'Jane')"
EVENTS = ["(1L, 'John Doe', 'U'), (3L, 'Bob', 'I')", "(2L, 'Jane Doe', 'U'), (1L, 'x', 'D'), (5L, 'Jane Doe', 'I')", "(2L, 'x', 'D'), (4L, 'Alice', 'I'), (3L, 'Robert', 'U')"]
SNAPSHOTS = ["(1L, 'John Doe'), (2L, 'Jane'), (3L, 'Bob')", "(2L, 'Jane Doe'), (3L, 'Bob'), (5L, 'Jane Doe')", "(3L, 'Robert'), (4L, 'Alice'), (5L, 'Jane Doe')"]
END = [(3, "Robert"), (4, "Alice"), (5, "Jane Doe")]
HISTORY = [(1, "John", 1, 2), (1, "John Doe", 2, 3), (2, "Jane", 1, 3), (2, "Jane Doe", 3, 4), (3, "Bob", 2, 4), (3, "Robert", 4, None), (4, "Alice", 4, None), (5, "Jane Doe", 3, None)]


def day(n):
    return None if n is None else dt.datetime(2025, 1, n)


@pytest.mark.parametrize("partitioning", [[], ["bucket(3, id)"], ["truncate(1, name)"]])
@pytest.mark.parametrize("mode", ["changes", "snapshot"])
def test_scd1_steps(spark, tmp_path, mode, partitioning):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT NOT NULL, name STRING NOT NULL", partitioning)
    e.insert_into("db.t").sql(values(START, "id, name")).execute()
    for events, snapshot in zip(EVENTS, SNAPSHOTS):
        if mode == "changes":
            m = e.apply_changes_as_scd1("db.t").source_sql(values(events, "id, name, op")).operation_type_column("op", "D")
        else:
            m = e.apply_snapshot_as_scd1("db.t").source_sql(values(snapshot, "id, name"))
        m.table_filter_sql("id IS NOT NULL").key_columns(["id"]).execute()
    assert rows(e.sql("SELECT * FROM db.t")) == END


@pytest.mark.parametrize("flag", [False, True])
@pytest.mark.parametrize("mode", ["changes", "snapshot"])
def test_scd2_steps(spark, tmp_path, mode, flag):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT NOT NULL, name STRING NOT NULL, s TIMESTAMP_NTZ NOT NULL, e TIMESTAMP_NTZ" + (", cur BOOLEAN NOT NULL" if flag else ""), ["cur"] if flag else [])

    def period(m, ts):
        m = m.table_filter(P.not_null("id")).key_columns(["id"]).effective_period_columns("s", "e").effective_timestamp(ts)
        return m.current_flag_column("cur") if flag else m

    period(e.apply_snapshot_as_scd2("db.t").source_sql(values(START, "id, name")), day(1)).execute()
    for k, (events, snapshot) in enumerate(zip(EVENTS, SNAPSHOTS)):
        if mode == "changes":
            m = e.apply_changes_as_scd2("db.t").source_sql(values(events, "id, name, op")).operation_type_column("op", "D")
        else:
            m = e.apply_snapshot_as_scd2("db.t").source_sql(values(snapshot, "id, name"))
        period(m, day(k + 2)).execute()
    want = [(i, n, day(a), day(z)) + ((z is None,) if flag else ()) for i, n, a, z in HISTORY]
    assert rows(e.sql("SELECT * FROM db.t")) == sorted(want, key=str)
    with pytest.raises(ValidationError, match="Out-of-order records detected"):
        period(e.apply_snapshot_as_scd2("db.t").source_sql(values(START, "id, name")), dt.datetime(2022, 12, 31)).execute()


def test_unchanged_files_stay(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, v BIGINT")
    for k in range(3):
        e.insert_into("db.t").sql(f"SELECT {k}L AS id, 0L AS v").execute()
    before = {f.path for f in e.table("db.t").files(e.table("db.t").snapshot_of())}
    m = e.apply_changes_as_scd1("db.t").table_filter(P.not_null("id")).source_sql("SELECT 1L AS id, 5L AS v").key_columns(["id"]).execute()
    after = {f.path for f in e.table("db.t").files(e.table("db.t").snapshot_of())}
    assert (m.removed_files, len(before & after)) == (1, 2)


def test_duplicate_source_rows(spark, tmp_path):
    """They are refused only where they hit a row of the table."""
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, v BIGINT")
    e.insert_into("db.t").sql("SELECT 1L AS id, 0L AS v").execute()
    twice = e.apply_changes_as_scd1("db.t").table_filter(P.not_null("id")).source_sql(values("(1L, 1L), (1L, 2L)", "id, v")).key_columns(["id"])
    with pytest.raises(ValidationError, match="several rows"):
        twice.execute()
    e.apply_changes_as_scd1("db.t").table_filter(P.not_null("id")).source_sql(values("(2L, 1L), (2L, 2L)", "id, v")).key_columns(["id"]).execute()
    assert rows(e.sql("SELECT * FROM db.t")) == [(1, 0), (2, 1), (2, 2)]


def test_null_operation_is_an_upsert(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, v BIGINT")
    e.insert_into("db.t").sql(values("(1L, 0L), (2L, 0L)", "id, v")).execute()
    e.apply_changes_as_scd1("db.t").table_filter(P.not_null("id")).source_sql("SELECT 1L AS id, 7L AS v, CAST(NULL AS STRING) AS op").key_columns(["id"]).operation_type_column("op", "D").execute()
    assert rows(e.sql("SELECT * FROM db.t")) == [(1, 7), (2, 0)]


def test_null_keys_match_and_empty_sources(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "a BIGINT, b STRING, v BIGINT")
    e.insert_into("db.t").sql("SELECT CAST(NULL AS BIGINT) AS a, 'x' AS b, 1L AS v").execute()

    def snap(text):
        return e.apply_snapshot_as_scd1("db.t").table_filter(P.always_true()).source_sql(text).key_columns(["a", "b"])

    snap("SELECT CAST(NULL AS BIGINT) AS a, 'x' AS b, 2L AS v").execute()
    assert rows(e.sql("SELECT * FROM db.t")) == [(None, "x", 2)]
    snap("SELECT 1L AS a, 'q' AS b, 2L AS v WHERE false").skip_empty_source().execute()
    assert e.sql("SELECT * FROM db.t").count() == 1
    snap("SELECT 1L AS a, 'q' AS b, 2L AS v WHERE false").execute()
    assert e.sql("SELECT * FROM db.t").count() == 0


def test_value_columns(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id INT, value DOUBLE, salary DOUBLE, status STRING")
    e.insert_into("db.t").sql("SELECT 1 AS id, 100D AS value, 50D AS salary, 'a' AS status").execute()

    def merge(value, salary, how):
        e.apply_snapshot_as_scd1("db.t").table_filter(P.not_null("id")).source_sql(f"SELECT 1 AS id, {value} AS value, {salary} AS salary, 'b' AS status").key_columns(["id"]).value_columns(["value", "salary"]).value_columns_metadata(how).execute()
        return rows(e.sql("SELECT value, salary, status FROM db.t"))[0]

    delta = {"value": ValueColumn(max_delta=0.1), "salary": ValueColumn(max_delta=0.5)}
    assert merge("100.01D", "50.3D", delta) == (100, 50, "a")
    nulls = {"value": ValueColumn(null_replacement=100.0), "salary": ValueColumn(null_replacement=50.0)}
    assert merge("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", nulls) == (100, 50, "a")
    assert merge("100.02D", "55D", delta) == (100.02, 55, "b")
    with pytest.raises(ValidationError):
        ValueColumn(max_delta=1, null_replacement=2)


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda m: m.key_columns(["id"]), "Table filter is mandatory"),
        (lambda m: m.table_filter(P.not_null("id")), "Key columns are mandatory"),
        (lambda m: m.table_filter_columns(["v"]).key_columns(["id"]), "must be key columns"),
        (lambda m: m.table_filter(P.not_null("id")).key_columns(["nope"]), "Could not find column nope"),
        (lambda m: m.table_filter(P.not_null("id")).key_columns(["id"]).value_columns(["id"]), "overlap"),
    ],
)
def test_wrong_merges(spark, tmp_path, change, message):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, v BIGINT")
    with pytest.raises(ValidationError, match=message):
        change(e.apply_snapshot_as_scd1("db.t").source_sql("SELECT 1L AS id, 1L AS v")).execute()


def test_wrong_periods(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, s TIMESTAMP_NTZ, e TIMESTAMP_NTZ, z TIMESTAMP_LTZ, n INT", [])
    m = lambda: e.apply_snapshot_as_scd2("db.t").table_filter(P.not_null("id")).source_sql("SELECT 1L AS id").key_columns(["id"])
    for make, message in (
        (lambda: m().effective_timestamp(day(1)), "period columns are mandatory"),
        (lambda: m().effective_period_columns("s", "s").effective_timestamp(day(1)), "different columns"),
        (lambda: m().effective_period_columns("s", "z").effective_timestamp(day(1)), "without time zone"),
        (lambda: m().effective_period_columns("s", "e"), "timestamp"),
        (lambda: m().effective_period_columns("s", "e").effective_timestamp(day(1)).current_flag_column("n"), "must be boolean"),
    ):
        with pytest.raises(ValidationError, match=message):
            make().execute()
    e.table("db.t").set_partitioning(["day(s)"])
    with pytest.raises(ValidationError, match="effective start"):
        m().effective_period_columns("s", "e").generate_effective_timestamp().execute()
    e.table("db.t").set_partitioning(["bucket(1, e)"])
    m().effective_period_columns("s", "e").generate_effective_timestamp().execute()
    assert e.partition_counts("db.t") == [(2, {"e_bucket_1": None}, 1)]


def test_map_columns_compare(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, m MAP<STRING, INT>, l ARRAY<STRUCT<x INT>>")
    text = "SELECT 1L AS id, map('a', 1, 'b', {v}) AS m, array(named_struct('x', 1)) AS l"
    e.insert_into("db.t").sql(text.format(v=2)).execute()
    run = lambda v: e.apply_snapshot_as_scd1("db.t").table_filter(P.not_null("id")).source_sql(text.format(v=v)).key_columns(["id"]).execute()
    assert run(2).added_files == 0
    assert run(3).added_files == 1
