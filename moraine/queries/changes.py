"""Changing tables: inserts, overwrites, updates, deletes, merges, versions, evolution, batches.

Every oracle states what the table holds in the end.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from ..operators.merge import ValueColumn
from ..plans import predicates as P
from .base import Query, sources

O = ("orders",)
ALL = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _table(e, d, partitioning=("o_orderstatus",), sort=()):
    """db.t: some columns of orders."""
    sources(e, d, "orders")
    e.create_table("db.t", "o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE", list(partitioning), list(sort))
    e.insert_into("db.t").sql(f"SELECT {ALL} FROM orders").execute()


def _all(e):
    return e.sql(f"SELECT {ALL} FROM db.t")


def _insert_columns(e, d):
    _table(e, d)
    e.insert_into("db.t").sql("SELECT o_orderkey + 1000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders").columns(["o_orderkey", "o_orderstatus"]).execute()
    return _all(e)


def _overwrite_filter(e, d):
    _table(e, d)
    e.insert_into("db.t").sql("SELECT o_orderkey, -1L AS o_custkey, o_orderstatus, 0D AS o_totalprice FROM orders WHERE o_orderstatus = 'P'").overwrite_by_filter(P.equal("o_orderstatus", "P")).execute()
    return _all(e)


def _overwrite_sql(e, d):
    _table(e, d)
    e.insert_into("db.t").sql("SELECT o_orderkey, -2L AS o_custkey, o_orderstatus, 1D AS o_totalprice FROM orders WHERE o_orderstatus IN ('P', 'O')").overwrite_by_filter_sql("o_orderstatus IN ('P', 'O')").execute()
    return _all(e)


def _overwrite_columns(e, d):
    _table(e, d)
    e.insert_into("db.t").sql("SELECT o_orderkey, -3L AS o_custkey, o_orderstatus, 2D AS o_totalprice FROM orders WHERE o_orderstatus != 'F'").overwrite_by_filter_columns(["o_orderstatus"]).execute_sql_once_only().execute()
    return _all(e)


def _overwrite_empty(e, d):
    _table(e, d)
    e.insert_into("db.t").sql("SELECT * FROM orders WHERE false").overwrite_by_filter(P.always_true()).execute()
    return _all(e)


def _update(e, d):
    _table(e, d, sort=["o_orderkey"])
    e.update("db.t").condition_sql("o_orderkey BETWEEN 100 AND 2000 AND o_orderstatus = 'F'").update_sets({"o_custkey": 0, "o_totalprice": 9.5}).execute()
    return _all(e)


def _delete(e, d):
    _table(e, d, ["bucket(10, o_orderkey)"])
    e.delete_from("db.t").condition(P.or_(P.between("o_orderkey", 1, 100), P.and_(P.greater_than("o_orderkey", 500), P.less_than_or_equal("o_orderkey", 1000)))).execute()
    return _all(e)


def _delete_null(e, d):
    sources(e, d, "orders")
    e.create_table("db.t", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE")
    e.insert_into("db.t").sql("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders").execute()
    e.delete_from("db.t").condition_sql("o_custkey > 500").execute()
    return _all(e)


_FEED = "SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, CASE WHEN o_orderkey % 10 = 1 THEN 'D' ELSE 'U' END AS op FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey + 1000000, o_custkey, 'N', 1D, 'I' FROM orders"
_FEED_DUCK = _FEED.replace("1D", "1::DOUBLE")


def _scd1_changes(e, d):
    _table(e, d)
    e.apply_changes_as_scd1("db.t").table_filter_sql("o_orderkey IS NOT NULL").source_sql(_FEED).key_columns(["o_orderkey"]).operation_type_column("op", "D").execute()
    return _all(e)


def _scd1_no_op(e, d):
    _table(e, d)
    e.apply_changes_as_scd1("db.t").table_filter(P.not_null("o_orderkey")).source_sql(_FEED).key_columns(["o_orderkey"]).execute()
    return _all(e)


def _scd1_filter_columns(e, d):
    _table(e, d)
    e.apply_changes_as_scd1("db.t").table_filter_columns(["o_orderstatus"]).source_sql("SELECT o_orderkey, -o_custkey AS o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").key_columns(["o_orderkey", "o_orderstatus"]).execute()
    return _all(e)


_SNAP = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority != '3-MEDIUM' UNION ALL SELECT o_orderkey + 2000000, o_custkey, 'F', 3D FROM orders"


def _scd1_snapshot(e, d):
    _table(e, d)
    e.apply_snapshot_as_scd1("db.t").table_filter_sql("o_orderstatus = 'F'").source_sql(_SNAP).key_columns(["o_orderkey"]).execute()
    return _all(e)


def _scd1_values(e, d):
    """A change outside the value columns leaves the row as it is."""
    _table(e, d)
    e.apply_snapshot_as_scd1("db.t").table_filter(P.not_null("o_orderkey")).source_sql("SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders").key_columns(["o_orderkey"]).value_columns(["o_totalprice"]).execute()
    return _all(e)


def _scd1_delta(e, d):
    _table(e, d)
    e.apply_snapshot_as_scd1("db.t").table_filter(P.not_null("o_orderkey")).source_sql("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + o_orderkey % 4 AS o_totalprice FROM orders").key_columns(["o_orderkey"]).value_column_metadata("o_totalprice", ValueColumn(max_delta=1.5)).execute()
    return _all(e)


def _scd1_null(e, d):
    _table(e, d)
    e.update("db.t").condition_sql("o_orderkey < 1000").update_sets({"o_custkey": 100}).execute()
    e.apply_snapshot_as_scd1("db.t").table_filter(P.not_null("o_orderkey")).source_sql("SELECT o_orderkey, CASE WHEN o_orderkey < 2000 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders").key_columns(["o_orderkey"]).value_column_metadata("o_custkey", ValueColumn(null_replacement=100)).execute()
    return _all(e)


def _history(e, d, flag: bool, mode: str):
    """Three steps over customers; amounts change for some, some go, some come."""
    sources(e, d, "customer")
    e.create_table("db.h", "k BIGINT NOT NULL, name STRING, bal DOUBLE, valid_from TIMESTAMP_NTZ NOT NULL, valid_to TIMESTAMP_NTZ" + (", cur BOOLEAN" if flag else ""), ["cur"] if flag else ["bucket(1, valid_to)"])
    steps = [
        ("2025-01-01 00:00:00", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, 'I' AS op FROM customer WHERE c_custkey % 10 != 9"),
        ("2025-01-02 00:00:00", "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 10 = 8 THEN 'D' ELSE 'U' END AS op FROM customer WHERE c_custkey % 10 != 9"),
        ("2025-01-03 00:00:00", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, 'I' AS op FROM customer WHERE c_custkey % 10 >= 8 OR c_custkey % 4 = 0"),
    ]
    for ts, text in steps:
        if mode == "changes":
            m = e.apply_changes_as_scd2("db.h").operation_type_column("op", "D").source_sql(text)
        else:
            m = e.apply_snapshot_as_scd2("db.h").source_sql(text + (" AND NOT c_custkey % 10 = 8" if ts.startswith("2025-01-02") else ""))
        m = m.table_filter_sql("k IS NOT NULL").key_columns(["k"]).effective_period_columns("valid_from", "valid_to").effective_timestamp(ts)
        (m.current_flag_column("cur") if flag else m).execute()
    out = e.sql("SELECT k, name, bal, CAST(valid_from AS STRING) AS valid_from, CAST(valid_to AS STRING) AS valid_to FROM db.h") if not flag else e.sql("SELECT k, bal, CAST(valid_from AS STRING) AS valid_from, CAST(valid_to AS STRING) AS valid_to, cur FROM db.h")
    return out


def _versions(mode: str) -> str:
    """What ``_history`` comes to: each customer's states at the steps, equal neighbours as one."""
    third = "CASE WHEN c_custkey % 10 >= 8 OR c_custkey % 4 = 0 THEN c_acctbal END" if mode == "snapshot" else "CASE WHEN c_custkey % 10 >= 8 OR c_custkey % 4 = 0 THEN c_acctbal WHEN c_custkey % 10 != 8 THEN CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END END"
    return f"""WITH s AS (
        SELECT c_custkey AS k, c_name AS name, '2025-01-01 00:00:00' AS t, CASE WHEN c_custkey % 10 != 9 THEN c_acctbal END AS bal FROM customer
        UNION ALL SELECT c_custkey, c_name, '2025-01-02 00:00:00', CASE WHEN c_custkey % 10 < 8 THEN CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END END FROM customer
        UNION ALL SELECT c_custkey, c_name, '2025-01-03 00:00:00', {third} FROM customer),
      c AS (SELECT *, lag(bal) OVER (PARTITION BY k ORDER BY t) AS was FROM s),
      x AS (SELECT *, lead(t) OVER (PARTITION BY k ORDER BY t) AS till FROM c WHERE bal IS DISTINCT FROM was)
      SELECT k, name, bal, t AS valid_from, till AS valid_to FROM x WHERE bal IS NOT NULL"""


def _scd2_tracking(e, d):
    """Only the tracked column opens a new version."""
    sources(e, d, "customer")
    e.create_table("db.h", "k BIGINT NOT NULL, name STRING, bal DOUBLE, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ")
    for ts, text in (("2025-01-01 00:00:00", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer"), ("2025-02-01 00:00:00", "SELECT c_custkey AS k, c_name || 'x' AS name, c_acctbal + c_custkey % 3 AS bal FROM customer")):
        e.apply_snapshot_as_scd2("db.h").table_filter_sql("k IS NOT NULL").source_sql(text).key_columns(["k"]).effective_period_columns("valid_from", "valid_to").effective_timestamp(ts).change_tracking_columns(["bal"]).change_tracking_metadata("bal", ValueColumn(max_delta=1.5)).execute()
    return e.sql("SELECT k, name, bal, CAST(valid_to AS STRING) AS valid_to FROM db.h")


def _scd2_as_of(e, d):
    _history(e, d, True, "snapshot")
    return e.sql("SELECT k, bal FROM db.h WHERE valid_from <= TIMESTAMP '2025-01-02 12:00:00' AND (valid_to > TIMESTAMP '2025-01-02 12:00:00' OR valid_to IS NULL)")


def _travel(e, d, how: str):
    _table(e, d)
    t = e.table("db.t")
    first = t.snapshot_of()
    if how == "tag":
        t.create_tag("before")
    if how == "branch":
        t.create_branch("side")
        e.delete_from("db.t").branch("side").condition_sql("o_orderstatus = 'F'").execute()
        e.insert_into("db.t").branch("side").sql("SELECT 7000000L AS o_orderkey, 1L AS o_custkey, 'S' AS o_orderstatus, 1D AS o_totalprice").execute()
    time.sleep(0.005)
    e.delete_from("db.t").condition_sql("o_orderkey > 50").execute()
    name = {"snapshot": f"db.t$snapshot_{first.id}", "tag": "db.t$tag_before", "branch": "db.t$branch_side", "timestamp": "db.t$timestamp_" + dt.datetime.fromtimestamp((first.ts_ms + 1) / 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")}[how]
    return e.sql(f'SELECT {ALL} FROM "{name}" WHERE o_orderkey > 0')


def _evolution(e, d, *edits, select: str, more: str | None = None):
    """One table before and after its schema changes."""
    sources(e, d, "orders")
    e.create_table("db.t", "k INT, price FLOAT, status STRING, s STRUCT<a INT, b STRING>, l ARRAY<STRUCT<x INT>>")
    rows = "SELECT CAST(o_orderkey AS INT) AS k, CAST(o_custkey AS FLOAT) AS price, o_orderstatus AS status, named_struct('a', CAST(o_custkey AS INT), 'b', o_orderpriority) AS s, array(named_struct('x', CAST(o_orderkey AS INT))) AS l FROM orders"
    e.insert_into("db.t").sql(rows).execute()
    t = e.table("db.t")
    for edit in edits:
        edit(t)
    if more:
        e.insert_into("db.t").sql(more).execute()
    return e.sql(select)


def _spec(e, d):
    """Files of an old and a new partitioning in one table; an overwrite takes from both."""
    _table(e, d)
    e.table("db.t").set_partitioning(["o_orderstatus", "bucket(4, o_orderkey)"])
    e.insert_into("db.t").sql(f"SELECT o_orderkey + 1000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders").execute()
    e.insert_into("db.t").sql("SELECT 5000000L AS o_orderkey, 1L AS o_custkey, 'P' AS o_orderstatus, 1D AS o_totalprice").overwrite_by_filter_sql("o_orderstatus = 'P'").execute()
    return _all(e)


def _batch(e, d, overwrite: bool):
    _table(e, d)
    b = e.batch("db.t")
    for s, k in (("F", 1), ("O", 2), ("P", 3)):
        i = e.insert_into(b).sql(f"SELECT o_orderkey + {k}000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = '{s}'")
        (i.overwrite_by_filter(P.equal("o_orderstatus", s)) if overwrite else i).execute()
    b.commit()
    return _all(e)


def _batch_delete(e, d):
    _table(e, d)
    b = e.batch("db.t")
    for s in "FP":
        e.delete_from(b).condition_sql(f"o_orderstatus = '{s}' AND o_custkey > 300").execute()
    b.commit()
    return _all(e)


def _source_tables(e, d):
    _table(e, d)
    e.create_table("db.copy", "o_orderkey BIGINT, o_orderstatus STRING", [], ["o_orderkey DESC"])
    e.insert_into("db.copy").sql("SELECT o_orderkey, o_orderstatus FROM db.t WHERE o_orderstatus = 'O'").execute()
    return e.sql("SELECT o_orderkey, o_orderstatus FROM db.copy")


def _q(name, make, oracle):
    return Query(name, oracle, make=make)


_BASE = f"SELECT {ALL} FROM orders"
CHANGES = [
    _q("insert_columns", _insert_columns, f"{_BASE} UNION ALL SELECT o_orderkey + 1000000, NULL, o_orderstatus, NULL FROM orders"),
    _q("insert_from_lake_table", _source_tables, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'"),
    _q("insert_overwrite_filter", _overwrite_filter, f"{_BASE} WHERE o_orderstatus != 'P' UNION ALL SELECT o_orderkey, -1, o_orderstatus, 0 FROM orders WHERE o_orderstatus = 'P'"),
    _q("insert_overwrite_sql", _overwrite_sql, f"{_BASE} WHERE o_orderstatus NOT IN ('P', 'O') UNION ALL SELECT o_orderkey, -2, o_orderstatus, 1 FROM orders WHERE o_orderstatus IN ('P', 'O')"),
    _q("insert_overwrite_columns", _overwrite_columns, f"{_BASE} WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, -3, o_orderstatus, 2 FROM orders WHERE o_orderstatus != 'F'"),
    _q("insert_overwrite_empty", _overwrite_empty, _BASE),
    _q("update_rows", _update, "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 100 AND 2000 AND o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_orderkey BETWEEN 100 AND 2000 AND o_orderstatus = 'F' THEN 9.5 ELSE o_totalprice END AS o_totalprice FROM orders"),
    _q("delete_rows", _delete, f"{_BASE} WHERE NOT (o_orderkey BETWEEN 1 AND 100 OR o_orderkey > 500 AND o_orderkey <= 1000)"),
    _q("delete_null_condition", _delete_null, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey <= 500"),
    _q("scd1_changes", _scd1_changes, f"WITH f AS ({_FEED_DUCK}) {_BASE} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) UNION ALL SELECT {ALL} FROM f WHERE op != 'D'"),
    _q("scd1_changes_no_op", _scd1_no_op, f"WITH f AS ({_FEED_DUCK}) {_BASE} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) UNION ALL SELECT {ALL} FROM f"),
    _q("scd1_filter_columns", _scd1_filter_columns, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders"),
    _q("scd1_snapshot", _scd1_snapshot, f"{_BASE} WHERE o_orderstatus != 'F' UNION ALL SELECT {ALL} FROM ({_SNAP.replace('3D', '3::DOUBLE')}) WHERE o_orderstatus = 'F'"),
    _q("scd1_value_columns", _scd1_values, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders"),
    _q("scd1_max_delta", _scd1_delta, "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 >= 2 THEN o_totalprice + o_orderkey % 4 ELSE o_totalprice END AS o_totalprice FROM orders"),
    _q("scd1_null_replacement", _scd1_null, "SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 100 WHEN o_orderkey < 2000 AND o_custkey != 100 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders"),
    _q("scd2_changes", lambda e, d: _history(e, d, False, "changes"), _versions("changes")),
    _q("scd2_snapshot", lambda e, d: _history(e, d, False, "snapshot"), _versions("snapshot")),
    _q("scd2_current_flag", lambda e, d: _history(e, d, True, "changes"), f"SELECT k, bal, valid_from, valid_to, valid_to IS NULL AS cur FROM ({_versions('changes')})"),
    _q("scd2_multi_step", lambda e, d: _history(e, d, True, "snapshot"), f"SELECT k, bal, valid_from, valid_to, valid_to IS NULL AS cur FROM ({_versions('snapshot')})"),
    _q("scd2_change_tracking", _scd2_tracking, "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, CASE WHEN c_custkey % 3 = 2 THEN '2025-02-01 00:00:00' END AS valid_to FROM customer UNION ALL SELECT c_custkey, c_name || 'x', c_acctbal + 2, NULL FROM customer WHERE c_custkey % 3 = 2"),
    _q("scd2_as_of", _scd2_as_of, f"SELECT k, bal FROM ({_versions('snapshot')}) WHERE valid_from <= '2025-01-02 12:00:00' AND (valid_to > '2025-01-02 12:00:00' OR valid_to IS NULL)"),
    *[_q(f"tt_{h}", lambda e, d, h=h: _travel(e, d, h), f"{_BASE} WHERE o_orderkey > 0") for h in ("snapshot", "timestamp", "tag")],
    _q("tt_branch", lambda e, d: _travel(e, d, "branch"), f"{_BASE} WHERE o_orderstatus != 'F' AND o_orderkey > 0 UNION ALL SELECT 7000000, 1, 'S', 1"),
    _q("evo_add", lambda e, d: _evolution(e, d, lambda t: t.add_column("extra", "STRING"), select="SELECT k, extra FROM db.t", more="SELECT 9000000 AS k, 'new' AS extra"), "SELECT CAST(o_orderkey AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS extra FROM orders UNION ALL SELECT 9000000, 'new'"),
    _q("evo_drop", lambda e, d: _evolution(e, d, lambda t: t.drop_column("status"), lambda t: t.add_column("status", "STRING"), select="SELECT k, status FROM db.t", more="SELECT 9000000 AS k, 'new' AS status"), "SELECT CAST(o_orderkey AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS status FROM orders UNION ALL SELECT 9000000, 'new'"),
    _q("evo_rename", lambda e, d: _evolution(e, d, lambda t: t.rename_column("status", "state"), lambda t: t.rename_column("price", "status"), select="SELECT k, state, CAST(status AS DOUBLE) AS status FROM db.t WHERE state = 'F'"), "SELECT CAST(o_orderkey AS INTEGER) AS k, o_orderstatus AS state, CAST(o_custkey AS DOUBLE) AS status FROM orders WHERE o_orderstatus = 'F'"),
    _q("evo_widen", lambda e, d: _evolution(e, d, lambda t: t.widen_column("k", "BIGINT"), lambda t: t.widen_column("price", "DOUBLE"), select="SELECT k, price FROM db.t", more="SELECT 9000000000L AS k, 0.1D AS price"), "SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS price FROM orders UNION ALL SELECT 9000000000, 0.1"),
    _q("evo_reorder", lambda e, d: _evolution(e, d, lambda t: t.move_column("status", first=True), lambda t: t.move_column("k", after="price"), select="SELECT * FROM (SELECT * FROM db.t) x").select("status", "price", "k").withColumn("price", F.col("price").cast("double")), "SELECT o_orderstatus AS status, CAST(o_custkey AS DOUBLE) AS price, CAST(o_orderkey AS INTEGER) AS k FROM orders"),
    _q("evo_nested", lambda e, d: _evolution(e, d, lambda t: t.rename_column("s.b", "c"), lambda t: t.widen_column("s.a", "BIGINT"), lambda t: t.add_column("s.z", "STRING"), lambda t: t.add_column("l.element.y", "STRING"), lambda t: t.rename_column("l.element.x", "w"), select="SELECT k, s.a AS a, s.c AS c, s.z AS z, l[0].w AS w, l[0].y AS y FROM db.t"), "SELECT CAST(o_orderkey AS INTEGER) AS k, o_custkey AS a, o_orderpriority AS c, CAST(NULL AS VARCHAR) AS z, CAST(o_orderkey AS INTEGER) AS w, CAST(NULL AS VARCHAR) AS y FROM orders"),
    _q("evo_spec", _spec, f"{_BASE} WHERE o_orderstatus != 'P' UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus != 'P' UNION ALL SELECT 5000000, 1, 'P', 1"),
    _q("batch_append", lambda e, d: _batch(e, d, False), f"{_BASE} UNION ALL SELECT o_orderkey + CASE o_orderstatus WHEN 'F' THEN 1000000 WHEN 'O' THEN 2000000 ELSE 3000000 END, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    _q("batch_overwrite", lambda e, d: _batch(e, d, True), "SELECT o_orderkey + CASE o_orderstatus WHEN 'F' THEN 1000000 WHEN 'O' THEN 2000000 ELSE 3000000 END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    _q("batch_delete", _batch_delete, f"{_BASE} WHERE NOT (o_orderstatus IN ('F', 'P') AND o_custkey > 300)"),
]
