"""Partitions of all types and values, evolution, scans, SQL and the rest of the front end."""

import datetime as dt
import decimal
import math
import threading

import pytest
from pyspark.sql import types as T

from moraine import Engine, ValidationError
from moraine.plans import predicates as P
from moraine.sources import importer
from moraine.sources.scan import FILE, ROW
from moraine.templates import mapped

from .lake import engine, rows, values

D = decimal.Decimal
EDGES = {
    "BOOLEAN": [True, False], "INT": [0, 1, 2**31 - 1, -(2**31)], "BIGINT": [0, 2**63 - 1, -(2**63)], "FLOAT": [1.5, -1.5, math.inf, -math.inf, math.nan],
    "DOUBLE": [1.5, 1e308, -1e308, math.inf, -math.inf, math.nan], "DECIMAL(10,2)": [D("0.00"), D("-1.50"), D("9999.99"), D("0.01")],
    "STRING": ["regular", "", "null", "NULL", "Special: !@#$%^&*()_+/=?", "x" * 5000, "ünï"], "DATE": [dt.date(1900, 1, 1), dt.date(1970, 1, 1), dt.date(2100, 12, 31)],
    "TIME(6)": [dt.time(0, 0), dt.time(23, 59, 59, 999999)], "TIMESTAMP_NTZ": [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2025, 1, 1)], "TIMESTAMP_LTZ": [dt.datetime(1970, 1, 1), dt.datetime(2025, 6, 1, 1, 2, 3, 4)],
}


@pytest.mark.parametrize("kind", EDGES)
def test_identity_partitions(spark, tmp_path, kind):
    """One file a value, null too; each value is found again, in its own file only."""
    e = engine(spark, tmp_path)
    field = T.StructType.fromDDL("v " + kind.replace("TIME(6)", "INT"))[0].dataType if kind != "TIME(6)" else T.TimeType(6)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", field)])
    t = e.create_table("db.t", schema, ["v"])
    values_ = [*EDGES[kind], None]
    df = e.spark.createDataFrame(list(enumerate(values_)), schema) if kind != "TIME(6)" else e.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, {'NULL' if v is None else f'TIME {chr(39)}{v.isoformat()}{chr(39)}'})" for i, v in enumerate(values_)) + " AS x(id, v)")
    assert e.insert_into("db.t").data(df).execute().added_files == len(values_)
    del t
    for i, v in enumerate(values_):
        p = P.is_null("v") if v is None else P.equal("v", v)
        seen = []
        e.collector = lambda kind, m, seen=seen: seen.append(m)
        got = [r[0] for r in e.read("db.t", p, columns=["id"]).collect()]
        assert got == [i], (v, got)
        assert seen[0]["files"] == 1, (v, seen)


@pytest.mark.parametrize("spec", [["id"], ["year(date)"], ["id", "year(date)"], ["month(date)", "bucket(5, id)"], ["month(date)", "truncate(3, name)"], ["hour(ts)", "date"], ["day(ts)", "truncate(2, id)"], ["month(ts)", "month(date)"], ["bucket(4, name)", "bucket(3, ts)"]])
def test_specs_with_every_command(spark, tmp_path, spec):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT NOT NULL, date DATE NOT NULL, ts TIMESTAMP_NTZ NOT NULL, name STRING NOT NULL", spec)
    text = "SELECT id, DATE_ADD(DATE '2024-12-30', CAST(id AS INT)) AS date, TIMESTAMP_NTZ '2024-12-31 22:30:00' + MAKE_DT_INTERVAL(0, CAST(id AS INT)) AS ts, CONCAT('name', id % 3) AS name FROM RANGE(8)"
    e.insert_into("db.t").sql(text).execute()
    e.update("db.t").condition_sql("id = 3").update_sets({"name": "new"}).execute()
    e.delete_from("db.t").condition_sql("id IN (1, 6)").execute()
    e.apply_changes_as_scd1("db.t").table_filter(P.not_null("id")).source_sql(text.replace("RANGE(8)", "RANGE(7, 10)")).key_columns(["id"]).execute()
    assert [r[0] for r in rows(e.sql("SELECT id FROM db.t"))] == [0, 2, 3, 4, 5, 7, 8, 9]
    assert rows(e.sql("SELECT id FROM db.t WHERE name = 'new' AND date >= DATE '2025-01-01'")) == [(3,)]


def test_history_of_evolution(spark, tmp_path):
    """Schema and layout change between inserts; names are used again for other columns."""
    e = engine(spark, tmp_path)
    t = e.create_table("db.t", "id INT NOT NULL, value STRING")
    add = lambda text: e.insert_into("db.t").sql(text).execute()
    add("SELECT 1 AS id, 'a' AS value")
    t.set_partitioning(["id"])
    add("SELECT 2 AS id, 'b' AS value")
    t.widen_column("id", "BIGINT").set_partitioning(["bucket(5, id)"])
    add("SELECT 3L AS id, 'c' AS value")
    t.rename_column("value", "value_2").set_partitioning(["bucket(5, id)", "bucket(5, value_2)"])
    add("SELECT 4L AS id, 'd' AS value_2")
    t.move_column("value_2", first=True).add_column("value_3", "STRING").add_column("value_4", "DECIMAL(28,10)").add_column("value_5", "DATE")
    add("SELECT 'e' AS value_2, 5L AS id, 'v3' AS value_3, 1.5BD AS value_4, DATE '2025-01-01' AS value_5")
    t.widen_column("value_4", "DECIMAL(38,10)").set_partitioning(["bucket(3, value_3)", "month(value_5)"])
    add("SELECT 'f' AS value_2, 6L AS id, 'w3' AS value_3, 2.5BD AS value_4, DATE '2025-02-01' AS value_5")
    t.set_partitioning(["month(value_5)"]).drop_column("value_3").add_column("value_3", "STRING")
    t.set_partitioning(["truncate(3, value_3)"]).drop_column("value_5").rename_column("value_4", "value_5")
    add("SELECT 'g' AS value_2, 7L AS id, 3.5BD AS value_5, 'x3' AS value_3")
    assert rows(e.sql("SELECT id, value_2, value_3, value_5 FROM db.t")) == [(1, "a", None, None), (2, "b", None, None), (3, "c", None, None), (4, "d", None, None), (5, "e", None, D("1.5")), (6, "f", None, D("2.5")), (7, "g", "x3", D("3.5"))]
    assert rows(e.sql("SELECT id FROM db.t WHERE value_5 > 2 AND value_2 != 'g'")) == [(6,)]
    e.update("db.t").condition_sql("id <= 2").update_sets({"value_3": "u"}).execute()
    assert e.sql("SELECT * FROM db.t WHERE value_3 = 'u'").count() == 2
    with pytest.raises(ValidationError, match="Cannot change column type"):
        t.refresh().widen_column("id", "INT")
    with pytest.raises(ValidationError, match="Cannot drop partition column"):
        t.drop_column("value_3")


def test_required_columns(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT NOT NULL, name STRING NOT NULL, value DOUBLE NOT NULL, s STRUCT<a INT>")
    with pytest.raises(ValidationError, match="Required fields cannot contain null values - name,value"):
        e.insert_into("db.t").sql("SELECT 1L AS id").execute()
    e.create_table("db.u", "id BIGINT, s STRUCT<a INT> NOT NULL")
    with pytest.raises(ValidationError, match="Required fields cannot contain null values - s"):
        e.insert_into("db.u").sql("SELECT 1L AS id").execute()


def test_sort_order_in_files(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id INT, k INT", ["bucket(1, id)"], ["k DESC NULLS LAST"])
    e.insert_into("db.t").sql("SELECT CAST(id AS INT) AS id, CAST(CASE WHEN id = 4 THEN NULL ELSE pmod(id * 7, 11) END AS INT) AS k FROM RANGE(20)").execute()
    got = [r for r in e.read("db.t", file_columns=True).collect()]
    for f in {r[FILE] for r in got}:
        k = [r["k"] for r in sorted((r for r in got if r[FILE] == f), key=lambda r: r[ROW])]
        assert k == sorted(k, key=lambda x: (x is None, -(x or 0)))
    with pytest.raises(ValidationError, match="Transforms not supported in sort order"):
        e.table("db.t").set_sort_order(["bucket(2, id)"])


def test_complex_types_round_trip(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT NOT NULL, d DECIMAL(38,10), s STRUCT<a INT, b STRING, c STRUCT<x DATE>>, l ARRAY<STRING>, m MAP<STRING, ARRAY<INT>>, z TIMESTAMP_LTZ, b BINARY", ["id"])
    e.insert_into("db.t").sql("SELECT 1L AS id, 1234567890123456789012345678.0123456789BD AS d, named_struct('b', 'x', 'a', 1, 'c', named_struct('x', DATE '2024-01-01')) AS s, array('p', NULL) AS l, map('k', array(1, 2)) AS m, TIMESTAMP_LTZ '2024-01-01 05:30:00+05:30' AS z, X'00FF' AS b").execute()
    r = e.sql("SELECT * FROM db.t WHERE s.c.x = DATE '2024-01-01' AND z = '2024-01-01 00:00:00'").first()
    assert (r.d, r.s.a, r.s.b, r.l, r.m, bytes(r.b)) == (D("1234567890123456789012345678.0123456789"), 1, "x", ["p", None], {"k": [1, 2]}, b"\x00\xff")
    e.delete_from("db.t").condition_sql("id = 1").execute()
    assert e.sql("SELECT * FROM db.t").count() == 0


@pytest.fixture
def shop(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, cat STRING, day DATE", ["day"])
    e.insert_into("db.t").sql(values("(1L, 'A', DATE '2025-01-01'), (2L, 'B', DATE '2025-01-02'), (3L, 'A', DATE '2025-02-01'), (4L, 'B', DATE '2025-02-02'), (5L, NULL, NULL)", "id, cat, day")).execute()
    e.seen = []
    e.collector = lambda kind, m: e.seen.append(m["files"]) if kind == "scan" else None
    return e


def pruned(e, text, args=None):
    e.seen.clear()
    return rows(e.sql(text, args)), list(e.seen)


def test_sql_prunes_and_keeps_results(shop):
    e = shop
    assert pruned(e, "SELECT id FROM db.t WHERE day = DATE '2025-01-01'") == ([(1,)], [1])
    assert pruned(e, "SELECT t.id FROM db.t WHERE t.day > DATE '2025-01-15' AND UPPER(t.cat) = 'B'") == ([(4,)], [2])
    assert pruned(e, "SELECT x.id FROM lake.db.t AS x WHERE x.day IN (DATE '2025-01-01', DATE '2025-02-02') OR x.id = 3") == ([(1,), (3,), (4,)], [3])
    got, files = pruned(e, "SELECT a.id, b.id FROM (SELECT * FROM db.t WHERE day < DATE '2025-02-01') a JOIN (SELECT * FROM db.t WHERE day >= DATE '2025-02-01') b ON a.cat = b.cat")
    assert (got, sorted(files)) == ([(1, 3), (2, 4)], [2, 2])
    assert pruned(e, "SELECT id FROM db.t WHERE day = DATE '2025-01-01' UNION SELECT id FROM db.t WHERE day = DATE '2025-02-01'") == ([(1,), (3,)], [1, 1])
    assert pruned(e, "WITH c AS (SELECT * FROM db.t WHERE day IS NULL) SELECT id FROM c")[1] == [1]
    assert pruned(e, "SELECT id FROM db.t WHERE id IN (SELECT id FROM db.t WHERE day = DATE '2025-01-01')")[0] == [(1,)]


def test_outer_joins_are_not_pruned_wrongly(shop):
    e = shop
    e.spark.sql("SELECT * FROM VALUES (1L), (9L) AS k(id)").createOrReplaceTempView("k")
    assert pruned(e, "SELECT k.id, t.day FROM k LEFT JOIN db.t ON k.id = t.id WHERE t.day IS NULL")[0] == [(9, None)]
    assert pruned(e, "SELECT t.id FROM db.t LEFT JOIN k ON k.id = t.id AND k.id = 1 WHERE k.id IS NULL")[0] == [(2,), (3,), (4,), (5,)]
    assert len(pruned(e, "SELECT t.id, k.id FROM db.t FULL JOIN k ON k.id = t.id")[0]) == 6


def test_filter_tables_prune(shop):
    e = shop
    e.spark.sql("SELECT * FROM VALUES (DATE '2025-01-01', 'A'), (DATE '2025-02-02', 'B') AS w(d, c)").createOrReplaceTempView("w")
    assert pruned(e, "SELECT t.id FROM db.t INNER JOIN w ON t.day = w.d AND t.cat = w.c") == ([(1,), (4,)], [2])
    assert pruned(e, "SELECT t.id FROM db.t RIGHT JOIN w ON t.day BETWEEN w.d AND w.d") == ([(1,), (4,)], [2])
    assert pruned(e, "SELECT t.id FROM db.t JOIN w ON day = d AND NOT c = 'B'") == ([(1,)], [1])
    e.spark.sql("SELECT * FROM w WHERE false").createOrReplaceTempView("w")
    assert pruned(e, "SELECT t.id FROM db.t JOIN w ON t.day = w.d") == ([], [0])


def test_guards_and_names(shop, spark, tmp_path):
    shop.allow_full_scan = False
    with pytest.raises(ValidationError, match="Full table scan"):
        shop.sql("SELECT * FROM db.t WHERE cat LIKE 'A%'")
    assert shop.sql("SELECT * FROM db.t WHERE id > 0").count() == 5
    shop.max_scan_bytes = 10
    with pytest.raises(ValidationError, match="Total file size per scan exceeds limit"):
        shop.sql("SELECT * FROM db.t WHERE id > 0")
    with pytest.raises(ValidationError, match="must have a namespace"):
        shop.create_table("t", "id INT")
    with pytest.raises(ValidationError, match="already exists"):
        shop.create_table("db.t", "id INT")
    with pytest.raises(ValidationError, match="nested"):
        shop.create_table("db.n", "s STRUCT<a INT>", ["s.a"])


def test_markers_transformers_and_filters(shop):
    e = shop
    text = "SELECT * FROM (--LAKE_PARSE_BEGIN--SELECT id FROM db.t WHERE id < 3--LAKE_PARSE_END--) x"
    assert rows(e.sql(text)) == [(1,), (2,)]
    assert rows(e.sql("SELECT id FROM db.t", transformer=lambda s: s + " WHERE id = 2")) == [(2,)]
    assert rows(e.sql("SELECT id FROM db.t", filters={"db.t": P.equal("id", 4)})) == [(4,)]
    with pytest.raises(ValidationError, match="several parse blocks"):
        e.sql(text + " " + text, [1])


def test_templates_and_mapping(shop):
    from dataclasses import dataclass

    @dataclass
    class Item:
        id: int
        cat: str

    shop.templates.load("-- name: by.cat\nSELECT id, cat FROM db.t WHERE cat = :cat [[AND id > :least]]")
    assert mapped(shop.statement("by.cat", {"cat": "A", "least": 1}).collect(), Item) == [Item(3, "A")]
    assert shop.statement("by.cat", {"cat": "A"}).count() == 2
    with pytest.raises(ValidationError, match="Parameters are missing"):
        shop.statement("by.cat", {})


def test_timeout_and_connections(spark, tmp_path):
    e = engine(spark, tmp_path, max_connections=1, connection_timeout=0.1)
    assert e.rows("SELECT 1 AS x", timeout=30)[0].x == 1
    with pytest.raises(ValidationError, match="timed out"):
        e.rows("SELECT SUM(CAST(a.id * b.id % 7 AS BIGINT)) FROM RANGE(3000000) a CROSS JOIN RANGE(10000) b", timeout=1)
    with e.connection():
        got = []
        t = threading.Thread(target=lambda: got.append(pytest.raises(ValidationError, e.rows, "SELECT 1")))
        t.start()
        t.join()
        assert "waiting for a connection" in str(got[0].value)


def test_requests_drop_views_and_copies(shop, tmp_path):
    with shop.request():
        shop.spark.sql("SELECT 1 AS x").createOrReplaceTempView("inside")
    assert not shop.spark.catalog.tableExists("inside")
    shop.copy_to("SELECT id FROM db.t", str(tmp_path / "out"))
    assert shop.read_parquet([str(tmp_path / "out")], file_columns=True).count() == 5


def test_imports(spark, tmp_path):
    schema = T.StructType.fromDDL("id INT, t STRING, d DATE")
    path = importer.to_parquet(spark, [{"id": 1, "t": "a"}, {"id": None, "d": dt.date(2024, 1, 1)}], schema, str(tmp_path / "p"))
    assert rows(spark.read.parquet(path)) == [(1, "a", None), (None, None, dt.date(2024, 1, 1))]
    assert spark.read.parquet(importer.to_parquet(spark, [], schema, str(tmp_path / "q"))).schema == schema
    importer.to_view(spark, [(1, "a", None)], schema, "imported_view", replace=True)
    with pytest.raises(ValidationError, match="already exists"):
        importer.to_view(spark, [], schema, "imported_view")
    with pytest.raises(ValidationError, match="Nested types"):
        importer.to_view(spark, [], T.StructType.fromDDL("a ARRAY<INT>"), "nested_view")
    with pytest.raises(ValidationError, match="Unsupported column type"):
        importer.database_type("BLOB")
    assert importer.database_type("NUMERIC", 10, 2) == T.DecimalType(10, 2)


def test_cached_tables_and_manifests(spark, tmp_path):
    e = engine(spark, tmp_path, cache_seconds=60)
    e.create_table("db.t", "id BIGINT")
    e.table("db.t")
    other = Engine(spark, e.catalog.warehouse, allow_full_scan=True)
    other.insert_into("db.t").sql("SELECT 1L AS id").execute()
    assert e.sql("SELECT * FROM db.t").count() == 0  # the version kept
    e.insert_into("db.t").sql("SELECT 2L AS id").execute()  # writes load the latest
    assert e.sql("SELECT * FROM db.t").count() == 2
    assert e.metrics()["manifest_hits"] >= 0
    e.drop_table("db.t")
    assert not e.catalog.exists("db.t")


def test_stream_of_changes(spark, tmp_path):
    from moraine.streaming.changes import merge_stream

    e = engine(spark, tmp_path)
    e.create_table("db.t", "id BIGINT, v STRING")
    e.spark.sql(values("(1L, 'a', 'I', 1), (1L, 'b', 'U', 2), (2L, 'c', 'I', 1)", "id, v, op, at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = e.spark.readStream.schema("id BIGINT, v STRING, op STRING, at INT").parquet(str(tmp_path / "in"))
    command = lambda e, t, df: e.apply_changes_as_scd1(t).table_filter(P.not_null("id")).source_data(df).key_columns(["id"]).operation_type_column("op", "D")
    for _ in range(2):  # the second run finds nothing new
        merge_stream(e, stream, "db.t", "q", command, latest=(["id"], "at")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(e.sql("SELECT * FROM db.t")) == [(1, "b"), (2, "c")]
    assert len(e.table("db.t").meta.snapshots) == 1


def test_partition_predicates(spark, tmp_path):
    from moraine.sources.scan import partition_predicate

    e = engine(spark, tmp_path)
    t = e.create_table("db.t", "id BIGINT, d DATE", ["month(d)", "bucket(2, id)"])
    e.insert_into("db.t").sql("SELECT id, DATE_ADD(DATE '2024-01-01', CAST(id * 9 AS INT)) AS d FROM RANGE(20) UNION ALL SELECT NULL, NULL").execute()
    for spec, values_, n in e.partition_counts("db.t"):
        p = partition_predicate(t.refresh(), spec, [values_])
        assert e.read("db.t", p).count() == n
        assert sum(c for *_, c in e.partition_counts("db.t", p)) == n


def test_asof_join(spark):
    from moraine.plans.joins import asof_join

    a = spark.createDataFrame([("x", 1, 0), ("x", 5, 1), ("y", 3, 2), ("z", 3, 3), (None, 3, 4), ("x", None, 5)], "k string, t int, v int")
    b = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("y", 4, 40), (None, 1, 10), ("x", None, 99)], "k string, t int, w int")
    got = asof_join(a, b, ["k"], "t", "t")
    assert got.columns == ["k", "t", "v", "t_right", "w"]
    assert {r.v: r.w for r in got.collect()} == {0: None, 1: 50, 2: None, 3: None, 4: None, 5: None}
