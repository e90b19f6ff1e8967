"""What commands refuse, promise and report: checks, isolation, metrics, order and size of files, hooks, metadata.

Each query runs over whole tables; its SQL states the counts, and that each promise holds.
"""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import CommitConflict, LakeError, ValidationError
from ..functions.transforms import Transform
from ..plans import predicates as P
from ..sources.importer import frame, to_parquet
from ..sources.scan import partition_predicate
from ..streaming.changes import merge_stream
from .base import Query, sources
from .changes import ALL, _all, _table

O, C, E = ("orders",), ("customer",), ("events",)


def refused(action, kind: type = ValidationError, text: str = "") -> bool:
    try:
        action()
    except kind as e:
        return text in str(e)
    return False


def _count(e, **flags):
    return e.sql("SELECT COUNT(*) AS n FROM db.t WHERE o_orderkey IS NOT NULL").select("n", *[F.lit(bool(v)).alias(k) for k, v in flags.items()])


def _counted(*flags: str, where: str = "true") -> str:
    return f"SELECT COUNT(*) AS n, {', '.join(f'true AS {f}' for f in flags)} FROM orders WHERE {where}"


def _twice(e, d):
    """A merge that hits a row twice changes nothing."""
    _table(e, d)
    merge = lambda m: m.table_filter(P.not_null("o_orderkey")).source_sql("SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'").key_columns(["o_orderkey"])
    one = refused(lambda: merge(e.apply_changes_as_scd1("db.t")).execute(), text="several rows of the source")
    return _count(e, changes=one, snapshot=refused(lambda: merge(e.apply_snapshot_as_scd1("db.t")).execute(), text="several rows of the source"))


def _late(e, d):
    """Events before what the history holds are refused."""
    sources(e, d, "customer")
    e.create_table("db.h", "k BIGINT NOT NULL, bal DOUBLE, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ")
    step = lambda ts: e.apply_snapshot_as_scd2("db.h").table_filter_sql("k IS NOT NULL").source_sql("SELECT c_custkey AS k, c_acctbal AS bal FROM customer").key_columns(["k"]).effective_period_columns("valid_from", "valid_to").effective_timestamp(ts).execute()
    step("2025-01-02 00:00:00")
    late = refused(lambda: step("2025-01-01 00:00:00"), text="Out-of-order")
    same = refused(lambda: step("2025-01-02 00:00:00"), text="Out-of-order")
    return e.sql("SELECT COUNT(*) AS n FROM db.h").select("n", F.lit(late).alias("late"), F.lit(same).alias("same"))


def _generated(e, d):
    """The effective time is the time of the merge."""
    sources(e, d, "customer")
    e.create_table("db.h", "k BIGINT NOT NULL, bal DOUBLE, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ")
    before = dt.datetime.now()
    e.apply_changes_as_scd2("db.h").table_filter_sql("k IS NOT NULL").source_sql("SELECT c_custkey AS k, c_acctbal AS bal, 'I' AS op FROM customer").operation_type_column("op", "D").key_columns(["k"]).effective_period_columns("valid_from", "valid_to").generate_effective_timestamp().execute()
    now = F.col("valid_from").between(F.lit(before.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(dt.datetime.now().isoformat(sep=" ")).cast("timestamp_ntz"))
    return e.sql("SELECT * FROM db.h").select("k", now.alias("now"), F.col("valid_to").isNull().alias("open"))


def _metrics(e, d):
    """What a merge reports: only the partition with a change is written anew."""
    _table(e, d)
    m = e.apply_changes_as_scd1("db.t").table_filter(P.not_null("o_orderkey")).source_sql("SELECT o_orderkey, 0L AS o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'").key_columns(["o_orderkey"]).execute()
    rows = [(p.partition[0], p.added_records, p.removed_records) for p in m.partitions]
    total = [("all", m.added_records, m.removed_records)]
    return e.spark.createDataFrame(rows + total, "status string, added long, removed long")


def _isolation(e, d):
    """Of two changes from one version the later one fails if it is serializable, and goes if its table asks for snapshots only."""
    _table(e, d)
    late = e.delete_from("db.t").condition_sql("o_orderstatus = 'F'")
    e.insert_into("db.t").sql("SELECT -1L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice").execute()
    conflict = refused(late.execute, CommitConflict, "conflicting files")
    late = e.delete_from("db.t").condition_sql("o_orderstatus = 'F'").isolation_level("snapshot")
    e.insert_into("db.t").sql("SELECT -2L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice").execute()
    late.execute()
    gone = e.delete_from("db.t").condition_sql("o_orderstatus = 'P'")
    e.delete_from("db.t").condition_sql("o_orderstatus = 'P'").execute()
    return _count(e, conflict=conflict, missing=refused(gone.execute, CommitConflict, "Missing required files"))


def _isolation_property(e, d):
    sources(e, d, "orders")
    e.create_table("db.t", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE", ["o_orderstatus"], [], {"write.delete.isolation-level": "snapshot"})
    e.insert_into("db.t").sql(f"SELECT {ALL} FROM orders").execute()
    late, update = e.delete_from("db.t").condition_sql("o_orderstatus = 'F'"), e.update("db.t").condition_sql("o_orderstatus = 'O'").update_sets({"o_custkey": 1})
    e.insert_into("db.t").sql("SELECT -1L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice").execute()
    late.execute()
    e.insert_into("db.t").sql("SELECT -2L AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, 1D AS o_totalprice").execute()
    return _count(e, update=refused(update.execute, CommitConflict))


def _sorted(e, d):
    """Rows of every file are in the table's order."""
    sources(e, d, "orders")
    e.create_table("db.t", "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING", ["o_orderstatus"], ["o_totalprice DESC", "o_orderkey"])
    e.insert_into("db.t").sql("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders").execute()
    w = Window.partitionBy("filename").orderBy("file_row_number")
    r = e.read("db.t", file_columns=True).withColumn("was", F.lag("o_totalprice").over(w)).withColumn("key", F.lag("o_orderkey").over(w))
    down = F.col("was").isNull() | (F.col("was") > F.col("o_totalprice")) | (F.col("was") == F.col("o_totalprice")) & (F.col("key") < F.col("o_orderkey"))
    return r.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min(down).alias("sorted"))


def _split(e, d):
    """Files of about the target size, also the first ones."""
    sources(e, d, "lineitem")
    e.create_table("db.t", e.spark.table("lineitem").schema, [], [], {"write.target-file-size-bytes": str(1 << 17)})
    e.insert_into("db.t").sql("SELECT * FROM lineitem").execute()
    t = e.table("db.t")
    sizes = [f.size for f in t.files(t.snapshot_of())]
    return e.sql("SELECT COUNT(*) AS n FROM db.t").select("n", F.lit(len(sizes) > 1).alias("several"), F.lit(max(sizes) < 2 << 17).alias("bounded"))


def _size_guard(e, d):
    _table(e, d)
    e.max_scan_bytes = 10
    over = refused(lambda: e.sql("SELECT * FROM db.t WHERE o_orderkey > 0"), text="exceeds limit")
    e.max_scan_bytes = 1 << 40
    return _count(e, over=over)


def _empty(e, d):
    _table(e, d)
    e.create_table("db.none", "k BIGINT, s STRUCT<a INT, l ARRAY<STRING>>")
    none = e.sql("SELECT k, s.a AS a, s.l[0] AS l FROM db.none")
    return none.unionByName(e.sql("SELECT o_orderkey AS k, 1 AS a, o_orderstatus AS l FROM db.t WHERE o_orderstatus = 'Z'")).unionByName(e.sql("SELECT o_orderkey AS k, 1 AS a, o_orderstatus AS l FROM db.t WHERE o_orderstatus = 'P'"))


def _delete_files(e, d):
    """A table with row-level delete files is refused, not read without them."""
    from ..sources.commit import Change, Transaction
    from ..sources.metadata import DataFile

    _table(e, d)
    n = e.sql("SELECT COUNT(*) AS n FROM db.t").first()[0]
    t = e.table("db.t")
    Transaction(t).commit([Change([DataFile("/none.parquet", t.meta.spec_id, ["F"], 1, 1, {}, [], content=1)])])
    return e.spark.createDataFrame([(n, refused(lambda: e.sql("SELECT * FROM db.t WHERE o_orderkey > 0"), text="delete files"))], "n long, refused boolean")


def _statement_source(e, d):
    _table(e, d)
    e.templates.load("-- name: urgent\nSELECT o_orderkey + :by AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'\n")
    e.insert_into("db.t").statement("urgent", {"by": 1000000}).execute()
    return _all(e)


def _once(e, d):
    """A source that differs at every run is run once: its rows and the filter made of them agree."""
    _table(e, d)
    e.insert_into("db.t").sql("SELECT o_orderkey, CAST(rand() * 1000 AS BIGINT) AS o_custkey, o_orderstatus, rand() AS o_totalprice FROM orders WHERE o_orderstatus != 'F'").overwrite_by_filter_columns(["o_orderstatus"]).execute_sql_once_only().execute()
    return e.sql("SELECT o_orderkey, o_orderstatus, o_totalprice < 1 AS new FROM db.t")


def _maps(e, d):
    """Values of a map that change their type's fields; keys stay."""
    sources(e, d, "orders")
    e.create_table("db.t", "k BIGINT, m MAP<STRING, STRUCT<a INT, b STRING>>")
    e.insert_into("db.t").sql("SELECT o_orderkey AS k, map(o_orderstatus, named_struct('b', o_orderpriority, 'a', CAST(o_custkey AS INT))) AS m FROM orders").execute()
    t = e.table("db.t")
    t.add_column("m.value.c", "STRING")
    t.rename_column("m.value.b", "p")
    t.widen_column("m.value.a", "BIGINT")
    e.insert_into("db.t").sql("SELECT -o_orderkey AS k, map(o_orderstatus, named_struct('c', 'new', 'a', o_custkey, 'p', NULL)) AS m FROM orders").execute()
    return e.sql("SELECT k, m['F'].a AS a, m['F'].p AS p, m['F'].c AS c, size(m) AS n FROM db.t")


def _void(e, d):
    sources(e, d, "orders")
    e.create_table("db.t", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE", ["void(o_custkey)", "o_orderstatus"])
    e.insert_into("db.t").sql(f"SELECT {ALL} FROM orders").execute()
    return e.sql(f"SELECT {ALL} FROM db.t WHERE o_custkey > 100 AND o_orderstatus = 'O'")


def _limits(e, d):
    _table(e, d)
    return e.sql("SELECT o_orderkey, o_totalprice FROM db.t WHERE o_orderstatus = :s ORDER BY o_totalprice DESC, o_orderkey LIMIT :n OFFSET :skip", {"s": "O", "n": 25, "skip": 5})


def _conditions(e, d):
    """Commands refuse conditions on lists and maps, columns that aren't there, nulls in required ones, and rows outside their own filter."""
    _table(e, d)
    e.create_table("db.n", "l ARRAY<INT>, m MAP<STRING, INT>, k INT NOT NULL")
    e.insert_into("db.n").sql("SELECT array(1) AS l, map('a', 1) AS m, 1 AS k").execute()
    insert = lambda text, names=None: (i := e.insert_into("db.t").sql(text)) and (i.columns(names) if names else i).execute()
    return _count(
        e,
        lists=refused(lambda: e.delete_from("db.n").condition_sql("l = 1").execute()), maps=refused(lambda: e.delete_from("db.n").condition_sql("m['a'] = 1").execute()),
        unknown=refused(lambda: e.update("db.t").update_sets({"nothing": 1})), nested=refused(lambda: e.update("db.n").update_sets({"l": [1]})),
        extra=refused(lambda: insert("SELECT 1L AS o_orderkey", ["o_orderkey", "nothing"]), LakeError),
        required=refused(lambda: insert("SELECT CAST(NULL AS BIGINT) AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice")),
        half=refused(lambda: e.insert_into("db.t").sql("SELECT * FROM orders WHERE o_orderstatus = 'F'").overwrite_by_filter(P.equal("o_custkey", 1)).execute(), text="do not match filter"),
    )


def _partitions(e, d):
    """A filter from the partitions that the metadata list."""
    _table(e, d, ["o_orderstatus", "truncate(100, o_custkey)"])
    t = e.table("db.t")
    parts = [v for _, v, _ in e.partition_counts("db.t") if v["o_orderstatus"] == "F" and v["o_custkey_truncate_100"] in (0, 100)]
    return e.read("db.t", partition_predicate(t, t.meta.spec_id, parts), columns=["o_orderkey", "o_custkey"])


def _filters(e, d):
    """Further predicates by table, hooks on the text, settings and metrics of the engine."""
    from ..engine import Engine

    _table(e, d)
    seen = []
    f = Engine(e.spark, e.catalog.warehouse, collector=lambda kind, m: seen.append((kind, m)), transformer=lambda t: t.replace("__STATUS__", "'O'"), configure=lambda s: s.conf.set("spark.sql.session.timeZone", "UTC"), max_connections=1, connection_timeout=0.01, manifest_cache_bytes=1 << 20)
    out = f.sql("SELECT o_orderkey, o_custkey FROM db.t WHERE o_orderstatus = __STATUS__", filters={"db.t": P.greater_than("o_custkey", 50)}, transformer=lambda t: t + " AND o_totalprice > 1000")
    with f.connection():
        busy = refused(lambda: f.rows("SELECT 1"), text="Timed out waiting")
    slow = refused(lambda: f.rows("SELECT SUM(SQRT(a.id + b.id)) AS s FROM range(3000000) a CROSS JOIN range(3000000) b", timeout=0.5), text="timed out")
    again, m = f.sql("SELECT 1 AS x FROM db.t WHERE o_orderkey = 1"), f.metrics()
    told = seen[0][0] == "scan" and seen[0][1]["files"] > 0 and m["manifest_hits"] + m["manifest_misses"] > 0 and again.columns == ["x"]
    f.close()
    return out.withColumns({"busy": F.lit(busy), "slow": F.lit(slow), "told": F.lit(told)})


def _files(e, d):
    """Rows of the driver to Parquet, a copy of a query to Parquet, and both read back; staged files are kept if asked for."""
    _table(e, d)
    sources(e, d, "nation")
    schema = e.spark.table("nation").schema
    rows = [r.asDict() for r in e.spark.table("nation").collect()]
    where = f"{e.catalog.warehouse}/files"
    to_parquet(e.spark, rows, schema, f"{where}/rows", {"n_name": lambda r: r["n_name"].lower()} | {f.name: (lambda r, n=f.name: r[n]) for f in schema if f.name != "n_name"})
    e.copy_to("SELECT o_orderkey, o_custkey FROM db.t WHERE o_orderstatus = 'P'", f"{where}/copy")
    e.keep_staging = True
    e.insert_into("db.t").sql(f"SELECT {ALL} FROM orders WHERE o_orderstatus = 'P'").overwrite_by_filter(P.equal("o_orderstatus", "P")).execute_sql_once_only().execute()
    kept = len(e.catalog.files.tree(f"{e.table('db.t').meta.location}/staging")) > 0
    a = e.read_parquet([f"{where}/rows"]).select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("s"))
    b = e.read_parquet([f"{where}/copy"]).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("s"))
    return a.unionByName(b).withColumn("kept", F.lit(kept))


def _imported(e, d):
    """Rows of the driver into a table."""
    sources(e, d, "nation")
    schema = e.spark.table("nation").schema
    e.create_table("db.nation", schema)
    e.insert_into("db.nation").data(frame(e.spark, [tuple(r) for r in e.spark.table("nation").collect()], schema)).execute()
    return e.sql("SELECT n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM db.nation GROUP BY n_regionkey")


def _parallel(e, d):
    """Writers in threads: every append lands."""
    _table(e, d)
    run = lambda s, k: e.insert_into("db.t").sql(f"SELECT o_orderkey + {k}000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = '{s}'").execute()
    threads = [threading.Thread(target=run, args=x) for x in (("F", 1), ("O", 2), ("P", 3))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return _all(e)


def _transform_term(e, d):
    b = Transform("bucket", 8).column(F.col("o_custkey"), e.spark.table("orders").schema["o_custkey"].dataType)
    return e.read("db.orders", P.and_(P.equal(P.year("o_orderdate"), 1996 - 1970), P.in_(P.bucket("o_custkey", 8), 1, 2, 5)), columns=["o_orderkey", "o_custkey"]).select("o_orderkey", b.alias("bucket"))


def _murmur(x: str) -> str:
    """SQL for the 32-bit Murmur3 hash (seed 0) of a long's eight bytes."""
    mask, mul = "4294967295", lambda v, c: f"CAST((({v})::HUGEINT * {c}) % 4294967296 AS BIGINT)"
    rot = lambda v, r: f"(((({v}) << {r}) | (({v}) >> {32 - r})) & {mask})"
    k = lambda v: mul(rot(mul(v, 0xCC9E2D51), 15), 0x1B873593)
    step = lambda h, v: f"CAST(({rot(f'xor({h}, {k(v)})', 13)}::HUGEINT * 5 + 3864292196) % 4294967296 AS BIGINT)"
    parts = [f"SELECT *, {step('0', f'({x}) & {mask}')} AS h1 FROM orders", f"SELECT *, xor({step('h1', f'(({x}) >> 32) & {mask}')}, 8) AS h2 FROM a", f"SELECT *, {mul('xor(h2, h2 >> 16)', 0x85EBCA6B)} AS h3 FROM b", f"SELECT *, {mul('xor(h3, h3 >> 13)', 0xC2B2AE35)} AS h4 FROM c", "SELECT *, xor(h4, h4 >> 16) & 2147483647 AS hash FROM d"]
    return "WITH " + ", ".join(f"{n} AS ({p})" for n, p in zip("abcde", parts))


def _stream(e, d):
    """Events as a stream of files: each micro-batch is a merge of the last event of each user."""
    events = e.spark.read.parquet(f"{d}/events.parquet")
    e.create_table("db.last", "user_id BIGINT, event_id BIGINT, event_type STRING")
    stream = e.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    merge = lambda engine, table, batch: engine.apply_changes_as_scd1(table).table_filter(P.not_null("user_id")).data(batch).key_columns(["user_id"])
    writer = merge_stream(e, stream.selectExpr("CAST(user_id AS BIGINT) AS user_id", "CAST(event_id AS BIGINT) AS event_id", "event_type").where("user_id IS NOT NULL"), "db.last", "events", merge, (["user_id"], "event_id"))
    writer.option("checkpointLocation", f"{e.catalog.warehouse}/stream").trigger(availableNow=True).start().awaitTermination()
    return e.sql("SELECT user_id, event_id, event_type FROM db.last")


def _q(name, make, oracle, tables=()):
    return Query(name, oracle, tables, make=make)


_BASE = f"SELECT {ALL} FROM orders"
GUARDS = [
    _q("merge_refuses_double_match", _twice, _counted("changes", "snapshot")),
    _q("scd2_refuses_out_of_order", _late, "SELECT COUNT(*) AS n, true AS late, true AS same FROM customer"),
    _q("scd2_generated_time", _generated, "SELECT c_custkey AS k, true AS now, true AS open FROM customer"),
    _q("commit_metrics", _metrics, "SELECT 'P' AS status, COUNT(*) AS added, COUNT(*) AS removed FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'all', COUNT(*), COUNT(*) FROM orders WHERE o_orderstatus = 'P'"),
    _q("commit_isolation", _isolation, "SELECT COUNT(*) + 1 AS n, true AS conflict, true AS missing FROM orders WHERE o_orderstatus = 'O'"),
    _q("commit_isolation_property", _isolation_property, "SELECT COUNT(*) + 2 AS n, true AS update FROM orders WHERE o_orderstatus != 'F'"),
    _q("commit_parallel", _parallel, f"{_BASE} UNION ALL SELECT o_orderkey + CASE o_orderstatus WHEN 'F' THEN 1000000 WHEN 'O' THEN 2000000 ELSE 3000000 END, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    _q("write_sorted", _sorted, "SELECT o_orderstatus, COUNT(*) AS n, true AS sorted FROM orders GROUP BY o_orderstatus"),
    _q("write_split_files", _split, "SELECT COUNT(*) AS n, true AS several, true AS bounded FROM lineitem"),
    _q("scan_size_guard", _size_guard, _counted("over")),
    _q("scan_empty", _empty, "SELECT o_orderkey AS k, 1 AS a, o_orderstatus AS l FROM orders WHERE o_orderstatus = 'P'"),
    _q("scan_refuses_delete_files", _delete_files, "SELECT COUNT(*) AS n, true AS refused FROM orders"),
    _q("insert_statement", _statement_source, f"{_BASE} UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"),
    _q("insert_source_once", _once, "SELECT o_orderkey, o_orderstatus, o_orderstatus != 'F' AS new FROM orders"),
    _q("evo_map_value", _maps, "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS a, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS p, NULL AS c, 1 AS n FROM orders UNION ALL SELECT -o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END, NULL, CASE WHEN o_orderstatus = 'F' THEN 'new' END, 1 FROM orders"),
    _q("part_void", _void, f"{_BASE} WHERE o_custkey > 100 AND o_orderstatus = 'O'"),
    _q("limit_parameter", _limits, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5"),
    _q("refused_conditions", _conditions, _counted("lists", "maps", "unknown", "nested", "extra", "required", "half")),
    _q("filter_from_partitions", _partitions, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 0 AND o_custkey < 200"),
    _q("engine_hooks", _filters, "SELECT o_orderkey, o_custkey, true AS busy, true AS slow, true AS told FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 50 AND o_totalprice > 1000"),
    _q("files_in_and_out", _files, "SELECT CAST(n_nationkey AS BIGINT) AS k, lower(n_name) AS s, true AS kept FROM nation UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), true FROM orders WHERE o_orderstatus = 'P'"),
    _q("streaming_merge", _stream, "SELECT CAST(user_id AS BIGINT) AS user_id, MAX(CAST(event_id AS BIGINT)) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id"),
    _q("import_into_table", _imported, "SELECT n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM nation GROUP BY n_regionkey"),
    _q("part_transform_term", _transform_term, f"{_murmur('CAST(o_custkey AS BIGINT)')} SELECT o_orderkey, CAST(hash % 8 AS INTEGER) AS bucket FROM e WHERE year(o_orderdate) = 1996 AND hash % 8 IN (1, 2, 5)", O),
]
