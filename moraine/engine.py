"""The engine: tables, queries and commands on one Spark session."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .errors import ValidationError, check
from .operators.insert import Insert
from .operators.merge import SCD1Changes, SCD1Snapshot, SCD2Changes, SCD2Snapshot
from .operators.rewrite import Delete, Update
from .plans import predicates as P
from .plans.parser import parse
from .plans.sql_text import Resolver
from .sources.commit import Batch
from .sources.metadata import MAIN, Catalog, Table
from .sources.scan import TimeTravel, partition_counts, read_parquet, scan
from .templates import Templates

#: What the engine's own session needs; other sessions keep theirs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.parquet.fieldId.write.enabled": "true",
    "spark.sql.parquet.fieldId.read.enabled": "true",
    "spark.sql.parquet.fieldId.read.ignoreMissing": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.files.ignoreMissingFiles": "false",
}


class Engine:
    """
    warehouse: the folder of all tables; any file system that Spark reads.
    allow_full_scan: whether a query may read a table without a filter on its columns.
    max_scan_bytes: the most that the files of one scan may hold.
    cache_seconds: how long a table's loaded version may serve reads; writes always load the latest.
    process_source_tables: whether commands resolve lake tables in their source SQL.
    collector: called with (kind, metrics) after scans and commits.
    transformer: called with every query's text after lake tables are resolved.
    commit_lock: for file systems without exclusive create, as object stores: called with a path, gives a context manager that all writers share.
    configure: called with the engine's session; what it returns and has ``close`` is closed with the engine.
    """

    def __init__(
        self, spark: SparkSession, warehouse: str, *, allow_full_scan: bool = False, max_scan_bytes: int | None = None, cache_seconds: float = 0, manifest_cache_bytes: int = 256 << 20,
        process_source_tables: bool = True, application: str | None = None, collector: Callable | None = None, transformer: Callable[[str], str] | None = None,
        max_connections: int | None = None, connection_timeout: float = 600, query_timeout: float = 0, keep_staging: bool = False, configure: Callable | None = None, catalog_name: str = "lake",
        commit_lock: Callable | None = None,
    ):
        self.spark = spark.newSession()
        for key, value in _settings_of(spark).items():
            self.spark.conf.set(key, value)
        for key, value in SETTINGS.items():
            self.spark.conf.set(key, value)
        self.catalog = Catalog(self.spark, warehouse, catalog_name, cache_seconds, manifest_cache_bytes, commit_lock)
        self.allow_full_scan, self.max_scan_bytes, self.process_source_tables = allow_full_scan, max_scan_bytes, process_source_tables
        self.application, self.collector, self.transformer = application, collector, transformer
        self.keep_staging, self.query_timeout, self.connection_timeout = keep_staging, query_timeout, connection_timeout
        self.templates = Templates()
        self._slots = threading.BoundedSemaphore(max_connections) if max_connections else None
        self._closing = [c for c in _many(configure(self.spark) if configure else None) if hasattr(c, "close")]

    def close(self) -> None:
        for c in self._closing:
            c.close()
        self._closing = []

    def collect(self, kind: str, metrics: object) -> None:
        if self.collector:
            self.collector(kind, metrics)

    def metrics(self) -> dict:
        """Of the caches and of Spark's work right now."""
        m, status = self.catalog.manifests, self.spark.sparkContext.statusTracker()
        return {"manifest_hits": m.hits, "manifest_misses": m.misses, "manifest_evicted": m.evicted, "manifests_kept": len(m.kept), "tables_kept": len(self.catalog.kept), "active_jobs": len(status.getActiveJobsIds()), "active_stages": len(status.getActiveStageIds())}

    # --- tables ---

    def create_table(self, name: str, schema: T.StructType | str, partitioning: list = (), sort_order: list[str] = (), properties: dict | None = None) -> Table:
        """schema: a StructType or DDL; say TIMESTAMP_NTZ for a timestamp without zone, TIMESTAMP_LTZ for one with."""
        return self.catalog.create(name, schema, partitioning, sort_order, properties)

    def table(self, name: str, refresh: bool = False) -> Table:
        return self.catalog.load(name, refresh)

    def drop_table(self, name: str, purge: bool = True) -> None:
        self.catalog.drop(name, purge)

    # --- reading ---

    def read(self, name: str, where: P.Predicate | str = P.TRUE, *, columns: list[str] | None = None, file_columns: bool = False, timestamp=None, branch: str | None = None, tag: str | None = None, snapshot: int | None = None) -> DataFrame:
        """Rows of a table. The name may have a time travel suffix."""
        name, travel = TimeTravel.split(name)
        given = TimeTravel(timestamp, branch, tag, snapshot)
        check(travel is None or given == TimeTravel(), "Time travel is given twice")
        table = self.table(name)
        condition = parse(where, table.schema) if isinstance(where, str) else where
        df, _ = scan(table, condition, travel or given, file_columns, self.allow_full_scan, self.max_scan_bytes, self.collect)
        return df.select(*[f"`{c}`" for c in columns]) if columns else df

    def partition_counts(self, name: str, where: P.Predicate | str = P.TRUE) -> list[tuple[int, dict, int]]:
        table = self.table(name)
        return partition_counts(table, parse(where, table.schema) if isinstance(where, str) else where)

    def read_parquet(self, paths: list[str], **options) -> DataFrame:
        return read_parquet(self.spark, paths, **options)

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """A temporary view in the engine's session, of a frame of any session."""
        if df.sparkSession is not self.spark:
            df.createOrReplaceGlobalTempView(f"lake_{name}")
            df = self.spark.table(f"global_temp.lake_{name}")
        df.createOrReplaceTempView(name)
        return df

    def sql(self, text: str, args=None, *, process_tables: bool = True, filters: dict[str, P.Predicate] | None = None, transformer: Callable[[str], str] | None = None) -> DataFrame:
        """A query over lake tables and the session's own.

        args: a list for ``?``, or a dict for ``:name``. filters: further
        predicates by table, for pruning and rows.
        """
        views: list[str] = []
        try:
            if process_tables:
                text, views = Resolver(self).prepare(text, args, filters)
            for t in (self.transformer, transformer):
                text = t(text) if t else text
            return self.spark.sql(text, args=args) if args else self.spark.sql(text)
        finally:
            for v in views:  # the frame holds the plan, not the name
                self.spark.catalog.dropTempView(v)

    def source(self, text: str, args=None, process_tables: bool = True) -> DataFrame:
        return self.sql(text, args, process_tables=process_tables)

    def rows(self, text: str, args=None, timeout: float | None = None, **options) -> list[Row]:
        """A query's rows on the driver; ValidationError after ``timeout`` seconds (0: none)."""
        limit = self.query_timeout if timeout is None else timeout
        with self.connection():
            df = self.sql(text, args, **options)
            if not limit:
                return df.collect()
            tag, late = f"lake-{uuid.uuid4().hex}", threading.Event()

            def stop() -> None:
                late.set()
                self.spark.sparkContext.cancelJobsWithTag(tag)

            self.spark.sparkContext.addJobTag(tag)
            timer = threading.Timer(limit, stop)
            timer.start()
            try:
                return df.collect()
            except Exception as e:
                if late.is_set():
                    raise ValidationError(f"Query timed out after {limit} seconds") from e
                raise
            finally:
                timer.cancel()
                self.spark.sparkContext.removeJobTag(tag)

    def statement(self, name: str, parameters: dict | None = None, **options) -> DataFrame:
        """A named SQL template."""
        return self.sql(self.templates.text(name, parameters), self.templates.args(name, parameters), **options)

    def copy_to(self, text: str, path: str, **options) -> None:
        """A query's rows to Parquet files."""
        self.sql(text, **options).write.mode("overwrite").parquet(path)

    @contextmanager
    def connection(self) -> Iterator[Engine]:
        """One of at most ``max_connections`` that run at a time."""
        if self._slots is None:
            yield self
            return
        check(self._slots.acquire(timeout=self.connection_timeout), "Timed out waiting for a connection after %s seconds", self.connection_timeout)
        try:
            yield self
        finally:
            self._slots.release()

    @contextmanager
    def request(self) -> Iterator[Engine]:
        """Temporary views made inside go at the end."""
        before = {t.name for t in self.spark.catalog.listTables() if t.isTemporary}
        try:
            yield self
        finally:
            for t in self.spark.catalog.listTables():
                if t.isTemporary and t.name not in before:
                    self.spark.catalog.dropTempView(t.name)

    # --- changes ---

    def insert_into(self, target) -> Insert:
        return Insert(self, target)

    def update(self, target) -> Update:
        return Update(self, target)

    def delete_from(self, target) -> Delete:
        return Delete(self, target)

    def apply_changes_as_scd1(self, target) -> SCD1Changes:
        return SCD1Changes(self, target)

    def apply_snapshot_as_scd1(self, target) -> SCD1Snapshot:
        return SCD1Snapshot(self, target)

    def apply_changes_as_scd2(self, target) -> SCD2Changes:
        return SCD2Changes(self, target)

    def apply_snapshot_as_scd2(self, target) -> SCD2Snapshot:
        return SCD2Snapshot(self, target)

    def batch(self, name: str, branch: str = MAIN, metadata: dict[str, str] | None = None, isolation: str | None = None) -> Batch:
        return Batch(self.table(name, refresh=True), branch, metadata, isolation, self.application, self.collect)


def _settings_of(spark: SparkSession) -> dict[str, str]:
    """What the caller's session has set for SQL at run time."""
    out = {}
    for key, value in ((r[0], r[1]) for r in spark.sql("SET").collect()):
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            out[key] = value
    return out


def _many(x: object) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]
