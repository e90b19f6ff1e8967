"""Scans: a predicate and a version of a table become a DataFrame over the files that matter."""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import check
from ..functions.types import ID, parse_timestamp
from ..plans.predicates import TRUE, Predicate, and_, equal, is_null, or_, resolve, to_column
from ..plans.pruning import Pruner
from .metadata import MAIN, DataFile, Metadata, Snapshot, Table

#: Columns with a row's file and its place there.
FILE, ROW = "filename", "file_row_number"


@dataclass(frozen=True)
class TimeTravel:
    """At most one of these; none means the main branch's last snapshot. Times are UTC, to the millisecond."""

    timestamp: dt.datetime | str | None = None
    branch: str | None = None
    tag: str | None = None
    snapshot: int | None = None

    SUFFIX = re.compile(r"^(.*?)\$(timestamp|branch|tag|snapshot)_(.+)$")

    @staticmethod
    def split(name: str) -> tuple[str, TimeTravel | None]:
        """A table name's suffix, as in ``"ns.t$branch_x"``."""
        if not (m := TimeTravel.SUFFIX.match(name)):
            return name, None
        value: object = m[3]
        if m[2] == "snapshot":
            check(value.isdigit(), "Invalid snapshot id %s", value)
            value = int(value)
        return m[1], TimeTravel(**{m[2]: value})


def snapshot_for(meta: Metadata, travel: TimeTravel | None) -> Snapshot | None:
    ref = MAIN
    if travel:
        given = [x for x in (travel.timestamp, travel.branch, travel.tag, travel.snapshot) if x is not None]
        check(len(given) <= 1, "Only one of timestamp, branch, tag and snapshot may be given")
        if travel.snapshot is not None:
            check(travel.snapshot in meta.snapshots, "Cannot find snapshot with ID %s", travel.snapshot)
            return meta.snapshots[travel.snapshot]
        if travel.timestamp is not None:
            at = parse_timestamp(travel.timestamp, zone=True) if isinstance(travel.timestamp, str) else travel.timestamp
            if at.tzinfo is not None:
                at = at.astimezone(dt.timezone.utc).replace(tzinfo=None)
            ms = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
            found = [s for t, s in meta.log if t <= ms]
            check(found, "Cannot find a snapshot older than %s", at)
            return meta.snapshots[found[-1]]
        ref = travel.branch or travel.tag or MAIN
        kind = "tag" if travel.tag else "branch"
        check(ref in meta.refs and meta.refs[ref].kind == kind, "Cannot find %s %s", kind, ref)
    at = meta.refs[ref].snapshot
    return None if at is None else meta.snapshots[at]


def as_read(schema: T.StructType) -> T.StructType:
    """The schema for reading: nothing is required, for old files may lack a column."""

    def go(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, go(f.dataType), True, {ID: f.metadata[ID]} if ID in f.metadata else {}) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(go(kind.elementType), True)
        if isinstance(kind, T.MapType):
            return T.MapType(go(kind.keyType), go(kind.valueType), True)
        return kind

    return go(schema)


@dataclass
class Plan:
    """Files that may hold matching rows, and the predicate resolved."""

    table: Table
    snapshot: Snapshot | None
    files: list[DataFile]
    predicate: Predicate

    @property
    def size(self) -> int:
        return sum(f.size for f in self.files)


def plan(table: Table, condition: Predicate = TRUE, travel: TimeTravel | None = None, schema: T.StructType | None = None) -> Plan:
    snapshot = snapshot_for(table.meta, travel)
    p = resolve(condition, schema or table.schema)
    files = table.files(snapshot)
    check(all(f.content == 0 for f in files), "Row-level delete files are not supported: %s", table.name)
    return Plan(table, snapshot, Pruner(schema or table.schema, table.meta.specs).select(p, files), p)


def reuses_names(schemas: list[T.StructType]) -> bool:
    """Whether a name has stood for different fields of the same parent."""
    seen: dict[tuple, int] = {}

    def go(kind: T.DataType, parent: object) -> bool:
        if isinstance(kind, T.StructType):
            return any(seen.setdefault((parent, f.name.lower()), f.metadata.get(ID)) != f.metadata.get(ID) or go(f.dataType, f.metadata.get(ID)) for f in kind)
        if isinstance(kind, T.ArrayType):
            return go(kind.elementType, (parent, "element"))
        return isinstance(kind, T.MapType) and (go(kind.keyType, (parent, "key")) or go(kind.valueType, (parent, "value")))

    return any(go(s, None) for s in schemas)


def by_number(schema: T.StructType) -> T.StructType:
    """The schema with fields named by their ids, which no file's names meet."""

    def go(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f"_field_{f.metadata[ID]}", go(f.dataType), True, f.metadata) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(go(kind.elementType), True)
        if isinstance(kind, T.MapType):
            return T.MapType(go(kind.keyType), go(kind.valueType), True)
        return kind

    return go(schema)


def read_files(spark: SparkSession, schema: T.StructType, paths: list[str], file_columns: bool = False, numbered: bool = False) -> DataFrame:
    """Columns by field id, so files of any older schema fit. No files make an empty frame of that schema.

    numbered: read under names by id, for tables that have reused names.
    """
    wanted = as_read(schema)
    extra = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)] if file_columns else []
    if not paths:
        empty = T.StructType([*wanted, *([T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if file_columns else [])])
        return spark.createDataFrame([], empty)
    names = by_number(wanted) if numbered else wanted
    df = spark.read.schema(names).option("mergeSchema", "false").parquet(*paths)
    # names are quoted, and metadata columns are taken before any other step
    same = lambda a, b: F.col(f"`{a.name}`") if a.dataType == b.dataType else F.col(f"`{a.name}`").cast(b.dataType)
    df = df.select(*[same(a, b).alias(b.name) for a, b in zip(names, wanted)], *extra)
    if file_columns:
        df = df.withColumn(FILE, plain_path(F.col(FILE)))
    return df


def read_table(table: Table, paths: list[str], file_columns: bool = False) -> DataFrame:
    """Some files of a table, as rows of its current schema."""
    return read_files(table.catalog.spark, table.schema, paths, file_columns, reuses_names(list(table.meta.schemas.values())))


def plain_path(c: Column) -> Column:
    """``_metadata.file_path`` as manifests spell local paths."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def scan(table: Table, condition: Predicate = TRUE, travel: TimeTravel | None = None, file_columns: bool = False, full_scan: bool = True, max_bytes: int | None = None, collector=None) -> tuple[DataFrame, Plan]:
    """(rows that match, the plan).

    full_scan: whether a condition that matches everything is allowed.
    max_bytes: the most that matching files may hold together.
    """
    got = plan(table, condition, travel)
    check(full_scan or got.predicate != TRUE, "Operation prohibited: Full table scan on '%s'. Add a filter on its columns, or allow full table scans.", table.name)
    check(max_bytes is None or got.size <= max_bytes, "Total file size per scan exceeds limit (%s MiB)", (max_bytes or 0) >> 20)
    if collector:
        collector("scan", {"table": table.name, "snapshot": got.snapshot.id if got.snapshot else None, "files": len(got.files), "bytes": got.size, "predicate": str(got.predicate)})
    df = read_table(table, [f.path for f in got.files], file_columns)
    return (df if got.predicate == TRUE else df.where(to_column(got.predicate, table.schema))), got


def partition_predicate(table: Table, spec_id: int, partitions: list[dict]) -> Predicate:
    """Rows of some partitions, each given as values by the names of the spec's fields. Null means null."""
    by_id = {f.metadata[ID]: f.name for f in table.schema}
    out = or_()
    for values in partitions:
        tests = []
        for p in table.meta.specs[spec_id].fields:
            check(p.name in values, "Partition field %s is missing", p.name)
            term = by_id[p.source_id] if p.transform.name == "identity" else (by_id[p.source_id], p.transform)
            tests.append(is_null(by_id[p.source_id]) if values[p.name] is None else equal(term, values[p.name]))
        out = or_(out, and_(*tests))
    return out


def partition_counts(table: Table, condition: Predicate = TRUE, travel: TimeTravel | None = None) -> list[tuple[int, dict, int]]:
    """(spec id, partition, rows) by metadata alone, for partitions whose files the condition may match."""
    total: dict[tuple, int] = defaultdict(int)
    for f in plan(table, condition, travel).files:
        total[f.spec_id, tuple(map(str, f.partition)), tuple(f.partition)] += f.records
    names = {k: [p.name for p in s.fields] for k, s in table.meta.specs.items()}
    return [(spec, dict(zip(names[spec], values)), n) for (spec, _, values), n in total.items()]


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, union_by_name: bool = False, hive_partitioning: bool = False, file_columns: bool = False) -> DataFrame:
    """Any Parquet files as a source."""
    reader = spark.read.option("mergeSchema", str(union_by_name).lower())
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(*paths)
    extra = [plain_path(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.row_index").alias(ROW)] if file_columns else []
    return df.select(*[F.col(f"`{c}`") for c in columns or df.columns], *extra)
