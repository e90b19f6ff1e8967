"""Slowly changing dimensions, type 1 and 2, from change events or whole snapshots.

All four modes are one plan. The target's candidate rows, with their file and
place, are joined with the source by null-safe keys; what isn't unchanged is
staged once as the list of changes (op, file, place, source columns). From it
follow the files to write anew, the check that no target row is hit twice, and
the new rows; the other rows of those files come back by one left join.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import check
from ..functions.types import ID, literal, parse_timestamp
from ..plans.predicates import Predicate, and_, equal, greater_than_or_equal, is_null, or_, resolve, to_column
from ..sources.commit import Change, CommitMetrics
from ..sources.scan import FILE, ROW, TimeTravel, plan, read_table
from ..sources.writer import project, projection
from .command import Command, among, spread, values_filter

OP, S_FILE, S_ROW = "_op", "_file", "_row"


@dataclass(frozen=True)
class ValueColumn:
    """How a column's change is told: by more than ``max_delta``, or with nulls replaced. Not both."""

    max_delta: float | None = None
    null_replacement: object = None

    def __post_init__(self):
        check(self.max_delta is None or self.null_replacement is None, "Either a maximum delta or a null replacement may be set")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Maps have no equality; their entries in order have."""
    if not _has_map(kind):
        return c
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_comparable(e["key"], kind.keyType).alias("k"), _comparable(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _comparable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[_comparable(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))


def differs(old: Column, new: Column, kind: T.DataType, how: ValueColumn | None) -> Column:
    if how and how.max_delta is not None:
        zero = F.lit(0).cast(kind)
        return F.abs(F.coalesce(new, zero) - F.coalesce(old, zero)) > F.lit(how.max_delta)
    if how and how.null_replacement is not None:
        v = F.lit(how.null_replacement).cast(kind)
        return ~F.coalesce(new, v).eqNullSafe(F.coalesce(old, v))
    return ~_comparable(new, kind).eqNullSafe(_comparable(old, kind))


class _Merge(Command):
    kind = "merge"
    snapshot_mode = False

    def __init__(self, engine, target):
        super().__init__(engine, target)
        self._filter: Predicate | None = None
        self._filter_columns: list[str] | None = None
        self._among: DataFrame | None = None
        self._keys: list[str] = []
        self._op_column: str | None = None
        self._delete_value: object = None
        self._values: list[str] | None = None
        self._how: dict[str, ValueColumn] = {}
        self._skip_empty = False

    def table_filter(self, condition: Predicate):
        self._filter = condition
        return self

    def table_filter_sql(self, text: str):
        self._filter = self._predicate(text)
        return self

    def table_filter_columns(self, names: list[str]):
        self._filter_columns = list(names)
        return self

    source_sql = Command.sql
    source_data = Command.data
    source_statement = Command.statement
    execute_source_sql_once_only = Command.execute_sql_once_only

    def key_columns(self, names: list[str]):
        self._keys = list(names)
        return self

    def operation_type_column(self, name: str, delete_value: object):
        self._op_column, self._delete_value = name, delete_value
        return self

    def skip_empty_source(self, skip: bool = True):
        self._skip_empty = skip
        return self

    # --- checks ---

    def _field(self, name: str) -> T.StructField:
        f = [f for f in self.table.schema if f.name == name] or [f for f in self.table.schema if f.name.lower() == name.lower()]
        check(f, "Could not find column %s", name)
        return f[0]

    def _check(self) -> None:
        check(self._source is not None, "The source is mandatory")
        check(self._filter is not None or self._filter_columns, "Table filter is mandatory.")
        check(self._filter is None or not self._filter_columns, "Only one kind of table filter may be set.")
        check(self._keys, "Key columns are mandatory.")
        self._keys = [self._field(k).name for k in self._keys]
        check(len(set(self._keys)) == len(self._keys), "Key columns repeat")
        if self._filter_columns:
            check(set(self._filter_columns) <= set(self._keys), "Table filter columns must be key columns.")
        if self._columns is not None:
            listed = {c.lower() for c in self._columns}
            check(all(k.lower() in listed for k in self._keys), "Key columns must be among the columns.")
        if self._values is not None:
            self._values = [self._field(v).name for v in self._values]
            check(not set(self._values) & set(self._keys), "Key columns and value columns overlap.")
        for name in self._how:
            check(self._field(name).name not in self._keys, "Key columns and value columns overlap.")
            kind = self._field(name).dataType
            check(self._how[name].max_delta is None or isinstance(kind, T.NumericType), "Maximum delta needs a numeric column: %s", name)

    def _compared(self, schema: list[T.StructField]) -> list[T.StructField]:
        names = set(self._values) if self._values is not None else {f.name for f in schema} - set(self._keys)
        return [f for f in schema if f.name in names]

    # --- the plan ---

    def _prepare(self, schema: T.StructType, stage) -> tuple[DataFrame, Predicate]:
        """(source rows of the schema with their operation, the filter)."""
        raw = self._source()
        ops = {c.lower(): c for c in raw.columns}
        columns = [c for c in self._columns if c.lower() in {f.name.lower() for f in schema}] if self._columns is not None else None
        if self._op_column:
            check(self._op_column.lower() in ops, "Operation type column %s does not exist in the source", self._op_column)
            op = F.col(f"`{ops[self._op_column.lower()]}`")
            rows = raw.select(*projection(raw, schema, columns), op.eqNullSafe(F.lit(self._delete_value)).alias("_deleted"))
        else:
            rows = project(raw, schema, columns).withColumn("_deleted", F.lit(False))
        where = self._filter
        if where is not None:
            rows = rows.where(to_column(resolve(where, self.table.schema), self.table.schema))
        rows = stage(rows)  # the source may not give the same rows twice
        if where is None:
            where, values = values_filter(rows, self._filter_columns)
            self._among = None if values is None else stage(values)
        return rows, where

    def _changes(self, candidates: DataFrame, source: DataFrame, fields: list[T.StructField], always: bool) -> DataFrame:
        """The list of changes; ``always``: every match is an update."""
        names = [f.name for f in fields]
        compared = [] if always else self._compared(fields)
        t = candidates.select(F.col(FILE).alias(S_FILE), F.col(ROW).alias(S_ROW), *[F.col(f"`{n}`").alias(f"_t_{i}") for i, n in enumerate(names) if n in self._keys or n in [c.name for c in compared]])
        s = source.withColumn("_source", F.lit(True))
        at = {n: i for i, n in enumerate(names)}
        same = reduce(lambda a, b: a & b, [_comparable(F.col(f"`{k}`"), self._field(k).dataType).eqNullSafe(_comparable(F.col(f"_t_{at[k]}"), self._field(k).dataType)) for k in self._keys])
        joined = s.join(t, same, "full_outer" if self.snapshot_mode else "left_outer")
        hit = F.col(S_FILE).isNotNull() & F.col("_source").isNotNull()
        changed = F.lit(True) if always else reduce(lambda a, b: a | b, [differs(F.col(f"_t_{at[f.name]}"), F.col(f"`{f.name}`"), f.dataType, self._how.get(f.name)) for f in compared], F.lit(False))
        op = F.when(F.col("_source").isNull(), "D").when(hit & F.col("_deleted"), "D").when(hit & changed, "U").when(hit, "N").when(F.col("_deleted"), "N").otherwise("I")
        return joined.withColumn(OP, op).select(OP, S_FILE, S_ROW, *[F.when(F.col(OP) != "N", F.col(f"`{n}`")).alias(n) for n in names])

    def _merged(self, where: Predicate, candidate: Column | None, source: DataFrame, fields: list[T.StructField], always: bool, stage, finish, scanned: Predicate, before=None, closing: dict[str, Column] | None = None) -> CommitMetrics | None:
        base = self._base()
        schema = self.table.schema
        got = plan(self.table, scanned, TimeTravel(snapshot=base.id) if base else None)
        target = read_table(self.table, [f.path for f in got.files], file_columns=True)
        if before:
            before(target)
        if not got.files:
            new = source.where(~F.col("_deleted")).select(*[F.col(f"`{f.name}`") for f in fields])
            return self._end(self._write(project(finish(new), schema)), [], base, where)
        cand = to_column(resolve(where, schema), schema)
        rows = target.where(cand if candidate is None else cand & candidate)
        if self._among is not None:
            rows = among(rows, self._among, "left_semi")
        every = self._changes(spread(rows, sum(f.records for f in got.files)), source, fields, always)
        # unchanged matches stay for the check that a target row is hit once
        changes = stage(every.where((F.col(OP) != "N") | F.col(S_FILE).isNotNull()).withColumn("_n", F.col(OP) == "N"))
        hits = changes.where(F.col(S_FILE).isNotNull())
        by_row = hits.groupBy(S_FILE, S_ROW).agg(F.count("*").alias("times"), F.max(~F.col("_n")).alias("changed"))
        by_file = by_row.groupBy(S_FILE).agg(F.max("times"), F.max("changed"), F.count_if("changed")).collect()  # a row a file
        check(all(times == 1 for _, times, _, _ in by_file), "Merge matched one row of the target with several rows of the source")
        paths = {path for path, _, changed, _ in by_file if changed}
        changes = changes.where(~F.col("_n"))
        touched = [f for f in got.files if f.path in paths]
        new = changes.where(F.col(OP).isin("I", "U")).select(*[F.col(f"`{f.name}`") for f in fields])
        parts = [finish(new)]
        if touched:
            # one join gives the rows that stay as they are and those that are closed
            marks = changes.where(F.col(S_FILE).isNotNull()).select(F.col(S_FILE).alias(FILE), F.col(S_ROW).alias(ROW), F.lit(True).alias("_hit"))
            old = read_table(self.table, [f.path for f in touched], file_columns=True).join(spread(marks, sum(n for *_, n in by_file)), [FILE, ROW], "left")
            if closing is None:
                old = old.where("_hit IS NULL")
            else:
                old = old.withColumns({n: F.when(F.col("_hit"), c).otherwise(F.col(f"`{n}`")) for n, c in closing.items()})
            parts.append(old.drop(FILE, ROW, "_hit"))
        out = reduce(lambda a, b: a.unionByName(b), [project(p, schema) for p in parts])
        return self._end(self._write(out), touched, base, where)

    def _end(self, added, removed, base, where) -> CommitMetrics | None:
        if not added and not removed:
            return self._finish(None)
        return self._finish(Change(added, removed, base.id if base else None, self._conflicts(where), self._level()))

    def _conflicts(self, where: Predicate) -> Predicate:
        return where


class SCD1Changes(_Merge):
    """Upserts and deletes by key. Without an operation column every row is an upsert; a null operation is one too."""

    def execute(self) -> CommitMetrics | None:
        self._check()
        check(self._op_column or self._delete_value is None, "A delete value needs an operation type column.")
        with self._staging() as stage:
            source, where = self._prepare(self.table.schema, stage)
            if source.isEmpty():
                return self._finish(None)
            return self._merged(where, None, source, list(self.table.schema), True, stage, lambda new: new, where)


class SCD1Snapshot(_Merge):
    """The source is what the filter's part of the table should hold."""

    snapshot_mode = True

    def value_columns(self, names: list[str]):
        self._values = list(names)
        return self

    def value_column_metadata(self, name: str, how: ValueColumn):
        self._how[name] = how
        return self

    def value_columns_metadata(self, how: dict[str, ValueColumn]):
        self._how |= how
        return self

    def execute(self) -> CommitMetrics | None:
        self._check()
        with self._staging() as stage:
            source, where = self._prepare(self.table.schema, stage)
            if self._skip_empty and source.isEmpty():
                return self._finish(None)
            return self._merged(where, None, source, list(self.table.schema), False, stage, lambda new: new, where)


class _SCD2(_Merge):
    kind = ""

    def __init__(self, engine, target):
        super().__init__(engine, target)
        self._ts: dt.datetime | None = None
        self._generate = False
        self._start: str | None = None
        self._end_column: str | None = None
        self._flag: str | None = None

    def effective_timestamp(self, ts: dt.datetime | str):
        self._ts = parse_timestamp(ts, zone=False) if isinstance(ts, str) else ts
        return self

    def generate_effective_timestamp(self, generate: bool = True):
        self._generate = generate
        return self

    def effective_period_columns(self, start: str, end: str):
        self._start, self._end_column = start, end
        return self

    def current_flag_column(self, name: str):
        self._flag = name
        return self

    def change_tracking_columns(self, names: list[str]):
        self._values = list(names)
        return self

    def change_tracking_metadata(self, name: str, how: ValueColumn):
        self._how[name] = how
        return self

    def _check_period(self) -> None:
        check(self._start and self._end_column, "Effective period columns are mandatory.")
        start, end = self._field(self._start), self._field(self._end_column)
        check(start.name != end.name, "Effective start and end must be different columns.")
        for f in (start, end):
            check(isinstance(f.dataType, T.TimestampNTZType), "Effective period column %s must be a timestamp without time zone.", f.name)
        check((self._ts is None) == self._generate, "Either an effective timestamp or its generation must be set.")
        own = {start.name, end.name}
        if self._flag:
            flag = self._field(self._flag)
            check(isinstance(flag.dataType, T.BooleanType), "Current flag column %s must be boolean.", flag.name)
            own.add(flag.name)
        check(not own & set(self._keys), "Key columns and effective period columns overlap.")
        check(not own & set(self._values or ()), "Change tracking columns and effective period columns overlap.")
        by_id = {f.metadata[ID]: f.name for f in self.table.schema}
        for p in self.table.meta.spec.fields:
            name = by_id.get(p.source_id)
            check(name != start.name or p.transform.name == "void", "Partitioning on the effective start column is not supported.")
            check(name != end.name or p.transform.name == "void" or p.transform.name == "bucket" and p.transform.arg == 1, "The effective end column can be partitioned by bucket[1] only.")
            check(not self._flag or name != self._field(self._flag).name or p.transform.name in ("identity", "void"), "The current flag column can be partitioned by identity only.")

    def _open(self) -> Predicate:
        return equal(self._flag, True) if self._flag else is_null(self._end_column)

    def _conflicts(self, where: Predicate) -> Predicate:
        return and_(where, self._open())

    def _run(self) -> CommitMetrics | None:
        self._check()
        self._check_period()
        ts = dt.datetime.now() if self._generate else self._ts
        own = {self._field(n).name for n in (self._start, self._end_column, self._flag) if n}
        fields = [f for f in self.table.schema if f.name not in own]
        start, end = F.col(f"`{self._field(self._start).name}`"), F.col(f"`{self._field(self._end_column).name}`")
        at = literal(ts, T.TimestampNTZType())

        opened = {self._field(self._start).name: at, self._field(self._end_column).name: F.lit(None).cast("timestamp_ntz")}
        closing = {self._field(self._end_column).name: at}
        if self._flag:
            opened[self._field(self._flag).name], closing[self._field(self._flag).name] = F.lit(True), F.lit(False)

        with self._staging() as stage:
            source, where = self._prepare(T.StructType(fields), stage)
            if (not self.snapshot_mode or self._skip_empty) and source.isEmpty():
                return self._finish(None)
            # the second arm is there for the check of the order only
            scanned = and_(where, or_(self._open(), greater_than_or_equal(self._end_column, ts)))

            def in_order(target: DataFrame) -> None:
                late = target.where(to_column(resolve(scanned, self.table.schema), self.table.schema) & ((start >= at) | (end >= at)))
                check(not late.limit(1).count(), "Out-of-order records detected")

            return self._merged(where, (start < at) & end.isNull(), source, fields, False, stage, lambda new: new.withColumns(opened), scanned, in_order, closing)


class SCD2Changes(_SCD2):
    """Events by key: a change closes the open version and opens another, a delete closes it. A null operation is an upsert."""

    def execute(self) -> CommitMetrics | None:
        check(self._op_column and self._delete_value is not None, "Operation type column and delete value are mandatory.")
        return self._run()


class SCD2Snapshot(_SCD2):
    """The source is what the filter's open versions should be."""

    snapshot_mode = True

    def execute(self) -> CommitMetrics | None:
        return self._run()
