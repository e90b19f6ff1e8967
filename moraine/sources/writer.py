"""Writing rows as a table's data files.

Rows are cast to the table's schema by name, dealt out by partition with a
rebalancing exchange (adaptive execution splits partitions that are large and
joins those that are small), sorted, and written by Spark below a new folder
named by chance. Bounds and counts come from the files' footers.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError, check
from ..functions.types import ID, as_plain, from_plain, ids_of, leaves
from .metadata import DataFile, Files, Metadata, Spec, Table

PART = "_partition_of_file"
#: Properties of a table that a writer heeds, with their defaults.
COMPRESSION, TARGET_BYTES, ROW_GROUP = ("write.parquet.compression-codec", "zstd"), ("write.target-file-size-bytes", 512 << 20), ("write.parquet.row-group-limit", 122_880)
#: Memory that the rows of one task are to take while they are sorted.
SORT_BYTES = 512 << 20


def fit(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column as the wanted type; struct members go by name, and absent ones are null."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name.lower(): f for f in have}
        members = [fit(c.getField(own[f.name.lower()].name), own[f.name.lower()].dataType, f.dataType).alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name) for f in want]
        return F.when(c.isNotNull(), F.struct(*members))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: fit(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(fit(e["key"], have.keyType, want.keyType).alias("key"), fit(e["value"], have.valueType, want.valueType).alias("value"))))
    return c if have == want else c.cast(want)


def project(df: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    return df.select(*projection(df, schema, columns))


def projection(df: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> list[Column]:
    """The table's columns by name. Those not listed in ``columns``, and those the rows lack, are null; others go."""
    if columns is not None:
        known = {f.name.lower() for f in schema}
        for c in columns:
            check(c.lower() in known, "Column %s does not exist in the table", c)
        check(len({c.lower() for c in columns}) == len(columns), "Columns repeat")
    listed = {c.lower() for c in columns} if columns is not None else None
    have = {f.name.lower(): f for f in reversed(list(df.schema))}
    out = []
    for f in schema:
        at = have.get(f.name.lower())
        if at is None:
            check(listed is None or f.name.lower() not in listed, "Column %s does not exist in the source", f.name)
        use = at is not None and (listed is None or f.name.lower() in listed)
        out.append((fit(F.col(f"`{at.name}`"), at.dataType, _loose(f.dataType)) if use else F.lit(None).cast(_loose(f.dataType))).alias(f.name))
    return out


def _loose(kind: T.DataType) -> T.DataType:
    """The type with nothing required, as expressions have it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_loose(kind.keyType), _loose(kind.valueType), True)
    return kind


def tagged(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Field ids on all columns and members, which Spark writes into the files."""
    want = T.StructType([T.StructField(f.name, _ids_only(f.dataType), True, {ID: f.metadata[ID]}) for f in schema])
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in want], *[c for c in df.columns if c == PART])


def _ids_only(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _ids_only(f.dataType), True, {ID: f.metadata[ID]}) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_ids_only(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_ids_only(kind.keyType), _ids_only(kind.valueType), True)
    return kind


class Writer:
    """Writes rows of the table's schema (see ``project``) to files of its current spec."""

    def __init__(self, table: Table, skip_sort: bool = False):
        self.table, self.meta, self.skip_sort = table, table.meta, skip_sort
        self.by_id = {f.metadata[ID]: f for f in self.meta.schema}

    def write(self, df: DataFrame) -> list[DataFile]:
        meta, spec = self.meta, self.meta.spec
        parts = [(f.transform.column(F.col(f"`{self.by_id[f.source_id].name}`"), self.by_id[f.source_id].dataType)) for f in spec.fields if f.transform.name != "void"]
        order = [] if self.skip_sort else [self._order(s) for s in meta.sort]
        rows = self._required(df)
        if parts:
            # one folder a partition, by a hash: values never appear in paths
            rows = rows.withColumn(PART, F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0null")) for p in parts])), 256))
            rows = rows.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *order)
        elif order:
            rows = rows.hint("rebalance").sortWithinPartitions(*order)
        folder = f"{meta.location}/data/{uuid.uuid4().hex}"
        out = tagged(rows, meta.schema).write.option("compression", meta.properties.get(*COMPRESSION)).option("parquet.block.row.count.limit", meta.properties.get(*ROW_GROUP))
        out = out.option("maxRecordsPerFile", self._rows_in_file())
        with self._sized(bool(parts or order)):
            (out.partitionBy(PART) if parts else out).parquet(folder)
        return self._collect(folder, spec)

    @contextmanager
    def _sized(self, sorts: bool):
        """Rebalanced partitions are as large as a file should be, in bytes as shuffled, and as a task can sort. The last of several writers restores the engine's setting."""
        catalog, key = self.table.catalog, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        conf = catalog.spark.conf
        with catalog.lock:
            if not catalog.writers:
                catalog.plain_size = conf.get(key, None)
            catalog.writers += 1
            target = int(self.meta.properties.get(*TARGET_BYTES))
            conf.set(key, f"{min(target, self._bytes_to_sort()) if sorts else target}b")
        try:
            yield
        finally:
            with catalog.lock:
                catalog.writers -= 1
                if not catalog.writers:
                    conf.unset(key) if catalog.plain_size is None else conf.set(key, catalog.plain_size)

    def _bytes_to_sort(self) -> int:
        """Bytes as shuffled of rows that take SORT_BYTES in memory.

        A row is taken to need a quarter of its types' size as shuffled. In
        memory there are words for all columns, the partition's hash, and the
        sort's pointers besides.
        """
        width = self._width()
        return max(1 << 20, int(SORT_BYTES * (width / 4) / (width + 8 * len(self.meta.schema) + 128)))

    def _width(self) -> int:
        return self.table.catalog.spark._jsparkSession.parseDataType(self.meta.schema.json()).defaultSize()

    def _rows_in_file(self) -> int:
        """So many rows that a file is about the target size, from the sizes of the files added last.

        In a new table a row is taken to need a quarter of what its types need in memory.
        """
        files = [f for m in self.table.manifests(self.table.snapshot_of())[-2:] for f in self.table.catalog.manifests.read(m)]
        records, size = sum(f.records for f in files), sum(f.size for f in files)
        if records <= 1000:
            records, size = 4, self._width()
        return max(1, int(1.1 * int(self.meta.properties.get(*TARGET_BYTES)) * records / size))

    def _order(self, s) -> Column:
        c = F.col(f"`{self.by_id[s.source_id].name}`")
        return (c.asc_nulls_first() if s.nulls_first else c.asc_nulls_last()) if s.ascending else (c.desc_nulls_first() if s.nulls_first else c.desc_nulls_last())

    def _required(self, df: DataFrame) -> DataFrame:
        """Nulls in required columns that footers don't count one by one raise an error while writing."""
        nested = [f for f in self.meta.schema if not f.nullable and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        for f in nested:
            c = F.col(f"`{f.name}`")
            df = df.withColumn(f.name, F.when(c.isNull(), F.raise_error(F.lit(f"Required fields cannot contain null values - {f.name}"))).otherwise(c))
        return df

    def _collect(self, folder: str, spec: Spec) -> list[DataFile]:
        found = self.table.catalog.files.tree(folder)
        with ThreadPoolExecutor(16) as pool:
            files = [f for f in pool.map(lambda x: describe(self.table.catalog.files, self.meta, *x), found) if f.records]
        required = [f for f in self.meta.schema if not f.nullable]
        bad = [f.name for f in required if any(x.stats.get(str(f.metadata[ID]), {}).get("nulls") for x in files)]
        if bad:
            self.table.catalog.files.remove(folder)
        check(not bad, "Required fields cannot contain null values - %s", ",".join(bad))
        for f in files:
            f.spec_id, f.partition = spec.id, self._partition(spec, f)
        return files

    def _partition(self, spec: Spec, file: DataFile) -> list:
        """From the file's bounds: all of its rows have the same partition."""
        out = []
        for p in spec.fields:
            f = self.by_id[p.source_id]
            s = file.stats.get(str(p.source_id), {})
            if p.transform.name == "void" or s.get("nulls") == file.records:
                out.append(None)
                continue
            low = from_plain(s.get("low"), f.dataType)
            if low is None:
                low = self._one_value(file, f)
            out.append(as_plain(p.transform(low, f.dataType)))
        return out

    def _one_value(self, file: DataFile, f: T.StructField) -> object:
        """Where a footer has no bounds: NaN, or very long text."""
        df = self.table.catalog.spark.read.schema(T.StructType([f])).parquet(file.path)
        v = df.where(F.col(f"`{f.name}`").isNotNull()).first()[0]
        return bytes(v) if isinstance(v, bytearray) else v


def describe(files: Files, meta: Metadata, path: str, size: int) -> DataFile:
    """Counts and bounds from a file's footer."""
    footer = pq.read_metadata(files.opened(path, size))
    by_path = {".".join(p): f for p, f in leaves(meta.schema)}
    stats: dict[str, dict] = {}
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            f = by_path.get(chunk.path_in_schema)
            if f is None:
                continue
            now = _chunk(chunk.statistics, group.num_rows, f.dataType)
            key = str(f.metadata[ID])
            stats[key] = now if key not in stats else _merged(stats[key], now)
    for s in stats.values():
        s["low"], s["high"] = as_plain(s["low"]), as_plain(s["high"])
    return DataFile(files.local(path) or path, meta.spec_id, [], footer.num_rows, size, stats, sorted(ids_of(meta.schema)))


def _chunk(s, rows: int, kind: T.DataType) -> dict:
    nulls = s.null_count if s is not None and s.has_null_count else None
    low = high = None
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    if s is not None and s.has_min_max and not isinstance(kind, T.BinaryType):
        low, high = _value(s.min, kind), _value(s.max, kind)
    nans = None if floating else 0
    if nulls == rows:
        nans = 0
    elif floating and low is not None:
        # Spark's writer leaves bounds out of a chunk with a NaN in it
        nans = 0 if not (math.isnan(low) or math.isnan(high)) else None
        low, high = (None, None) if nans is None else (low, high)
    return {"rows": rows, "nulls": nulls, "low": low, "high": high, "nans": nans}


def _value(v: object, kind: T.DataType) -> object:
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(kind, T.StringType) and isinstance(v, bytes):
        v = v.decode("utf-8", "replace")
    if isinstance(kind, T.DecimalType) and not isinstance(v, decimal.Decimal):
        v = decimal.Decimal(int.from_bytes(v, "big", signed=True) if isinstance(v, bytes) else v).scaleb(-kind.scale)
    if isinstance(kind, T.TimeType) and isinstance(v, int):
        v = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v)).time()
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and isinstance(v, int):
        v = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v)
    return v


def _merged(a: dict, b: dict) -> dict:
    some = [x for x in (a, b) if x["nulls"] is None or x["nulls"] < x["rows"]]
    known = bool(some) and all(x["low"] is not None for x in some)
    add = lambda k: None if a[k] is None or b[k] is None else a[k] + b[k]
    return {"rows": a["rows"] + b["rows"], "nulls": add("nulls"), "nans": add("nans"), "low": min(x["low"] for x in some) if known else None, "high": max(x["high"] for x in some) if known else None}


def wrapped(error: Exception) -> Exception:
    """A check that failed in a task, as the error it stands for."""
    text = str(error)
    if "Required fields cannot contain null values" in text:
        at = text.index("Required fields cannot contain null values")
        return ValidationError(text[at:].split("\n")[0].split("'")[0].rstrip("\"' ]"))
    return error
