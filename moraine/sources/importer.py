"""Rows from outside Spark: mappings, objects or cursors, to Parquet files or temporary views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import check
from ..functions.types import type_of

#: Columns of a cursor by the names of their database types; fixed values.
DATABASE_TYPES = {
    "boolean": ("BIT", "BOOLEAN"), "int": ("TINYINT", "SMALLINT", "INTEGER"), "bigint": ("BIGINT",),
    "string": ("ROWID", "CHAR", "VARCHAR", "LONGVARCHAR", "NCHAR", "NVARCHAR", "LONGNVARCHAR", "SQLXML"),
    "float": ("REAL",), "double": ("DOUBLE", "FLOAT"), "decimal": ("DECIMAL", "NUMERIC"), "date": ("DATE",), "time": ("TIME",), "timestamp": ("TIMESTAMP",),
}


def database_type(name: str, precision: int = 38, scale: int = 9) -> T.DataType:
    for plain, names in DATABASE_TYPES.items():
        if name.upper() in names:
            return T.DecimalType(precision, scale) if plain == "decimal" else type_of(plain)
    check(False, "Unsupported column type %s", name)


def cursor_rows(cursor, types: dict[str, str]) -> tuple[T.StructType, list[tuple]]:
    """Schema and rows of a DB-API cursor; types: database type by column."""
    names = [d[0] for d in cursor.description]
    return T.StructType([T.StructField(n, database_type(types[n])) for n in names]), [tuple(r) for r in cursor.fetchall()]


def frame(spark, rows: Iterable, schema: T.StructType, accessors: dict[str, Callable] | None = None) -> DataFrame:
    """Mappings by key, objects by attribute or by an accessor for each column, sequences in order."""
    get = accessors or {}
    out = []
    for r in rows:
        if isinstance(r, Mapping):
            values = [get[f.name](r) if f.name in get else r.get(f.name) for f in schema]
        elif isinstance(r, (tuple, list)) and not get:
            values = list(r)
        else:
            values = [get[f.name](r) if f.name in get else getattr(r, f.name, None) for f in schema]
        for v, f in zip(values, schema, strict=True):
            check(not isinstance(v, dt.time) or isinstance(f.dataType, T.TimeType), "A time doesn't fit column %s", f.name)
        out.append(tuple(values))
    return spark.createDataFrame(out, schema)


def to_parquet(spark, rows: Iterable, schema: T.StructType, path: str, accessors: dict[str, Callable] | None = None) -> str:
    """Without rows the files still have the schema."""
    frame(spark, rows, schema, accessors).write.mode("overwrite").parquet(path)
    return path


def to_view(spark, rows: Iterable, schema: T.StructType, name: str, accessors: dict[str, Callable] | None = None, replace: bool = False) -> DataFrame:
    for f in schema:
        check(not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)), "Nested types are not supported: %s", f.name)
    check(replace or not spark.catalog.tableExists(name), "View %s already exists", name)
    df = frame(spark, rows, schema, accessors)
    df.createOrReplaceTempView(name)
    return df
