"""Column types, schemas with field ids, and literals.

A schema is a Spark ``StructType`` whose fields, nested ones too, carry an
integer id in their metadata. The id, not the name, is a column's identity, so
columns may be renamed, moved and widened without touching files.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError, check

ID = "parquet.field.id"
#: Names under which SQL literals and casts may give a type.
ALIASES = {
    "boolean": ("bool", "logical"),
    "int": ("integer", "int32", "int4", "signed"),
    "bigint": ("long", "int64", "int8"),
    "float": ("float4", "real"),
    "double": ("float8",),
    "string": ("varchar", "char", "text", "bpchar", "uuid"),
    "timestamp_ntz": ("timestamp", "datetime"),
    "timestamp_ltz": ("timestamptz", "timestamp with time zone"),
    "binary": ("blob", "bytea", "varbinary"),
}
_NAMES = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
_PLAIN = {
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "date": T.DateType(), "time": T.TimeType(6), "timestamp_ntz": T.TimestampNTZType(), "timestamp_ltz": T.TimestampType(),
}


def type_of(name: str) -> T.DataType:
    """A primitive type by any of its names; TIMESTAMP has no zone, TIMESTAMPTZ has."""
    plain = re.sub(r"\s+", " ", name.strip().lower())
    if m := re.fullmatch(r"(?:decimal|numeric)(?:\((\d+)(?:,\s*(\d+))?\))?", plain):
        return T.DecimalType(int(m[1] or 18), int(m[2] or (0 if m[1] else 3)))
    plain = re.sub(r"^(varchar|char)\(\d+\)$", "string", plain)
    plain = _NAMES.get(plain, plain)
    check(plain in _PLAIN, "Unknown type %s", name)
    return _PLAIN[plain]


def with_ids(schema: T.StructType, next_id: Callable[[], int] | None = None) -> T.StructType:
    """The same schema with an id on every field that lacks one, in order of declaration."""
    if next_id is None:
        at = iter(range(1 + max(ids_of(schema), default=0), 1 << 31))
        next_id = at.__next__

    def put(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            fields = [T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, ID: f.metadata[ID] if ID in f.metadata else next_id()}) for f in kind]
            return T.StructType([T.StructField(f.name, put(f.dataType), f.nullable, f.metadata) for f in fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(put(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(put(kind.keyType), put(kind.valueType), kind.valueContainsNull)
        return kind

    return put(schema)


def ids_of(kind: T.DataType) -> Iterator[int]:
    if isinstance(kind, T.StructType):
        for f in kind:
            if ID in f.metadata:
                yield f.metadata[ID]
            yield from ids_of(f.dataType)
    elif isinstance(kind, T.ArrayType):
        yield from ids_of(kind.elementType)
    elif isinstance(kind, T.MapType):
        yield from ids_of(kind.keyType)
        yield from ids_of(kind.valueType)


def leaves(schema: T.StructType, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.StructField]]:
    """Paths and fields of all columns and struct members that hold one value."""
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, (*above, f.name))
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            yield (*above, f.name), f


def find(schema: T.StructType, name: str) -> T.StructField:
    """The field of a dotted name; names are compared without case where that is unambiguous."""
    kind: T.DataType = schema
    field = None
    for part in name.split("."):
        if isinstance(kind, (T.ArrayType, T.MapType)):
            raise ValidationError(f"Conditions on elements of lists and maps are not supported: {name}")
        check(isinstance(kind, T.StructType), "Could not find column %s", name)
        same = [f for f in kind if f.name == part] or [f for f in kind if f.name.lower() == part.lower()]
        check(len(same) == 1, "Could not find column %s", name)
        field = same[0]
        kind = field.dataType
    return field


def exact_name(schema: T.StructType, name: str) -> str:
    """The dotted name as the schema spells it."""
    out, kind = [], schema
    for part in name.split("."):
        f = find(kind, part)
        out.append(f.name)
        kind = f.dataType
    return ".".join(out)


def column(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


_EPOCH = dt.datetime(1970, 1, 1)


def parse_timestamp(text: str, zone: bool) -> dt.datetime:
    """ISO text, to the microsecond; with ``zone`` as UTC (text without one is UTC)."""
    m = re.fullmatch(r"\s*(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?\s*(Z|[+-]\d{2}(?::?\d{2})?)?\s*", text)
    check(m and (zone or not m[3]), "Invalid timestamp '%s'", text)
    clock = m[2] or "00:00:00"
    head, _, tail = clock.partition(".")
    head = head + ":00" if head.count(":") == 1 else head
    try:
        out = dt.datetime.fromisoformat(f"{m[1]} {head}").replace(microsecond=int((tail + "000000")[:6]))
    except ValueError as e:
        raise ValidationError(f"Invalid timestamp '{text}'") from e
    if zone and m[3] and m[3] != "Z":
        digits = m[3][1:].replace(":", "")
        shift = dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:] or 0))
        out -= shift if m[3][0] == "+" else -shift
    return out


def parse_time(text: str) -> dt.time:
    m = re.fullmatch(r"\s*(\d{2}:\d{2}(?::\d{2})?)(?:\.(\d+))?\s*", text)
    check(m, "Invalid time '%s'", text)
    return dt.time.fromisoformat(m[1]).replace(microsecond=int(((m[2] or "") + "000000")[:6]))


def coerce(value: object, kind: T.DataType, what: str = "value") -> object:
    """A literal as the column's own Python type; ValidationError if it doesn't fit.

    Timestamps become zone-less datetimes, those with a zone in UTC.
    """
    if value is None:
        return None
    wrong = ValidationError(f"Invalid {kind.simpleString()} {what}: {value!r}")
    try:
        if isinstance(kind, T.BooleanType):
            if isinstance(value, bool):
                return value
            if isinstance(value, str) and value.strip().lower() in ("true", "false", "t", "f", "1", "0"):
                return value.strip().lower() in ("true", "t", "1")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            if isinstance(value, bool):
                raise wrong
            n = int(value) if not isinstance(value, (float, decimal.Decimal)) or value == int(value) else None
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)]
            if n is not None and -(1 << bits) <= n < 1 << bits:
                return n
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            if not isinstance(value, bool):
                out = float(value.strip() if isinstance(value, str) else value)
                if isinstance(kind, T.FloatType) and math.isfinite(out):
                    import struct

                    out = struct.unpack("<f", struct.pack("<f", out))[0]
                return out
        elif isinstance(kind, T.DecimalType):
            if not isinstance(value, bool):
                d = decimal.Decimal(value.strip() if isinstance(value, str) else repr(value) if isinstance(value, float) else value)
                if d.is_finite():
                    return d
        elif isinstance(kind, T.StringType):
            return value if isinstance(value, str) else str(value)
        elif isinstance(kind, T.BinaryType):
            if isinstance(value, (bytes, bytearray)):
                return bytes(value)
        elif isinstance(kind, T.DateType):
            if isinstance(value, dt.datetime):
                return value.date()
            if isinstance(value, dt.date):
                return value
            if isinstance(value, str):
                return dt.date.fromisoformat(value.strip())
        elif isinstance(kind, T.TimestampNTZType):
            if isinstance(value, dt.datetime) and value.tzinfo is None:
                return value
            if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
                return dt.datetime(value.year, value.month, value.day)
            if isinstance(value, str):
                return parse_timestamp(value, zone=False)
        elif isinstance(kind, T.TimestampType):
            if isinstance(value, dt.datetime):
                return value if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)
            if isinstance(value, str):
                return parse_timestamp(value, zone=True)
        elif isinstance(kind, T.TimeType):
            if isinstance(value, dt.time):
                return value
            if isinstance(value, str):
                return parse_time(value)
    except (ValueError, TypeError, ArithmeticError, OverflowError) as e:
        raise wrong from e
    raise wrong


def literal(value: object, kind: T.DataType) -> Column:
    """A value of ``coerce`` as a column of its type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.lit(value.isoformat(sep=" ") + "Z").cast("timestamp")
    if isinstance(kind, T.TimeType):
        return F.lit(value.isoformat()).cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit(value.isoformat()).cast("date")
    if isinstance(kind, T.DecimalType):
        return F.lit(value)
    if isinstance(kind, T.BinaryType):
        return F.lit(value)
    return F.lit(value).cast(kind)


def as_plain(value: object) -> object:
    """A value for JSON: numbers, text; dates in days, times in microseconds."""
    if isinstance(value, dt.datetime):
        return micros(value)
    if isinstance(value, dt.date):
        return (value - _EPOCH.date()).days
    if isinstance(value, dt.time):
        return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float) and not math.isfinite(value):
        return repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def from_plain(value: object, kind: T.DataType) -> object:
    """The inverse of ``as_plain``, for a column's type."""
    if value is None:
        return None
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _EPOCH + dt.timedelta(microseconds=value)
    if isinstance(kind, T.DateType):
        return _EPOCH.date() + dt.timedelta(days=value)
    if isinstance(kind, T.TimeType):
        return (_EPOCH + dt.timedelta(microseconds=value)).time()
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.BinaryType):
        return bytes.fromhex(value)
    return value


def micros(value: dt.datetime) -> int:
    return (value - _EPOCH) // dt.timedelta(microseconds=1)


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether a column of the first type may become one of the second."""
    if old == new:
        return True
    if isinstance(old, T.IntegerType):
        return isinstance(new, T.LongType)
    if isinstance(old, T.FloatType):
        return isinstance(new, T.DoubleType)
    return isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and old.scale == new.scale and old.precision <= new.precision
