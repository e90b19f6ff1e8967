"""Partition transforms: how rows are laid out, without columns of their own.

Each transform has a Spark expression for writing, and the same function on a
Python value for pruning and for naming partitions.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError, check
from .types import micros

#: Spark's hash() is Murmur3 from seed 42; this int hashes to 0 from there, which makes the seed of the next argument 0. A fixed value.
TO_SEED_0 = -1693959553
_TIMES = (T.TimestampNTZType, T.TimestampType)


def murmur3(data: bytes, seed: int = 0) -> int:
    """32-bit Murmur3 (x86), as a signed number."""
    mask = 0xFFFFFFFF
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    h = seed
    whole = len(data) & ~3
    for a in range(0, whole, 4):
        h ^= turn(int.from_bytes(data[a : a + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h, 13) * 5 + 0xE6546B64) & mask
    if rest := data[whole:]:
        h ^= turn(int.from_bytes(rest, "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def bucket_bytes(value: object, kind: T.DataType) -> bytes:
    """What a bucket transform hashes."""
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(value).to_bytes(8, "little", signed=True)
    if isinstance(kind, T.DateType):
        return (value - dt.date(1970, 1, 1)).days.to_bytes(8, "little", signed=True)
    if isinstance(kind, _TIMES):
        return micros(value).to_bytes(8, "little", signed=True)
    if isinstance(kind, T.TimeType):
        return (((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond).to_bytes(8, "little", signed=True)
    if isinstance(kind, T.DecimalType):
        n = int(decimal.Decimal(value).scaleb(kind.scale).to_integral_value())
        return n.to_bytes(max(1, (n if n >= 0 else ~n).bit_length() // 8 + 1), "big", signed=True)
    if isinstance(kind, T.StringType):
        return value.encode()
    if isinstance(kind, T.BinaryType):
        return bytes(value)
    raise ValidationError(f"Cannot bucket {kind.simpleString()}")


@dataclass(frozen=True)
class Transform:
    """``name`` is identity, year, month, day, hour, truncate or bucket; ``arg`` the width or number of buckets."""

    name: str
    arg: int | None = None

    @staticmethod
    def parse(text: str) -> Transform:
        m = re.fullmatch(r"\s*(identity|year|month|day|hour|void|truncate|bucket)s?\s*(?:[\[(]\s*(\d+)\s*[\])])?\s*", text.lower())
        check(m, "Unknown transform %s", text)
        needs = m[1] in ("truncate", "bucket")
        check(bool(m[2]) == needs and (not needs or int(m[2]) > 0), "Invalid transform %s", text)
        return Transform(m[1], int(m[2]) if needs else None)

    def __str__(self) -> str:
        return f"{self.name}[{self.arg}]" if self.arg else self.name

    def check(self, kind: T.DataType) -> None:
        """Whether it can take a column of this type."""
        ok = {
            "identity": not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)),
            "void": True,
            "year": isinstance(kind, (T.DateType, *_TIMES)),
            "month": isinstance(kind, (T.DateType, *_TIMES)),
            "day": isinstance(kind, (T.DateType, *_TIMES)),
            "hour": isinstance(kind, _TIMES),
            "truncate": isinstance(kind, (T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.BinaryType)),
            "bucket": not isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.BooleanType, T.FloatType, T.DoubleType)),
        }[self.name]
        check(ok, "Invalid source type %s for transform: %s", kind.simpleString(), self)

    def result(self, kind: T.DataType) -> T.DataType:
        return kind if self.name in ("identity", "truncate", "void") else T.IntegerType()

    def column(self, c: Column, kind: T.DataType) -> Column:
        if self.name == "identity":
            return c
        if self.name == "void":
            return F.lit(None).cast(kind)
        if self.name == "year":
            return F.year(c) - 1970
        if self.name == "month":
            return (F.year(c) - 1970) * 12 + F.month(c) - 1
        if self.name == "day":
            return F.unix_date(c.cast("date"))
        if self.name == "hour":
            us = _micros(c, kind)
            hour = F.lit(3_600_000_000).cast("bigint")
            return F.call_function("div", us - F.pmod(us, hour), hour).cast("int")
        if self.name == "truncate":
            if isinstance(kind, (T.StringType, T.BinaryType)):
                return F.substring(c, 1, self.arg)
            if isinstance(kind, T.DecimalType):
                w = F.lit(decimal.Decimal(self.arg).scaleb(-kind.scale))
                return (c - F.pmod(c, w)).cast(kind)
            return (c - F.pmod(c, F.lit(self.arg).cast(kind))).cast(kind)
        if self.arg == 1:
            return F.when(c.isNotNull(), F.lit(0))
        if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
            h = _murmur3_udf(kind)(c)
        else:
            number = F.unix_date(c) if isinstance(kind, T.DateType) else _micros(c, kind) if isinstance(kind, (*_TIMES, T.TimeType)) else c
            h = F.when(c.isNotNull(), F.hash(F.lit(TO_SEED_0), number.cast("bigint")))
        return h.bitwiseAND(F.lit(0x7FFFFFFF)) % self.arg

    def __call__(self, v: object, kind: T.DataType) -> object:
        if v is None or self.name == "void":
            return None
        if self.name == "identity":
            return v
        if self.name == "year":
            return v.year - 1970
        if self.name == "month":
            return (v.year - 1970) * 12 + v.month - 1
        if self.name == "day":
            return ((v.date() if isinstance(v, dt.datetime) else v) - dt.date(1970, 1, 1)).days
        if self.name == "hour":
            return micros(v) // 3_600_000_000
        if self.name == "truncate":
            if isinstance(v, (str, bytes)):
                return v[: self.arg]
            if isinstance(v, decimal.Decimal):
                n = int(v.scaleb(kind.scale).to_integral_value(decimal.ROUND_FLOOR))
                return decimal.Decimal(n - n % self.arg).scaleb(-kind.scale)
            return v - v % self.arg
        return 0 if self.arg == 1 else (murmur3(bucket_bytes(v, kind)) & 0x7FFFFFFF) % self.arg

    @property
    def ordered(self) -> bool:
        """Whether a larger value never has a smaller result."""
        return self.name not in ("bucket", "void")


def _micros(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimeType):
        part = F.date_part(F.lit("second"), c)
        return F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000 + (part * 1_000_000).cast("bigint")
    return F.unix_micros(c.cast(T.TimestampType()))  # the session is in UTC


def murmur3_of(values: list[bytes]) -> np.ndarray:
    """``murmur3`` of many strings: a step takes the next four bytes of all that have so many."""
    u = np.uint32
    lengths = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(values) + bytes(4), np.uint8).astype(u)
    at, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    turned = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    mixed = lambda k: turned(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    h, blocks = np.zeros(len(n), u), n // 4
    for k in range(int(blocks.max(initial=0))):
        live = int(np.searchsorted(-blocks, -k))  # the longer ones come first
        p = at[:live] + 4 * k
        word = data[p] | data[p + 1] << u(8) | data[p + 2] << u(16) | data[p + 3] << u(24)
        h[:live] = turned(h[:live] ^ mixed(word), 13) * u(5) + u(0xE6546B64)
    rest, end = n % 4, at + 4 * blocks
    tail = np.zeros(len(n), u)
    for j in range(3):
        tail |= np.where(rest > j, data[np.minimum(end + j, len(data) - 1)] << u(8 * j), u(0))
    h ^= mixed(tail)  # of no bytes it is 0
    h ^= n.astype(u)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(shift))) * u(by)
    out = np.empty(len(n), np.int64)
    out[order] = (h ^ (h >> u(16))).view(np.int32)
    return out


def _murmur3_udf(kind: T.DataType):
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0

    @F.pandas_udf("int")
    def h(values: pd.Series) -> pd.Series:
        as_kind = T.DecimalType(38, scale) if scale or isinstance(kind, T.DecimalType) else kind
        codes, distinct = pd.factorize(values)
        hashed = np.append(murmur3_of([bucket_bytes(v, as_kind) for v in distinct]), 0)
        out = pd.Series(np.where(codes >= 0, hashed[np.maximum(codes, 0)], 0), dtype="Int64")
        out[codes < 0] = pd.NA
        return out

    return h


def is_nan(v: object) -> bool:
    return isinstance(v, float) and math.isnan(v)
