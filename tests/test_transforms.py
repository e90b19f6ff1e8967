"""Partition transforms: columns against values, and hashes of many strings against one at a time."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions.transforms import Transform, murmur3, murmur3_of


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.binary(min_size=100, max_size=300), max_size=30))
def test_many_hashes(values):
    assert murmur3_of(values).tolist() == [murmur3(v) for v in values]


def test_published_hashes():
    # bytes of the long 34, and of the text "iceberg", in the format's specification
    assert murmur3((34).to_bytes(8, "little")) == 2017239379
    assert murmur3_of([b"iceberg", (34).to_bytes(8, "little")]).tolist() == [1210000089, 2017239379]


@pytest.mark.parametrize("arg", ["bucket[7]", "truncate[3]"])
def test_strings(spark, arg):
    t = Transform.parse(arg)
    rows = [(v,) for v in ("", "a", "abc", "abcd", "é日本🙂x", "x" * 1000, None, "a")]
    got = spark.createDataFrame(rows, "s string").select("s", t.column(F.col("s"), T.StringType()).alias("v")).collect()
    assert [r.v for r in got] == [t(r.s, T.StringType()) for r in got]


def test_hours_are_exact(spark):
    t = Transform.parse("hour")
    us = [0, -1, 3_600_000_000 - 1, 3_600_000_000, -3_600_000_000, -3_600_000_001, 253_402_300_799_999_999]
    times = [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=x) for x in us]
    got = spark.createDataFrame([(x,) for x in times], "t timestamp_ntz").select("t", t.column(F.col("t"), T.TimestampNTZType()).alias("v")).collect()
    assert [r.v for r in got] == [t(r.t, T.TimestampNTZType()) for r in got] == [x // 3_600_000_000 for x in us]
    assert np.all(np.diff(sorted(r.v for r in got)) >= 0)
