"""As-of and positional joins over many partitions, with hot keys and ties."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from moraine.plans.joins import asof_join, positional_join


@pytest.fixture
def many(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_positional_join_of_large_tables(many):
    n = 600_000
    a = many.range(n).select(((F.col("id") * 7919) % n).alias("a"))
    b = many.range(n).select(((F.col("id") * 104729) % n).alias("b"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    got = positional_join(a, b, ["a"], ["b"])
    assert got.columns == ["a", "b", "wide"]
    assert got.agg(F.count("*"), F.sum((F.col("a") == F.col("b")).cast("long"))).first()[:] == (n, n)


def test_positional_join_with_ties_and_unlike_lengths(many):
    a = many.range(50_000).select((F.col("id") % 3).alias("k"))
    b = many.range(70_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    rows = positional_join(a, b, ["k"], ["k"]).collect()
    assert len(rows) == 70_000 and sorted(r.v for r in rows) == list(range(70_000))
    assert sorted(r.k for r in rows if r.k is not None) == sorted(k % 3 for k in range(50_000)) and sum(r.k is None for r in rows) == 20_000
    assert positional_join(a.where("false"), b.where("false"), ["k"], ["k"]).count() == 0


def test_asof_join_with_a_hot_key(many):
    r = random.Random(2)
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    left = [(key(), r.choice([None, *range(3000)]), i) for i in range(20_000)]
    right = [(key(), r.choice([None, *range(0, 3000, 7)]), 10_000 + i) for i in range(300)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    got = asof_join(many.createDataFrame(left, "k string, t int, i int"), many.createDataFrame(right, "k string, t int, v int"), ["k"], "t", "t")
    assert got.columns == ["k", "t", "i", "t_right", "v"]
    times = {}
    for k, t, v in sorted((x for x in right if None not in x), key=lambda x: x[:2]):
        times.setdefault(k, []).append((t, v))
    want = {}
    for k, t, i in left:
        at = bisect.bisect_right([x[0] for x in times.get(k, [])], t) if t is not None else 0
        want[i] = times[k][at - 1] if at else (None, None)
    assert {x.i: (x.t_right, x.v) for x in got.collect()} == want
