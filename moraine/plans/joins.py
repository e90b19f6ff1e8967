"""Joins that SQL here has no word for.

Both deal rows by ranges of what they are ordered by, and write the dealt rows
once: counts and carried rows must fit the very partitions that are joined
with them, and a plan that runs twice may deal differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import check
from ..sources.shared import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, suffix: str = "_right") -> DataFrame:
    """Each left row with the last right row of its keys at or before it; nulls if there is none.

    The union of both sides is dealt by ranges of key and time, so a key of any
    size spans many parts. A row finds its partner in its own part, or else the
    last one of its key in the parts before; one row a key and part is carried
    so. No pair of rows is made. Of right rows that tie, any one is taken; rows
    with a null key or time find nothing and are found nowhere. Right columns
    that clash get the suffix.
    """
    check(by, "Key columns are mandatory")
    mine = left.columns
    others = [c for c in right.columns if c not in by]
    renamed = {c: c + suffix if c in mine else c for c in others}
    keys = [f"_k{i}" for i in range(len(by))]
    key_columns = lambda: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    l_side = left.select(*key_columns(), F.col(f"`{left_on}`").alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in mine]).alias("_left"))
    r_side = right.select(*key_columns(), F.col(f"`{right_on}`").alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(f"`{c}`").alias(renamed[c]) for c in others]).alias("_right"))
    r_side = r_side.where(" AND ".join([f"{k} IS NOT NULL" for k in keys] + ["_t IS NOT NULL"]))
    both = l_side.unionByName(r_side, allowMissingColumns=True)
    # many rows of one key, time and side are dealt by a hash as well
    both = both.withColumn("_tie", F.xxhash64("_left", "_right") if not _has_map(both) else F.monotonically_increasing_id())
    dealt = written(both.repartitionByRange(*keys, "_t", "_side", "_tie").withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p", *keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn("_here", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1")
    parts = dealt.groupBy("_p", *keys).agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_before IS NOT NULL").select("_p", *keys, "_before")
    joined = here.join(carried, ["_p", *keys], "left").withColumn("_found", F.coalesce("_here", F.when(F.col("_t").isNotNull(), F.col("_before"))))
    return joined.select(*[F.col(f"_left.`{c}`").alias(c) for c in mine], *[F.col(f"_found.`{renamed[c]}`").alias(renamed[c]) for c in others])


def _has_map(df: DataFrame) -> bool:
    return "map<" in df.schema.simpleString()


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """First row with first row and so on, in the given orders; the shorter side ends in nulls.

    Row numbers come from ranges: rows are counted by range, and a range's
    rows are numbered among themselves, so no side passes through one task.
    Rows that tie in their order are dealt by a hash of all their columns.
    """
    sides = []
    for df, order, name in ((left, left_order, "l"), (right, right_order, "r")):
        d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)])
        d = d.withColumn("_tie", F.lit(0) if _has_map(df) else F.xxhash64(name))
        keys = [*(f"_o{i}" for i in range(len(order))), "_tie"]
        d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).select(name, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_id"))
        d = written(d)
        before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        parts = d.groupBy("_p").agg(F.count("*").alias("n"), F.min("_id").alias("first")).select("_p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        sides.append(d.join(F.broadcast(parts), "_p").select((F.col("base") + F.col("_id") - F.col("first")).alias("_n"), name))  # one row a partition
    joined = sides[0].join(sides[1], "_n", "full_outer")
    return joined.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *[F.col(f"r.`{c}`").alias(c if c not in left.columns else f"{c}_right") for c in right.columns])
