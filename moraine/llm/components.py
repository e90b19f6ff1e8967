"""Connected components of a table of links, by alternating stars.

Each round rewires every node's larger neighbours to its least neighbour, then
its smaller ones likewise (Kiveris et al., "Connected Components in MapReduce
and Beyond"). It ends with stars. Minima are taken by aggregation and joined
back, so a node with very many links doesn't meet in one task: the aggregation
is partial, and the join is one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    rewired = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return rewired.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, few: bool = False) -> DataFrame:
    """(node, root): the least node of each linked node's component.

    ``links`` has two columns of one ordered type; links to oneself and those
    with a null say nothing. Nodes without a link, and roots, aren't listed.
    ``few`` is for ``durable``.
    """
    u, v = links.columns
    now = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct()
    now = durable(now, few)
    state = None
    while True:
        count, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not count or (count, mark) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (count, mark)
        now = durable(_small(_large(now)), few)
