"""Mixing sources to target weights by a low-discrepancy schedule.

DataFrame functions only. The unit interval is cut into one piece for each
source, as long as the source's share of the target. The points
``frac(i * golden ratio)`` for i = 1, 2, ... fall into those pieces, and each
point is a slot of the mix. A source's r-th slot takes the r-th block of its
shuffled words. Blocks hold equally many words; the last one of a source may
be cut at its target. When a source runs out, its stream starts again.
Points fall evenly, but a source of few blocks may get too few of them, or
none; such a source has the slots it lacks after the last point.

Every running sum is made in two levels (within buckets, then over the
buckets' totals), so no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pick, small, word_count

#: Fractional parts of the golden ratio, and of 2**20 times it; fixed values.
STEP, STEP_20 = 0.6180339887498949, 0.607787409740351
#: Sources up to this number are broadcast; rows are of about 60 bytes.
FEW_SOURCES = 50_000
#: Cells into which the unit interval is cut to find a slot's source.
CELLS = 4096
#: A source that lacks more than one part in so many of its target is topped up.
LACK = 50


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): each row's words; a null text has none."""
    d = pick(docs, "doc_id", "text", "source")
    return durable(d.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(sid, source, source_size, target): shares by weight, none above ``most`` times its size.

    Sources in code point order, null last, take the weights in turn. What a
    source can't take is shared again by weight among the others: with sources
    sorted by limit / weight, those up to some place stop at their limit and
    the others share what is left. One row a source passes through one task.
    """
    one = F.lit(1)
    w = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(w) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)).cast("long"))
    s = s.withColumn("limit", F.col("source_size") * most)
    by_ratio = Window.partitionBy(one).orderBy(F.col("limit") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(one)
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(from_here))
    s = s.withColumn("stops", F.col("limit") * F.col("open") <= F.col("left") * F.col("weight"))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(everything), F.lit(0)))
    s = s.withColumn("shares", F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything))
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("shares"))
    return s.select(F.col("sid").cast("long"), "source", "source_size", target.alias("target"), "total")


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """(slot, sid, rank): the source of each slot, and its place among that source's slots from 0."""
    spark = sources.sparkSession
    one = Window.partitionBy(F.lit(1)).orderBy("sid")
    s = sources.where("target > 0").select("sid", F.sum(F.col("target") / F.col("total")).over(one).alias("hi"), (F.col("target") / F.col("total")).alias("share"))
    # the next piece begins where this one ends, to the last bit
    s = s.select("sid", F.coalesce(F.lag("hi").over(one), F.lit(0.0)).alias("lo"), F.when(F.lead("sid").over(one).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("long")
    s = s.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    i = F.col("slot") + 1
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit((1 << 20) - 1))
    part = lambda x: x - F.floor(x)
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("at", part(part(high * F.lit(STEP_20)) + part(low * F.lit(STEP))))
    placed = points.withColumn("cell", cell(F.col("at"))).join(small(durable(s), FEW_SOURCES), "cell").where("at >= lo and at < hi")
    placed = durable(placed.select("slot", "sid", F.shiftright("slot", 16).alias("chunk")))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = placed.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(chunks, ["sid", "chunk"]).select("slot", "sid", (F.col("first") + F.col("inside")).alias("rank"))


def topped_up(ranked: DataFrame, sources: DataFrame, block: int, slots: int) -> DataFrame:
    """``schedule``'s rows, and behind them those of sources that it leaves too far below their target.

    As with the targets, one row a source passes through one task.
    """
    takes = ranked.groupBy("sid").agg((F.max("rank") + 1).alias("n"))
    goal = F.round("target").cast("long")
    s = sources.join(takes, "sid", "left").select("sid", F.coalesce("n", F.lit(0)).alias("n"), goal.alias("goal"))
    s = s.where((F.col("goal") - F.col("n") * block) * LACK > F.col("goal")).withColumn("more", F.ceil(F.col("goal") / block).cast("long") - F.col("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("at", F.coalesce(F.sum("more").over(before), F.lit(0)) + slots)
    s = s.select("sid", "n", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1)).alias("k"))
    return ranked.unionByName(s.select((F.col("at") + F.col("k")).alias("slot"), "sid", (F.col("n") + F.col("k")).alias("rank")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 42, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix: what each slot takes from which documents.

    Returns two tables. ``placed`` has (doc_id, sid, size, source, source_size,
    target, start) for each row of ``docs``: start is its first word's place in
    the source's shuffled stream. ``pieces`` has (slot, sid, doc_id, start,
    size, first, last): the words first..last-1 of that document go there.

    Null and empty texts have size 0 and are never taken. A null source is a
    source of its own, last in order. Rows that repeat are documents of their
    own. An empty table gives empty results. Other columns are ignored. The
    result is a function of the rows and ``seed``. Every source gets its target
    rounded, or at most one part in LACK less.

    block: words in a block; by default 1/512 of a source's mean, from 16 to 4,096.
    """
    sizes = sized(docs)
    sources = durable(targets(sizes, weights, most))
    n_sources, total, rows = sources.agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0)), F.lit(sizes.count())).first()
    block = block or max(16, min(4096, total // (512 * max(1, n_sources))))
    slots = -(-total // block)
    buckets = max(16, rows // 20_000)
    ranked = durable(topped_up(durable(schedule(sources, block, slots)), sources, block, slots))
    takes = ranked.groupBy("sid").agg((F.max("rank") + 1).alias("n"))
    plan = durable(sources.join(takes, "sid", "left").withColumn("length", F.least(F.coalesce("n", F.lit(0)) * block, F.round("target").cast("long"))).drop("n"))

    d = sizes.join(small(plan, FEW_SOURCES), sizes["source"].eqNullSafe(plan["source"])).select("doc_id", sizes["source"], "size", "sid", "source_size", "target", "length")
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    # the mark's first 32 bits in equal ranges, so buckets follow the order of marks
    bucket = F.shiftright(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * buckets, 32)
    d = d.withColumn("mark", mark).withColumn("bucket", bucket)
    inside = Window.partitionBy("sid", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
    placed = durable(d.select("doc_id", "source", "size", "sid", "source_size", "target", "length", (F.col("base") + F.col("within")).alias("start")))

    rounds = F.sequence(F.lit(0), F.lit(most - 1))
    p = placed.where("size > 0 and length > start").select("doc_id", "sid", "size", "start", "length", F.explode(rounds).alias("round"), "source_size")
    p = p.withColumn("from", F.col("round") * F.col("source_size") + F.col("start"))
    p = p.withColumn("to", F.least(F.col("from") + F.col("size"), "length")).where("from < to")
    p = p.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    p = p.withColumn("first", F.greatest("from", F.col("rank") * block)).withColumn("last", F.least("to", (F.col("rank") + 1) * block))
    pieces = ranked.join(p, ["sid", "rank"]).select("slot", "sid", "doc_id", "start", "size", (F.col("first") - F.col("from")).alias("first"), (F.col("last") - F.col("from")).alias("last"))
    return placed, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source): what the mix takes of each row."""
    placed, pieces = mix(docs, **options)
    words = pieces.select("sid", "start", "doc_id", "size", (F.col("last") - F.col("first")).alias("words"))
    # rows of size 0 share a start, so they are kept apart
    none = placed.where("size > 0").drop("length").withColumn("words", F.lit(0).cast("long"))
    each = none.unionByName(words, allowMissingColumns=True).groupBy("sid", "start", "doc_id", "size")
    some = each.agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"), F.max("source").alias("source"))
    empty = placed.where("size = 0").drop("length").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(empty, allowMissingColumns=True).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it whole.

    A document on the edge of its source's target counts as taken once more if
    at least half its words are. Columns stay as they are, whatever their names.
    Rows that the mix doesn't take go, and so do null and empty texts, which
    have no words to take. Ids and sources may be null; rows alike in id,
    source and size share what the mix takes of them. An empty table stays empty.
    """
    t = taken(docs, **options).where("taken > 0").groupBy("doc_id", "source", "size")
    t = t.agg(F.round(F.sum("taken") / F.count("*") / F.first("size")).cast("int").alias("copies")).where("copies > 0")
    t = t.toDF("_m_doc_id", "_m_source", "_m_size", "_m_copies")
    names = docs.columns
    d = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    col = {n: F.col(f"_d{names.index(n)}") for n in ("doc_id", "source", "text")}
    d = d.withColumn("_size", word_count(col["text"]))
    joined = d.join(t, col["doc_id"].eqNullSafe(F.col("_m_doc_id")) & col["source"].eqNullSafe(F.col("_m_source")) & (F.col("_size") == F.col("_m_size")))
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_m_copies"))))
    return copies.select(*[F.col(f"_d{i}").alias(n) for i, n in enumerate(names)])
