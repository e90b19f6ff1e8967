"""Near-duplicates by exact Jaccard similarity of word shingles.

Two sets of shingles with a Jaccard similarity of at least t share one of the
first ``n - ceil(t * n) + 1`` shingles of each, in any order that holds for
all sets. Those prefixes are joined, so no pair is lost, and each pair found
is verified on its texts. The order is by hash, but shingles that are frequent
in a sample come last: that changes how many pairs are looked at, never which
are found.

SimHash comes first: sets whose fingerprints meet at an anchor, as in
``simhash``, are compared and linked, each with one other. Those few bits find
only the nearest, so the prefixes, which lose no pair, find the others.

Prefixes travel packed by bucket of shingle, and a bucket gives back only the
shingles that several sets have. Groups of many near copies would ask for all
their pairs. So each shingle's sets are first compared with one of them only,
its star: the one that shares its prefix with most others, which among copies
is the original or the copy that is most like the others. Then pairs that are
not yet linked by that are compared, if their prefixes share enough: in the
common order, a shingle of the prefix that ends first can only be in the
other's prefix, so what the two share is at most that much and what lies
behind.

Where a shingle still has many sets, and half of them are linked to each other
(the differences of others would be longer than they are), they are told apart by how they differ
from its star. With c = (1 - t) / (1 + t), two sets are similar if their
difference is at most c times their sizes' sum. Two that are both similar to
the star are linked by it. Of two others that are similar, the differences
from the star must share at least half of what the two have beyond c times the
sizes' sum, which is more than nothing. So prefixes of the differences stand
in for the shingle, again without losing a pair. A prefix of the set itself is
the case of an empty star.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, durable as _durable, input_bytes, map_batches, pick, small, texts
from .components import components
from .simhash import digests, fingerprint_of, meetings

WIDTH, SIMILARITY = 5, 0.8
#: Texts in the sample that orders shingles (one of so many hashes), and the frequent shingles that are put last.
SAMPLE, SEEN, MOST = 16, 8, 50_000
#: Hashes of texts that a task that compares pairs keeps, and pairs whose texts it takes at a time.
LATELY, AT_ONCE = 2_000_000, 500
#: A shingle of more sets, half of them linked, has them told apart by their differences from its star; so many times at most, then by pairs.
MANY, ROUNDS = 256, 2
#: Input bytes for each bucket of shingles; texts whose one copy goes to every executor, at most.
BUCKET_BYTES, FEW_TEXTS = 8 << 20, 200_000
_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("like", pa.bool_()), ("n", pa.int64()), ("d", pa.int64()), ("keys", pa.list_(pa.int64()))])
MEMBER = np.dtype([("key", "<i8"), ("set", "<i8"), ("n", "<i8"), ("pos", "<i8")])
_PARSED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set", pa.int64()), ("fp", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


durable = functools.partial(_durable, few=True)


def shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    """The distinct shingles; of ``width`` words or fewer the whole text; of none, none."""
    words = text.lower().split()
    if not words:
        return set()
    if len(words) <= width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Of two sorted arrays of distinct hashes (64 bits) of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many texts of the sample have, the most frequent last."""

    def batch(b: pa.RecordBatch) -> dict:
        return {"h": pa.array(np.concatenate([np.zeros(0, np.uint64), *(np.unique(digests(t, width)) for t in texts(b.column(0)))]).view(np.int64))}

    sample = docs.where(F.pmod(F.col("text_hash"), F.lit(SAMPLE)) == 0).select("text")
    counts = map_batches(sample, batch, "h long").groupBy("h").count().where(F.col("count") >= SEEN)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST).collect()
    return np.array([r.h for r in reversed(rows)], np.int64).view(np.uint64)


def _differences(x: np.ndarray, star: np.ndarray, like: bool, similarity: float) -> tuple[int, np.ndarray]:
    """The size of the difference of two sorted sets, and its prefix.

    y is a set similar to x, and not both are like the star. What x and y have
    in common of their differences is at least half of |dx| + |dy| - c (|x| +
    |y|), and no more than either. From |dy| > c (|y| + |star|) follows the
    bound for an x that is like the star, and from |x| <= |star| + |dx|, for y
    in the place of x, the one for an x that is not. What x has beyond the
    star comes first: few others have it.
    """
    c = (1 - similarity) / (1 + similarity)
    more, less = np.setdiff1d(x, star, assume_unique=True), np.setdiff1d(star, x, assume_unique=True)
    d = len(more) + len(less)
    shared = (d + c * (len(star) - len(x))) / 2 if like else (d - c * (len(x) + len(star))) / (1 + c)
    return d, np.concatenate([more, less])[: max(0, d - max(1, math.ceil(shared - 1e-9)) + 1)].view(np.int64)


def _compared(pairs: DataFrame, docs: DataFrame, each: DataFrame, width: int, similarity: float, differ: bool = False) -> DataFrame:
    """(a, b, like, n, d, keys) of the pairs: whether they are similar, a's size, and how a differs from b, by ``_differences``.

    Without ``differ`` only pairs that are similar, with nulls for the last two.
    """
    ids = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    one = each.join(ids, "set", "left_semi").groupBy("set").agg(F.min("text_hash").alias("text_hash"))
    rows = each.groupBy("text_hash").agg((F.count("*") > 1).alias("copied"))
    one = durable(one.join(rows, "text_hash"))
    met = docs.select("text_hash", "text").join(small(one, FEW_TEXTS), "text_hash").select("set", "text", "copied")
    # only texts that are there several times have to be told apart
    held = met.where("NOT copied").unionByName(met.where("copied").dropDuplicates(["set"])).select("set", "text")
    staged = Staged(held.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism))
    held = staged.read()
    both = pairs.join(held.toDF("a", "left"), "a").join(held.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # of the texts met lately
        room = LATELY

        def hashes(i: int, text: bytes) -> np.ndarray:
            nonlocal room
            if i not in known:
                h = np.unique(digests(text, width))
                if len(h) > room:
                    known.clear()
                    room = LATELY
                known[i] = h
                room -= len(h)
            return known[i]

        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                out = []
                for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), texts(b.column(3))):
                    x, y = hashes(i, x), hashes(j, y)
                    like = similar(x, y, similarity)
                    if like or differ:
                        out.append((i, j, like, len(x), *(_differences(x, y, like, similarity) if differ else (None, None))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_COMPARED), _COMPARED)], schema=_COMPARED)

    found = durable(both.mapInArrow(run, "a long, b long, like boolean, n long, d long, keys array<long>"))
    staged.drop()
    return found


def _blobs(bucket: np.ndarray, pack, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, blob) for each bucket of some records."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return [(int(bucket[a]), pack(*(c[a:z] for c in columns))) for a, z in zip(edge[:-1], edge[1:])]


def _parsed(d: DataFrame, width: int, similarity: float, late: np.ndarray, n_buckets: int) -> DataFrame:
    """A row (doc_id, text_hash, set, fp) for each row of ``d``, and rows (bucket, blob) with the prefixes of a batch's sets.

    A blob lists its sets with their sizes, then its shingles, each with the
    number of its set and its place in the prefix. A shingle keeps 32 bits
    beside those that chose the bucket: shingles that fall together make more
    pairs to verify, and lose none.
    """
    by_hash = np.argsort(late)
    known = late[by_hash]

    def pack(key: np.ndarray, own: np.ndarray, pos: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> bytes:
        names, at = np.unique(own, return_inverse=True)
        wide = max(len(names), int(pos.max()) + 1) >> 16 > 0
        slim = "<u4" if wide else "<u2"
        head = np.array([len(key), len(names), wide], "<u4").tobytes()
        return head + ids[names].astype("<i8").tobytes() + sizes[names].astype("<u4").tobytes() + key.astype("<u4").tobytes() + at.astype(slim).tobytes() + pos.astype(slim).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, sizes, keys, own, seen = [], [], [], [], [], set()
            for k, t in enumerate(x for a in range(0, b.num_rows, 500) for x in texts(b.column(1).slice(a, 500))):
                h = digests(t, width)
                fps.append(fingerprint_of(h))
                h = np.unique(h)
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), 3))
                sizes.append(len(h))
                if ids[-1] in seen or not len(h):
                    continue
                seen.add(ids[-1])
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, by_hash[at] + 1, 0)
                    h = h[np.lexsort((h, rank))]
                keys.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1])
                own.append(k)
            ids, sizes = np.array(ids, np.uint64).view(np.int64), np.array(sizes, np.int64)
            nothing = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids), pa.array(np.array(fps, np.uint64).view(np.int64)), *nothing], schema=_PARSED)
            if keys:
                lengths = [len(x) for x in keys]
                key, n = np.concatenate(keys), np.uint64(n_buckets)
                pos = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                rows = _blobs((key % n).astype(np.int64), lambda *c: pack(*c, ids, sizes), (key // n) & np.uint64(0xFFFFFFFF), np.repeat(own, lengths), pos)
                none = [pa.nulls(len(rows), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PARSED)

    return d.mapInArrow(run, "doc_id long, text_hash long, set long, fp long, bucket int, blob binary")


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    """Each (key, set) once, in that order."""
    out = [np.zeros(0, MEMBER)]
    for blob in blobs:
        n, m, wide = np.frombuffer(blob, "<u4", 3).tolist()
        slim, at, got = np.dtype("<u4" if wide else "<u2"), 12, []
        for kind, k in (("<i8", m), ("<u4", m), ("<u4", n), (slim, n), (slim, n)):
            got.append(np.frombuffer(blob, kind, k, at))
            at += k * np.dtype(kind).itemsize
        rows = np.zeros(n, MEMBER)
        rows["key"], rows["set"], rows["n"], rows["pos"] = got[2], got[0][got[3]], got[1][got[3]], got[4]
        out.append(rows)
    r = np.concatenate(out)
    r = r[np.lexsort((r["set"], r["key"]))]
    return r[np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["set"][1:] != r["set"][:-1])])] if len(r) else r


def _shared(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(blob): the sets (MEMBER) of shingles that several sets have."""

    def run(table: pa.Table) -> pa.Table:
        r = _unpacked(table.column("blob").to_pylist())
        bucket = table.column("bucket")[0].as_py()
        new = np.concatenate([[True], r["key"][1:] != r["key"][:-1]]) if len(r) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group] if len(r) else new
        members = r[several]
        members["key"] = members["key"] * n_buckets + bucket
        return pa.table({"blob": pa.array([members.tobytes()], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "blob binary")


def _members(shared: DataFrame) -> DataFrame:
    """(key, set, n, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                r = np.frombuffer(blob, MEMBER)
                for a in range(0, len(r), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(r[a : a + 100_000][n].astype(np.int64)) for n in MEMBER.names], names=list(MEMBER.names))

    return shared.mapInArrow(run, "key long, set long, n long, pos long")


def _met_at_anchors(each: DataFrame) -> DataFrame:
    """(a, b), a < b: sets with one fingerprint, each with the least of them; and each fingerprint with the one, of ``simhash.meetings``, it meets most often."""
    sets = durable(each.select("set", "fp").distinct())
    named = durable(sets.groupBy("fp").agg(F.min("set").alias("least")))
    same = sets.join(named, "fp").where("set != least").select(F.col("least").alias("a"), F.col("set").alias("b"))
    often = meetings(named.select("fp")).groupBy("fp", "other").agg(F.count("*").alias("of"))
    close = durable(often.groupBy("fp").agg(F.max(F.struct("of", "other")).alias("s")).select("fp", F.col("s.other").alias("other")))
    close = close.join(named.toDF("fp", "x"), "fp").join(named.toDF("other", "y"), "other")
    return durable(same.unionByName(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())


def _stars(members: DataFrame) -> DataFrame:
    """(key, s): of each key's sets the row of greatest weight: how many sets its keys are met in, in all."""
    of = members.groupBy("key").agg(F.count("*").alias("of"))
    weight = members.join(of, "key").groupBy("set").agg(F.sum("of").alias("weight"))
    rest = [c for c in members.columns if c not in ("key", "set")]
    return members.join(weight, "set").groupBy("key").agg(F.max(F.struct("weight", "set", *rest)).alias("s"))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """With the column root: of sets that are linked the least."""
    return rows.join(components(links.select("a", "b"), few=True).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _with_stars(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: each key's sets with its star, if they may be similar and have not one root."""
    star = _stars(members)
    met = members.join(star.select("key", F.col("s.set").alias("star"), F.col("s.n").alias("m"), F.col("s.pos").alias("at"), F.col("s.root").alias("there")), "key").where("root != there")
    # the first shingle that both have leaves enough behind it, in a pair that is similar
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9)
    met = met.where(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= need)
    return met.select(F.least("set", "star").alias("a"), F.greatest("set", "star").alias("b")).distinct()


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of keys whose sets aren't all linked, with their roots: the others have nothing more to compare."""
    members = durable(_rooted(members, links))
    split = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return durable(members.join(split, "key", "left_semi").select("key", "space", "set", "n", "d", "behind", "root"))


def _pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: sets of different roots whose prefixes share enough."""
    names = ["set", "n", "d", "behind"]
    x, y = members.select("key", "space", "root", F.struct(*names).alias("x")), members.select(F.col("key").alias("key2"), F.col("space").alias("space2"), F.col("root").alias("root2"), F.struct(*names).alias("y"))
    sized = (F.col("x.n") >= F.lit(similarity) * F.col("y.n") - 1e-9) & (F.col("y.n") >= F.lit(similarity) * F.col("x.n") - 1e-9)
    met = x.join(y, (F.col("key") == F.col("key2")) & (F.col("space") == F.col("space2")) & (F.col("root") < F.col("root2")) & sized)
    met = met.select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("space", "a", "b").agg(F.count("*").alias("shared"))
    need = F.ceil((F.col("a.d") + F.col("b.d") - F.lit((1 - similarity) / (1 + similarity)) * (F.col("a.n") + F.col("b.n"))) / 2 - 1e-9)
    met = met.where(F.col("shared") + F.greatest("a.behind", "b.behind") >= need)
    return met.select(F.col("a.set").alias("a"), F.col("b.set").alias("b")).distinct()


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root): rows with one root are linked by pairs of at least ``similarity``.

    Null and empty texts, and those of white space, have no shingle and are
    one group. Texts of ``width`` words or fewer are similar only if equal.
    Letter case (of ASCII) and white space make no difference. Repeated rows
    stay; a null doc_id is an id like any other. Other columns are ignored.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0, and 1 at most")
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    late = _frequent(d, width)
    n_buckets = input_bytes(d) // BUCKET_BYTES + 1
    parsed = Staged(_parsed(d, width, similarity, late, n_buckets))
    each = parsed.read().where("blob is null").select("doc_id", "text_hash", "set", "fp")
    shared = Staged(_shared(parsed.read().where("blob is not null").select("bucket", "blob"), n_buckets))
    seen = _met_at_anchors(each)
    links = _compared(seen, d, each, width, similarity).select("a", "b")
    stars = durable(_with_stars(_rooted(_members(shared.read()), links), similarity))
    seen = seen.unionByName(stars)
    links = links.unionByName(_compared(stars.join(links, ["a", "b"], "left_anti"), d, each, width, similarity).select("a", "b"))
    behind = F.ceil(F.lit(similarity) * F.col("n") - 1e-9) - 1
    members = _apart(_members(shared.read()).select("key", F.lit(0).cast("long").alias("space"), "set", "n", F.col("n").alias("d"), behind.alias("behind")), links)
    for _ in range(ROUNDS):
        of = members.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("of"), F.max("count").alias("most"))
        many = durable(of.where((F.col("of") > MANY) & (F.col("most") * 2 >= F.col("of"))).select("key"))
        if many.isEmpty():
            break
        large = durable(members.join(many, "key", "left_semi"))
        # the star is the set with most links
        degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
        star = large.join(degree, "set").groupBy("key").agg(F.max(F.struct("links", "set")).alias("s"))
        met = large.join(star.select("key", F.col("s.set").alias("star")), "key").where("set != star")
        met = _compared(durable(met.select(F.col("set").alias("a"), F.col("star").alias("b")).distinct()), d, each, width, similarity, differ=True)
        pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "like")
        seen, links = seen.unionByName(pair.drop("like")), links.unionByName(pair.where("like").drop("like"))
        new = met.select(F.col("b").alias("space"), F.col("a").alias("set"), "n", "d", (F.col("d") - F.size("keys")).alias("behind"), F.explode("keys").alias("key"))
        new = new.select(F.xxhash64("space", "key").alias("key"), "space", "set", "n", "d", "behind")
        members = _apart(members.join(many, "key", "left_anti").drop("root").unionByName(new), links)
    pairs = durable(_pairs(members, similarity).join(seen, ["a", "b"], "left_anti"))
    links = links.unionByName(_compared(pairs, d, each, width, similarity).select("a", "b"))
    out = durable(_rooted(each, links).select("doc_id", "text_hash", "root"))
    parsed.drop()
    shared.drop()
    return out


def without_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest doc_id, null last, and of its rows the text of least hash.

    Rows are told apart by id and text; those equal in both count once.
    Columns stay as they are.
    """
    each = groups(docs, width, similarity)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = durable(each.groupBy("root").agg(F.min(order).alias("k")))
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))
    rows = each.join(kept, "root").groupBy(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).agg(F.max(stays).alias("stays"), F.count("*").alias("of"))
    rows = durable(rows.where("NOT stays OR of > 1"))
    gone, twice = rows.where("NOT stays"), rows.where("stays")
    names = docs.columns
    d = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    d = d.withColumn("_id", F.col(f"_d{names.index('doc_id')}").cast("long")).withColumn("_hash", F.xxhash64(f"_d{names.index('text')}"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_text"))
    d = d.join(small(gone, FEW_TEXTS), same, "left_anti")
    if not twice.isEmpty():
        few = small(twice, FEW_TEXTS)
        d = d.join(few, same, "left_anti").unionByName(d.join(few, same, "left_semi").dropDuplicates(["_id", "_hash"]))
    return d.select(*[F.col(f"_d{i}").alias(n) for i, n in enumerate(names)])
