"""SimHash fingerprints and near-duplicates by anchor-point covering.

The anchors are a covering code of length 64 with radius 1: the perfect
Hamming code of length 63, and a free 64th bit. Two fingerprints that differ
in at most ``threshold`` bits have a word between them that differs from
either in at most half as many, rounded up; that word lies within 1 of some
anchor. So every fingerprint visits all anchors within 1 + threshold / 2, and
those that meet at an anchor are compared. (If one of the two stayed at its own
anchor, the other would have to go as far as 1 + threshold, which is far more
anchors.) With a threshold of 2 a fingerprint visits at most 33 anchors of
2**58, so few meet that aren't close, at any number of fingerprints.

Only distinct fingerprints are compared: copies, however many, are one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, pick, texts
from .components import components

SEED = 42


def digests(text: bytes, width: int = 3) -> np.ndarray:
    """Hashes of a text's word shingles, in order; of ``width`` words or fewer that of the whole."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, (ends[width - 1 :] - 1).tolist())), np.uint64, len(begins))


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    return fingerprint_of(digests(text, width))


def fingerprint_of(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint as a signed long."""

    def batch(b: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(x, width) for x in texts(b.column(1))], np.uint64)
        return {"doc_id": b.column(0), "fp": pa.array(fp.view(np.int64)), "text_hash": b.column(2)}

    return map_batches(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), batch, "doc_id long, fp long, text_hash long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of bits 0 to 62 in the Hamming code whose check column for bit i is i + 1."""
    out = np.zeros(len(x), np.uint64)
    for k in range(6):
        mask = np.uint64(sum(1 << i for i in range(63) if (i + 1) >> k & 1))
        out |= (np.bitwise_count(x & mask) & np.uint8(1)).astype(np.uint64) << np.uint64(k)
    return out


def _home(x: np.ndarray) -> np.ndarray:
    """The one anchor within 1 of each word that has its free bit."""
    s = _syndrome(x)
    return np.where(s == 0, x, x ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))))


def anchors(x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within ``reach`` (1 or more) of each word: places in x, and the anchors.

    Of the bits in which such an anchor differs from x, take one that isn't the
    free bit: without it, a word within ``reach - 1`` of x remains whose home is
    that anchor. Only an anchor that differs in just the free bit has no such
    word, so it is added.
    """
    patterns = [sum(1 << i for i in c) for k in range(reach) for c in itertools.combinations(range(64), k)]
    places, found = [], []
    for a in [*(_home(x ^ np.uint64(p)) for p in patterns), _home(x) ^ np.uint64(1 << 63)]:
        ok = np.flatnonzero(np.bitwise_count(a ^ x) <= reach)
        places.append(ok)
        found.append(a[ok])
    place, anchor = np.concatenate(places), np.concatenate(found)
    order = np.lexsort((anchor, place))
    place, anchor = place[order], anchor[order]
    once = np.concatenate([[True], (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1])]) if len(place) else np.zeros(0, bool)
    return place[once], anchor[once]


def _dealt(distinct: DataFrame, reach: int) -> DataFrame:
    """(anchor, fp): one row for each anchor within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                fp = b.column(0).slice(k, 2000).to_numpy(zero_copy_only=False)
                at, a = anchors(fp.view(np.uint64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(fp[at])], names=["anchor", "fp"])

    return distinct.mapInArrow(run, "anchor long, fp long")


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, other): pairs of distinct fingerprints, fp < other, at most ``threshold`` bits apart.

    A pair may come several times, from several anchors. Thresholds above 4 aren't provided: the anchors to visit grow with its half's power.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("threshold must be from 0 to 4")
    one = _dealt(distinct.select("fp"), 1 + (threshold + 1) // 2)
    two = one.toDF("anchor2", "other")
    near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= threshold)
    return one.join(two, (F.col("anchor") == F.col("anchor2")) & near).select("fp", "other")


def meetings(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, other): fingerprints at most ``threshold`` bits from the least that visits an anchor of theirs, once for each such anchor.

    A row a visit at most, whatever the number of fingerprints that are close to each other; not all pairs of ``links``.
    """
    one = _dealt(distinct.select("fp"), 1 + (threshold + 1) // 2)
    least = one.groupBy("anchor").agg(F.min("fp").alias("other"), F.count("*").alias("of")).where("of > 1").drop("of")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= threshold
    return one.join(least, "anchor").where((F.col("fp") != F.col("other")) & near).select("fp", "other")


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row for each row of ``docs``.

    component_id is the smallest doc_id that links lead to, the row's own
    included. Null and empty texts, and those of white space, have fingerprint
    zero and link like any other. A row with a null doc_id has the id of its
    component, which is null if no row in it has an id. Repeated rows stay. An
    empty table gives an empty result; other columns are ignored.
    """
    each, by_fp = _grouped(docs, width, threshold)
    out = each.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _grouped(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of every row, and (fp, root, component_id) of every fingerprint."""
    each = durable(fingerprints(docs, width))
    distinct = durable(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = components(links(distinct, threshold))
    named = distinct.join(rooted, distinct["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = durable(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return each, named.join(ids, "root").select("fp", "root", "component_id")


def without_near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, null last, and of its rows the text of least hash.

    Rows are told apart by id and text; those equal in both count once. The
    pipeline takes ``similar.without_similar``, which goes by similarity.
    Columns stay as they are.
    """
    each, by_fp = _grouped(docs, width, threshold)
    kept = each.join(by_fp, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_kept"), F.col("k.text_hash").alias("_text"))
    names = docs.columns
    d = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    d = d.withColumn("_id", F.col(f"_d{names.index('doc_id')}").cast("long")).withColumn("_hash", F.xxhash64(f"_d{names.index('text')}"))
    d = d.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_text")), "left_semi").dropDuplicates(["_id", "_hash"])
    return d.select(*[F.col(f"_d{i}").alias(n) for i, n in enumerate(names)])
