"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is the set of its word shingles (five words, lower case, punctuation
dropped; an item of fewer words is one shorter shingle). A document holds an
item if it has at least ``threshold`` of the item's shingles. The document may
be any size longer than the item, so their Jaccard similarity says little.
Instead an item's sketch is looked up inside the document: the k shingles of
least hash, that is, the k minima of a MinHash permutation. Items are
partitioned by size into powers of two; all of one partition take the k that
its largest size asks for: one more than the shingles an item may lack. So a
document that holds an item has at least one shingle of its sketch, and no
pair is lost. Every candidate is then verified by exact containment.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, pick, texts

WIDTH, THRESHOLD = 5, 0.8
WORDS = re.compile(r"\w+")
#: Benchmarks up to so many bytes go to every executor whole; larger ones are joined by shuffling.
BROADCAST_BYTES = 8_000_000
#: Up to so many of their sketches' shingles are marked in a table of bits, which keeps others from being shuffled.
MARKED, MARK_BITS = 4_000_000, 27
PAIR = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def words(text: bytes) -> list[str]:
    return WORDS.findall(text.decode("utf-8", "replace").lower())


def shingles(w: list[str], width: int = WIDTH) -> set[tuple[str, ...]]:
    """The distinct shingles; of fewer words the whole sequence; of none, none."""
    if not w:
        return set()
    width = min(width, len(w))
    return set(zip(*(w[i:] for i in range(width))))


def sketch(item: set[tuple[str, ...]], threshold: float = THRESHOLD) -> list[tuple[str, ...]]:
    """The k shingles of least hash; k by the item's size partition."""
    upper = 1 << (len(item) - 1).bit_length()
    k = upper - int(np.ceil(threshold * upper - 1e-9)) + 1
    return sorted(item, key=lambda s: (xxhash.xxh64_intdigest("\x1f".join(s), 1), s))[:k]


class Index:
    """Sketches of all items, for one pass over any number of documents."""

    def __init__(self, items: list[tuple[int | None, bytes]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.sets = [shingles(words(t)) for _, t in items]
        self.vocab: dict[str, int] = {}
        at: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, s in enumerate(self.sets):
            for x in sketch(s, threshold) if s else ():
                codes = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in x])
                at[len(x)][int(self._mix(codes, len(x))[0])].append(k)
        self.at = {n: (np.array(sorted(d), np.uint64), d) for n, d in at.items()}

    @staticmethod
    def _mix(codes: np.ndarray, n: int) -> np.ndarray:
        """One number for each run of n words; equal runs have equal numbers."""
        c = codes.astype(np.uint64)
        h = np.zeros(len(c) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def __call__(self, text: bytes) -> list[tuple[int, int, int]]:
        """(place of the item, its shingles, those that the text has), for all that the text holds."""
        w = words(text)
        get = self.vocab.get
        codes = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        found: set[int] = set()
        for n, (keys, d) in self.at.items():
            if len(codes) < n:
                continue
            known = np.concatenate([[0], np.cumsum(codes < 0)])
            ok = np.flatnonzero(known[n:] == known[:-n])
            if len(ok):
                h = np.unique(self._mix(codes, n)[ok])
                for x in h[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h].tolist():
                    found.update(d[x])
        out, sets = [], {}
        for k in sorted(found):
            n = len(next(iter(self.sets[k])))
            own = sets[n] if n in sets else sets.setdefault(n, set(zip(*(w[i:] for i in range(n)))))
            shared = len(self.sets[k] & own)
            if shared >= self.threshold * len(self.sets[k]) - 1e-9:
                out.append((k, len(self.sets[k]), shared))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return pick(benchmark, "item_id", "text").where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()


def _fits(items: DataFrame, most: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) <= most


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every item that a document holds.

    Null texts, and texts without a word, hold nothing and are held nowhere.
    Ids may be null. Documents that repeat have a row each; items that repeat
    with the same id and text count once. Empty tables give an empty result;
    other columns are ignored.
    """
    items = _items(benchmark)
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    if not _fits(items, broadcast_bytes):
        return _joined(d, items, threshold).drop("digest")
    shared = d.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, threshold)
        for b in batches:
            rows = [(i, index.ids[k], n, m, m / n) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))) for k, n, m in index(t)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()])], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return d.mapInArrow(run, PAIR)


def _joined(d: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for a benchmark of any size, with a digest of the text: sketches meet documents by a shuffled join."""

    def hashes(b: pa.RecordBatch, every: bool, marks=None) -> dict:
        at, out = [], []
        for k, t in enumerate(texts(b.column(1))):
            w = words(t)
            if every:
                s = {x for n in range(1, WIDTH + 1) for x in zip(*(w[i:] for i in range(n)))}
            else:
                s = sketch(x, threshold) if (x := shingles(w)) else ()
            h = np.fromiter((xxhash.xxh64_intdigest("\x1f".join(x), 2) for x in s), np.uint64, len(s))
            if marks is not None:
                h = h[marks.value[(h >> np.uint64(64 - MARK_BITS)).astype(np.int64)]]
            out += h.view(np.int64).tolist()
            at += [k] * len(h)
        return {"id": b.column(0).take(pa.array(at, pa.int64())), "text_hash": b.column(2).take(pa.array(at, pa.int64())), "h": pa.array(out, pa.int64())}

    schema = "id long, text_hash long, h long"
    keyed = d.withColumn("text_hash", F.xxhash64("text"))
    each = items.withColumn("text_hash", F.xxhash64("text"))
    item_side = durable(map_batches(each, lambda b: hashes(b, False), schema).select("h", F.col("text_hash").alias("item_hash")).distinct())
    marks = None
    if item_side.count() <= MARKED:
        table = np.zeros(1 << MARK_BITS, bool)
        known = item_side.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
        table[(known >> np.uint64(64 - MARK_BITS)).astype(np.int64)] = True
        marks = d.sparkSession.sparkContext.broadcast(table)
    doc_side = map_batches(keyed, lambda b: hashes(b, True, marks), schema)
    pairs = durable(doc_side.join(item_side, "h").select("text_hash", "item_hash").distinct())
    both = keyed.join(pairs, "text_hash").join(each.select(F.col("text_hash").alias("item_hash"), "item_id", F.col("text").alias("item")), "item_hash")

    def verify(b: pa.RecordBatch) -> dict:
        out = {"doc_id": [], "item_id": [], "n_item": [], "n_shared": [], "containment": [], "digest": []}
        for i, t, j, x, digest in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), texts(b.column(3)), b.column(4).to_pylist()):
            s, w = shingles(words(x)), words(t)
            n = len(next(iter(s)))
            shared = len(s & set(zip(*(w[k:] for k in range(n)))))
            if shared >= threshold * len(s) - 1e-9:
                for k, v in zip(out, (i, j, len(s), shared, shared / len(s), digest)):
                    out[k].append(v)
        return out

    return map_batches(both.select("doc_id", "text", "item_id", "item", F.sha2("text", 256).alias("digest")), verify, PAIR + ", digest string")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``contaminated``.

    Null and empty texts hold nothing and stay, whatever their ids; repeated
    rows each stay or go. An empty table stays empty, and with an empty
    benchmark all rows stay. Columns of any other name pass through.
    """
    items = _items(benchmark)
    if not _fits(items, broadcast_bytes):
        names = docs.columns
        d = docs.toDF(*[f"_d{i}" for i in range(len(names))])
        text = F.col(f"_d{names.index('text')}")
        held = _joined(d.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), items, threshold).select(F.col("digest").alias("_held")).distinct()
        d = d.join(held, F.sha2(text, 256) == F.col("_held"), "left_anti")
        return d.select(*[F.col(f"_d{i}").alias(n) for i, n in enumerate(names)])
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in items.collect()])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, threshold)
        for b in batches:
            yield b.filter(pa.array([not index(t) for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
