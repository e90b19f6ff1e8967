"""Removal of repeated byte strings, by prefix-free parsing.

Triggers cut texts into phrases: a position is a trigger if the rolling hash
of the ``K`` bytes from there is the least (leftmost of equals) of all those in
some window of ``WIDTH`` bytes. So every window has a trigger of its own, which
depends on the window's bytes alone, and consecutive windows mostly share one.
A phrase with its context is all windows of one trigger: the bytes from the
first window's begin to the last one's end. The dictionary of distinct phrases
holds the corpus' windows, each under its trigger's key; equal windows have
equal keys.

1. Each batch of texts is parsed. Of equal phrases in a batch the earliest
   goes on; the others are repeats.
2. By key: of equal phrases the earliest occurrence stays, the others are
   repeats as a whole. Keys with several distinct phrases are ambiguous, for
   those may share some windows and not others.
3. The bytes of ambiguous phrases are fetched once for each distinct phrase.
   They are the part of the dictionary whose suffixes must be told apart: the
   suffix array of the phrases under one key is made by prefix doubling, as far
   as WIDTH bytes, and suffixes that agree so far stand in the order in which
   the parse has them in the corpus. All but the earliest are repeats.
4. Repeats are gathered by document, and the bytes they cover are removed.

Phrases are named by a rolling hash of 64 bits within their key. They are too
short for strings on which a polynomial modulo 2**64 is known to fail (those
have a thousand bytes and more); windows are told apart by their bytes.

Phrases travel as arrays packed by bucket of key, so a row is a few thousand
of them. Numbers of buckets follow the corpus' size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, pick, texts

WIDTH, K = 100, 40
SPAN = WIDTH - K + 1
#: Texts are parsed in pieces of this many bytes, which bounds the arrays.
PIECE = 1 << 19
#: Base of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C55
#: From so many distinct phrases on, a key's windows are dealt out by their own hash.
WIDE = 20_000
#: Phrases in a bucket, about; a phrase begins every 31 bytes.
IN_BUCKET = 400_000
#: Pieces that are parsed before their phrases go on.
AT_ONCE = 16
FIRST_ID = -(1 << 63)
RUN_BITS = 7
#: Bytes of phrases whose suffixes are sorted at once, at least; a key's phrases stay together.
SORTED = 1 << 20
#: doc and sub are a row's doc_id and a hash of its text; loc is a begin and a number of windows.
PHRASE = np.dtype([("key", "<u8"), ("unit", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("loc", "<u8")])
CONTEXT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("loc", "<u8")])
REPEAT = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("start", "<i8"), ("n", "<i8")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Roller:
    """Polynomial hashes of any substring of a piece, by running sums modulo 2**64."""

    def __init__(self, most: int = PIECE + 4 * WIDTH):
        self.up, self.down = self._powers(BASE, most + 1), self._powers(pow(BASE, -1, 1 << 64), most + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the substrings a..b."""
        return mixed((sums[b] - sums[a]) * self.down[a])

    def every(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all substrings of n bytes."""
        return mixed((sums[n:] - sums[:-n]) * self.down[: len(sums) - n])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` neighbouring values the least."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : n]
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1]
    return np.minimum(ahead, back)


class Parser:
    def __init__(self):
        self.roller = Roller()

    def __call__(self, pieces: list[tuple[int, int, int, bytes]]) -> np.ndarray:
        """Phrases of some (doc, sub, place of the piece in its text, bytes)."""
        data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        if len(data) < WIDTH:
            return np.zeros(0, PHRASE)
        lengths = np.array([len(p[3]) for p in pieces])
        begins = np.cumsum(lengths) - lengths
        sums = self.roller.sums(data)
        keys = self.roller.every(sums, K)
        low = np.uint64((1 << 21) - 1)
        anchor = (least_of((keys & ~low) | np.arange(len(keys), dtype=np.uint64), SPAN) & low).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)[: len(anchor)]
        inside = np.arange(len(anchor)) + WIDTH <= (begins + lengths)[owner]
        edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]), [True]]))
        start, n = edge[:-1], np.diff(edge)
        start, n = start[inside[start]], n[inside[start]]
        own = owner[start]
        out = np.zeros(len(start), PHRASE)
        out["key"], out["unit"] = keys[anchor[start]], self.roller.of(sums, start, start + n + WIDTH - 1)
        out["doc"] = np.array([p[0] for p in pieces], np.int64)[own]
        place = np.array([p[2] for p in pieces], np.int64)[own] + start - begins[own]
        out["sub"], out["loc"] = np.array([p[1] for p in pieces], np.int64)[own], location(place, n)
        return out


def location(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(RUN_BITS)) | n.astype(np.uint64)


def repeats_at(phrases: np.ndarray) -> np.ndarray:
    """The windows of whole phrases, with neighbouring runs joined."""
    out = np.zeros(len(phrases), REPEAT)
    out["doc"], out["sub"] = phrases["doc"], phrases["sub"]
    out["start"], out["n"] = fields(phrases["loc"])
    return joined_runs(out)


def joined_runs(r: np.ndarray) -> np.ndarray:
    if len(r) < 2:
        return r
    r = r[np.lexsort((r["start"], r["sub"], r["doc"]))]
    new = np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["sub"][1:] != r["sub"][:-1]) | (r["start"][1:] != r["start"][:-1] + r["n"][:-1])])
    out = r[new].copy()
    out["n"] = np.add.reduceat(r["n"], np.flatnonzero(new))
    return out


def first_of_equals(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest of each (key, unit), sorted by key; all later ones). The same place twice is one."""
    p = p[np.lexsort((p["loc"], p["sub"], p["doc"], p["unit"], p["key"]))]
    if not len(p):
        return p, p
    new = np.concatenate([[True], (p["key"][1:] != p["key"][:-1]) | (p["unit"][1:] != p["unit"][:-1])])
    first = p[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (p["doc"] != first["doc"]) | (p["sub"] != first["sub"]) | (p["loc"] != first["loc"])
    return p[new], p[later]


def pieces_of(doc: int, sub: int, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    step = PIECE - WIDTH + 1  # every window lies in one piece
    for a in range(0, max(1, len(text) - WIDTH + 1), step):
        yield doc, sub, a, text[a : a + PIECE]


def _batches(b: pa.RecordBatch) -> Iterator[list]:
    """Pieces of all texts, some megabyte at a time."""
    some, size = [], 0
    for doc, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
        if len(text) < WIDTH:
            continue
        for p in pieces_of(doc, sub, text):
            if some and size + len(p[3]) > PIECE:
                yield some
                some, size = [], 0
            some.append(p)
            size += len(p[3])
    if some:
        yield some


def _rows(kind: int, buckets: np.ndarray, records: np.ndarray, pack=np.ndarray.tobytes) -> Iterator[pa.RecordBatch]:
    """Records packed by bucket."""
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    edge = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(buckets) else np.zeros(1, np.int64)
    blobs = [pack(records[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array(buckets[edge[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])


PACKED = "kind int, bucket int, blob binary"
PHRASES, REPEATS, CONTEXTS, WIDE_ONES = range(4)


def packed(p: np.ndarray, n_buckets: int) -> bytes:
    """Phrases of one bucket, column by column; documents by number in a list of their own.

    A key keeps 32 bits beside those that chose the bucket. Keys that fall
    together make an ambiguous one, no wrong result.
    """
    start, runs = fields(p["loc"])
    names, own = np.unique(np.stack([p["doc"], p["sub"]], axis=1), axis=0, return_inverse=True)
    columns = [names[:, 0].astype("<i8"), names[:, 1].astype("<i8"), (p["key"] // np.uint64(n_buckets)).astype("<u4"), p["unit"], own.ravel().astype("<u2" if len(names) < 1 << 16 else "<u4"), (start & 0xFFFF).astype("<u2"), (start >> 16).astype("<u2"), runs.astype(np.uint8)]
    return np.array([len(p), len(names)], "<u4").tobytes() + b"".join(c.tobytes() for c in columns)


def unpacked(blob: bytes, bucket: int, n_buckets: int) -> np.ndarray:
    n, m = np.frombuffer(blob, "<u4", 2).tolist()
    out, at, columns = np.zeros(n, PHRASE), 8, []
    for kind, k in (("<i8", m), ("<i8", m), ("<u4", n), ("<u8", n), ("<u2" if m < 1 << 16 else "<u4", n), ("<u2", n), ("<u2", n), ("u1", n)):
        columns.append(np.frombuffer(blob, kind, k, at))
        at += k * np.dtype(kind).itemsize
    doc, sub, key, unit, own, low, high, runs = columns
    out["key"], out["unit"], out["doc"] = key.astype(np.uint64) * np.uint64(n_buckets) + np.uint64(bucket), unit, doc[own]
    out["sub"], out["loc"] = sub[own], location(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(16)), runs)
    return out


def fields(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and number of windows."""
    return (loc >> np.uint64(RUN_BITS)).astype(np.int64), (loc & np.uint64((1 << RUN_BITS) - 1)).astype(np.int64)


def _parsed(keyed: DataFrame, n_buckets: int) -> DataFrame:
    def dealt(phrases: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, later = first_of_equals(np.concatenate(phrases))
        bucket = (first["key"] % np.uint64(n_buckets)).astype(np.int64)
        yield from _rows(PHRASES, bucket, first, lambda x: packed(x, n_buckets))
        again = repeats_at(later)
        yield from _rows(REPEATS, np.abs(again["doc"]) % n_buckets, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for b in batches:
            phrases = []
            for some in _batches(b):
                phrases.append(parse(some))
                if len(phrases) == AT_ONCE:
                    yield from dealt(phrases)
                    phrases = []
            if phrases:
                yield from dealt(phrases)

    return keyed.mapInArrow(run, PACKED)


def _gathered(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    rows = zip(table.column("kind").to_pylist(), table.column("blob").to_pylist())
    return np.frombuffer(b"".join(x for k, x in rows if k == kind), dtype)


def _by_key(parsed: DataFrame, n_buckets: int) -> DataFrame:
    """Repeats found by key, and the ambiguous phrases (kind PHRASES, or WIDE_ONES)."""

    def run(table: pa.Table) -> pa.Table:
        rows = zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist())
        every = [unpacked(blob, bucket, n_buckets) for kind, bucket, blob in rows if kind == PHRASES]
        first, later = first_of_equals(np.concatenate([np.zeros(0, PHRASE), *every]))
        del every
        edge = np.concatenate([[True], first["key"][1:] != first["key"][:-1]]) if len(first) else np.zeros(0, bool)
        group = np.cumsum(edge) - 1
        size = np.bincount(group)[group] if len(first) else np.zeros(0, int)
        again = np.concatenate([_gathered(table, REPEATS, REPEAT), repeats_at(later)])
        parts = [x for kind, r in ((REPEATS, again), (PHRASES, first[(size > 1) & (size <= WIDE)]), (WIDE_ONES, first[size > WIDE])) for x in _rows(kind, np.abs(r["doc"]) % n_buckets, r)]
        return pa.Table.from_batches(parts, schema=_ARROW)

    return parsed.groupBy("bucket").applyInArrow(run, PACKED)


_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def _unpacked(packed: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(doc, sub, at): each document's phrases of these kinds; at holds (key, start, n, wide) packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = np.frombuffer(blob, PHRASE)
                p = p[np.lexsort((p["loc"], p["sub"], p["doc"]))]
                sub = p["sub"]
                edge = np.flatnonzero(np.concatenate([[True], (p["doc"][1:] != p["doc"][:-1]) | (sub[1:] != sub[:-1]), [True]]))
                yield pa.RecordBatch.from_arrays([pa.array(p["doc"][edge[:-1]]), pa.array(sub[edge[:-1]]), pa.array([kind] * (len(edge) - 1), pa.int32()), pa.array([p[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])], pa.binary())], names=["doc", "sub", "kind", "at"])

    return packed.where(F.col("kind").isin(*kinds)).select("kind", "blob").mapInArrow(run, "doc long, sub long, kind int, at binary")


def _fetched(keyed: DataFrame, ambiguous: DataFrame, n_buckets: int) -> DataFrame:
    """Ambiguous phrases with their bytes, by key; those of wide keys window by window, by the windows' hashes."""
    wanted = ambiguous.groupBy("doc", "sub").agg(F.collect_list(F.struct("kind", "at")).alias("phrases"))
    d = keyed.join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, n = Roller(), np.uint64(n_buckets)
        for b in batches:
            heads, cut = [np.zeros(0, CONTEXT)], []
            for text, phrases in zip(texts(b.column(2)), b.column(3).to_pylist()):
                for x in phrases:
                    p = np.frombuffer(x["at"], PHRASE)
                    if x["kind"] == WIDE_ONES:
                        p = _windows(roller, p, text)
                    head = np.zeros(len(p), CONTEXT)
                    for c in CONTEXT.names:
                        head[c] = p[c]
                    start, runs = fields(p["loc"])
                    heads.append(head)
                    cut += [text[a:z] for a, z in zip(start.tolist(), (start + runs + WIDTH - 1).tolist())]
            head = np.concatenate(heads)
            at = np.arange(len(head))

            def pack(some: np.ndarray) -> bytes:
                return np.array([len(some)], "<i8").tobytes() + head[some].tobytes() + b"".join([cut[k] for k in some.tolist()])

            yield from _rows(CONTEXTS, (head["key"] % n).astype(np.int64), at, pack)

    return d.mapInArrow(run, PACKED)


def _windows(roller: Roller, p: np.ndarray, text: bytes) -> np.ndarray:
    """Each window of a text's phrases as a phrase, whose key is the window's hash."""
    start, runs = fields(p["loc"])
    out = np.repeat(p, runs)
    begin = np.repeat(start, runs) + np.arange(len(out)) - np.repeat(np.cumsum(runs) - runs, runs)
    for a in range(0, len(out), PIECE):
        some = begin[a : a + PIECE]
        low = int(some.min())
        for first in range(low, int(some.max()) + 1, PIECE):
            here = (some >= first) & (some < first + PIECE)
            sums = roller.sums(np.frombuffer(text[first : first + PIECE + WIDTH], np.uint8))
            out["key"][a : a + PIECE][here] = roller.of(sums, some[here] - first, some[here] - first + WIDTH)
    out["loc"] = location(begin, np.ones(len(out), np.int64))
    return out


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """For each place with WIDTH bytes from it on, the rank of these bytes among all such places; equal bytes have equal ranks.

    Prefix doubling: ranks of 8 bytes give those of 16, 32, 64, and of 100.
    """
    n = len(data) - 7
    now = np.zeros(n, np.uint64)
    for k in range(8):
        now = (now << np.uint64(8)) | data[k : k + n]
    _, now = np.unique(now, return_inverse=True)
    step = 8
    while step < WIDTH:
        by = min(step, WIDTH - step)
        _, now = np.unique(now[:-by] * np.int64(len(now)) + now[by:], return_inverse=True)
        step += by
    return now


def later_windows(head: np.ndarray, data: bytes) -> np.ndarray:
    """The repeats among all windows of some phrases, whose bytes stand one after the other in ``data``."""
    start, runs = fields(head["loc"])
    lengths = runs + WIDTH - 1
    begins = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(head)), runs)
    step = np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs)
    rank = suffix_ranks(np.frombuffer(data, np.uint8))[begins[own] + step]
    w = np.zeros(len(own), REPEAT)
    w["doc"], w["sub"], w["start"], w["n"] = head["doc"][own], head["sub"][own], start[own] + step, 1
    # the suffix array's order, and for equal suffixes that of the corpus
    order = np.lexsort((w["start"], w["sub"], w["doc"], rank))
    w, rank = w[order], rank[order]
    once = np.concatenate([[True], w[1:] != w[:-1]])  # rows that repeat as a whole
    w, rank = w[once], rank[once]
    first = w[np.maximum.accumulate(np.where(np.concatenate([[True], rank[1:] != rank[:-1]]), np.arange(len(w)), 0))]
    return joined_runs(w[w != first])


RUNS = "doc long, sub long, at binary"


def _by_document(r: np.ndarray) -> pa.RecordBatch:
    """(doc, sub, at): begins of repeated windows, as packed runs (start, n)."""
    r = r[np.lexsort((r["start"], r["sub"], r["doc"]))]
    edge = np.flatnonzero(np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["sub"][1:] != r["sub"][:-1]), [True]])) if len(r) else np.zeros(1, np.int64)
    runs = np.stack([r["start"], r["n"]], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(r["doc"][edge[:-1]]), pa.array(r["sub"][edge[:-1]]), pa.array([runs[a:z].astype("<u4").tobytes() for a, z in zip(edge[:-1], edge[1:])], pa.binary())], names=["doc", "sub", "at"])


def _by_window(fetched: DataFrame) -> DataFrame:
    """Repeats among the windows of ambiguous phrases."""

    def run(table: pa.Table) -> pa.Table:
        heads, cut = [np.zeros(0, CONTEXT)], []
        for blob in table.column("blob").to_pylist():
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            head = np.frombuffer(blob, CONTEXT, n, 8)
            ends = 8 + CONTEXT.itemsize * n + np.cumsum(fields(head["loc"])[1] + WIDTH - 1)
            cut += [blob[a:z] for a, z in zip([8 + CONTEXT.itemsize * n, *ends[:-1].tolist()], ends.tolist())]
            heads.append(head)
        head = np.concatenate(heads)
        order = np.argsort(head["key"], kind="stable")
        head = head[order]
        ends = np.cumsum(fields(head["loc"])[1] + WIDTH - 1)
        # some keys at a time, each as a whole
        edge = np.flatnonzero(np.concatenate([head["key"][1:] != head["key"][:-1], [True]])) + 1 if len(head) else np.zeros(0, np.int64)
        again, a = [np.zeros(0, REPEAT)], 0
        for z in edge.tolist():
            if z == len(head) or ends[z - 1] - (ends[a - 1] if a else 0) >= SORTED:
                again.append(later_windows(head[a:z], b"".join([cut[k] for k in order[a:z].tolist()])))
                a = z
        return pa.Table.from_batches([_by_document(joined_runs(np.concatenate(again)))])

    return fetched.groupBy("bucket").applyInArrow(run, RUNS)


def _repeats(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _by_document(np.frombuffer(b"".join(b.column(0).to_pylist()), REPEAT))

    return packed.where(F.col("kind") == REPEATS).select("blob").mapInArrow(run, RUNS)


def spans(runs: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated windows cover."""
    r = np.frombuffer(b"".join(runs), "<u4").astype(np.int64).reshape(-1, 2)
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 0] + r[:, 1] + WIDTH - 1, -1)
    cover = np.concatenate([[False], np.cumsum(edge)[:length] > 0, [False]])
    turn = np.flatnonzero(cover[1:] != cover[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, runs): every row with its repeated windows, as packed runs (begin, number) for ``spans``.

    A byte goes if it lies in a string of WIDTH bytes that also begins earlier: in a smaller
    doc_id, or further left in the same document. Null and empty texts, and
    those under WIDTH bytes, lose nothing. A null doc_id comes before all
    others. Rows with one doc_id and different texts are different documents,
    in the order of a hash of the text; rows that repeat as a whole are the
    same document, so neither makes the other a repeat. An empty table gives
    an empty result; other columns are ignored.
    """
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    sub = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = d.select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc"), sub.alias("sub"), "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, size // (31 * IN_BUCKET) + 1)
    found = Staged(_by_key(_parsed(keyed, n_buckets), n_buckets))
    fetched = _fetched(keyed, _unpacked(found.read(), (PHRASES, WIDE_ONES)), n_buckets)
    again = _repeats(found.read()).unionByName(_by_window(fetched))
    again = again.groupBy("doc", "sub").agg(F.collect_list("at").alias("runs"))
    both = d.withColumn("doc", F.coalesce("doc_id", F.lit(FIRST_ID))).withColumn("sub", sub).join(again, ["doc", "sub"], "left").select("doc_id", "text", "runs")
    return both


def removal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row; see ``without_repeats``.

    removed: an array of (begin, end) in bytes; kept: what is left, as binary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, kept, sizes = [], [], []
            for text, runs in zip(texts(b.column(1)), b.column(2).to_pylist()):
                cut = spans(runs, len(text)) if runs else []
                at, left = 0, []
                for a, z in cut:
                    left.append(text[at:a])
                    at = z
                cuts.append([{"begin": a, "end": z} for a, z in cut])
                kept.append(b"".join([*left, text[at:]]))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return without_repeats(docs).mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    r = removal(docs)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return r.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """The digest by a plain table of strings, for tests."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - WIDTH + 1):
            if (w := text[i : i + WIDTH]) in seen:
                gone[i : i + WIDTH] = True
            seen.add(w)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        edges = np.concatenate([[False], gone, [False]])
        out[doc] = len(text), int(gone.sum()), int((edges[1:] & ~edges[:-1]).sum()), hashlib.sha256(kept).hexdigest()
    return out
