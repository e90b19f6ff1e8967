"""Token ids in a compact binary form, by static range asymmetric numeral systems.

All blocks of a corpus share one table of frequencies, scaled to a power of
two. A block holds the ids of whole documents and stands alone: it begins with
its documents' ids and lengths, and its ids are dealt in turn to ``LANES``
interleaved encoders, whose states and words are vectors. Every ``CHECK``
steps the block keeps the lanes' states and the place in the words, so that a
reader may start there; a checksum covers the ids between two such places.
Blocks are rows of a Parquet table (``block``, binary) in the order of
(part, seq), so Spark's own commit makes a rerun after a lost executor safe.

Layout of a block, little endian: the magic "MRN1"; the numbers of documents,
ids, words and checkpoints as uint32; for each document its id (int64), a null
flag (uint8) and its length (uint32); for each checkpoint the place in the
words (uint32), the CRC-32 of the ids that follow up to the next (uint32) and
the lanes' states (uint64); the words (uint32).
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, durable, input_bytes, pick, shared_folder, texts
from .token_count import byte_letters

MAGIC = b"MRN1"
LANES, CHECK = 1024, 128  # a checkpoint every 131,072 ids
SCALE = 20  # frequencies sum to 2**SCALE
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
BLOCK_IDS = 524_288
#: Input of one part, about, and the most parts: their bounds are literals in the plan.
PART_BYTES, MOST_PARTS = 256 << 20, 20_000
#: Words in a generation of an encoder's table; two take about 0.1 GB for each half million.
KEEP = 400_000


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum to 2**scale; whatever occurs keeps at least 1.

    counts: by id. More distinct ids than 2**scale can't be coded.
    """
    used, total = np.flatnonzero(counts), int(counts.sum())
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    if len(used) > 1 << scale:
        raise ValueError("more distinct ids than the table has room for")
    room = (1 << scale) - len(used)
    exact = counts[used].astype(np.float64) / total * room
    whole = np.floor(exact).astype(np.int64)
    rest = np.argsort(-(exact - whole), kind="stable")[: room - int(whole.sum())]
    whole[rest] += 1
    out[used] = whole + 1
    return out


class Coder:
    """Encoder and decoder with one shared table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = np.uint64(scale), freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)  # the id at each place of the table
        self.mask = np.uint64((1 << scale) - 1)

    def encode(self, ids: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
        """Checkpoints (place, checksum, states) in reading order, and the words.

        Coding runs backwards over rows of LANES ids; the reader goes forwards.
        """
        n = len(ids)
        rows = -(-n // LANES)
        state = np.full(LANES, LOW, np.uint64)
        out: list[np.ndarray] = []  # in order of writing, to be turned round
        marks: list[tuple[int, np.ndarray, int]] = []
        written = 0
        for r in range(rows - 1, -1, -1):
            x = ids[r * LANES : (r + 1) * LANES]
            k = len(x)
            f, s = self.freq[x], state[:k]
            full = s >= (f << (np.uint64(63) - self.scale))
            if full.any():
                out.append((s[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
                written += int(full.sum())
                s = np.where(full, s >> np.uint64(32), s)
            q = s // f
            state[:k] = (q << self.scale) + (s - q * f) + self.cum[x]
            if r % CHECK == 0:
                marks.append((written, state.copy(), r))
        words = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
        checks = []
        for w, s, r in reversed(marks):
            part = np.ascontiguousarray(ids[r * LANES : (r + CHECK) * LANES], dtype="<u4")
            checks.append((written - w, zlib.crc32(part.tobytes()), s))
        return checks, words

    def decode(self, count: int, checks: list[tuple[int, int, np.ndarray]], words: np.ndarray) -> np.ndarray:
        """The ids; ValueError if a checksum differs. Parts are independent."""
        out = np.empty(count, np.uint32)
        for c, check in enumerate(checks):
            first = c * CHECK * LANES
            self.decode_from(out[first : first + CHECK * LANES], check, words)
        return out

    def decode_from(self, out: np.ndarray, check: tuple[int, int, np.ndarray], words: np.ndarray) -> None:
        """Fill ``out`` with the ids from one checkpoint on."""
        at, crc, state = check[0], check[1], check[2].copy()
        for r in range(0, len(out), LANES):
            k = min(LANES, len(out) - r)
            s = state[:k]
            low = s & self.mask
            x = self.slot[low]
            out[r : r + k] = x
            s = self.freq[x] * (s >> self.scale) + low - self.cum[x]
            need = s < LOW
            if m := int(need.sum()):
                s[need] = (s[need] << np.uint64(32)) | words[at : at + m]
                at += m
            state[:k] = s
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of ids differs")


def pack(coder: Coder, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block of whole documents."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    checks, words = coder.encode(ids)
    head = [MAGIC, struct.pack("<4I", len(docs), len(ids), len(words), len(checks))]
    head += [struct.pack("<qBI", i or 0, i is None, len(x)) for i, x in docs]
    head += [struct.pack("<2I", at, crc) + s.astype("<u8").tobytes() for at, crc, s in checks]
    return b"".join([*head, words.astype("<u4").tobytes()])


def unpack(coder: Coder, block: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    n_docs, n_ids, n_words, n_checks = struct.unpack_from("<4I", block, 4)
    at = 20
    docs = [struct.unpack_from("<qBI", block, at + 13 * k) for k in range(n_docs)]
    at += 13 * n_docs
    checks = []
    for _ in range(n_checks):
        place, crc = struct.unpack_from("<2I", block, at)
        checks.append((place, crc, np.frombuffer(block, "<u8", LANES, at + 8).astype(np.uint64)))
        at += 8 + 8 * LANES
    ids = coder.decode(n_ids, checks, np.frombuffer(block, "<u4", n_words, at))
    first = 0
    for i, null, n in docs:
        yield None if null else i, ids[first : first + n]
        first += n


class Encoder(dict):
    """A tokenizer of the tokenizers library, with a memory of words.

    For tokenizers that lower-case, turn white space into blanks and drop
    those when they split: a text's ids are those of its parts between ASCII
    white space, in turn. Letters and the punctuation after them are pieces of
    their own, and a piece of lower-case Latin letters goes to the library's
    model as it stands; other parts pass through the whole tokenizer. The
    dictionary holds the ids of parts met lately, in two generations of
    bounded size: when the young one is full it becomes the old one.
    """

    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, end: int | None, keep: int = KEEP):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.keep, self.old = Tokenizer.from_file(path), keep, {}
        self.model, self.spelling = self.tokenizer.model, dict(enumerate(byte_letters()))
        most = max(self.tokenizer.get_vocab_size(), 1 + (end or 0))
        self.width, self.code = (2, "H") if most <= 1 << 16 else (4, "I")
        self.tail = b"" if end is None else self._packed([end])
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._new(part)
        self[part] = ids
        return ids

    def _new(self, part: bytes) -> bytes:
        if part.isalpha():  # ASCII
            return self._packed([t.id for t in self.model.tokenize(part.decode())])
        if part[-1] in b".," and part[:-1].isalpha():
            return self[part[:-1]] + self[part[-1:]]
        text = part.decode("utf-8", "replace")
        plain = self.PLAIN.fullmatch(text)
        if plain and plain[2]:
            return self[plain[1].encode()] + self[plain[2].encode()]
        if plain:
            return self._packed([t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.spelling))])
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __call__(self, text: bytes) -> bytes:
        """A text's ids, little endian, in ``width`` bytes each."""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        low = text.lower()
        if any(s in low for s in self.special):
            parts = [p if any(s in x for s in self.special) else x for p, x in zip(text.split(), low.split())]
        else:
            parts = low.split()
        return b"".join(map(self.__getitem__, parts)) + self.tail


@lru_cache(maxsize=4)
def encoder(path: str, end: int | None, keep: int) -> Encoder:
    """One for each vocabulary and worker; the words it knows serve later tasks."""
    return Encoder(path, end, keep)


def _parts(d: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where a part would exceed PART_BYTES."""
    return max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-input_bytes(d) // PART_BYTES), MOST_PARTS))


def _part(d: DataFrame, n: int) -> tuple[Column, int]:
    """Which range of (doc_id, hash of the text) a row lies in, nulls first, and the number of ranges: about n.

    The bounds are quantiles of the ids alone, so texts are read once only. An
    id that fills several quantiles, or null, has ranges of its own by the
    text's hash. The bounds are looked up in two steps: among every m-th, then
    among m.
    """
    if n <= 1:
        return F.lit(0), 1
    rows, nulls = d.agg(F.count("*"), F.count("*") - F.count("doc_id")).first()
    quantiles = Counter(d.select("doc_id").stat.approxQuantile("doc_id", [k / n for k in range(1, n)], min(0.01, 0.1 / n)))
    bounds = sorted(quantiles)
    by_hash = lambda k: F.least(F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * k).cast("int"), k - 1)
    null_parts = n * nulls // rows if rows else 0
    first = F.lit(0) if null_parts < 2 else by_hash(F.lit(null_parts))
    before = 0 if null_parts < 2 else null_parts
    if not bounds:
        return F.coalesce(F.when(F.col("doc_id").isNotNull(), F.lit(before)), first), before + 1
    m = max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[a : a + m] for a in range(0, len(bounds), m)]
    number = F.col("doc_id").cast("double")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < number))
    chunk = F.greatest(below(F.lit([c[0] for c in chunks])) - 1, F.lit(0))
    at = chunk * m + below(F.get(F.lit(chunks), chunk))
    # beyond 2**53 a double may stand for several ids
    hot = {i: quantiles[b] for i, b in enumerate(bounds) if quantiles[b] > 1 and abs(b) < 1 << 53}
    part = at + before
    if hot:
        # the ids of a range but for the hot one at its end, then that one's parts
        shift = np.concatenate([[0], np.cumsum([hot.get(i, 0) for i in range(len(bounds))])]).tolist()
        own = F.element_at(F.create_map(*[x for i, k in hot.items() for x in (F.lit(int(bounds[i])).cast("long"), F.lit(k))]), F.col("doc_id"))
        part = part + F.get(F.lit(shift), at) + F.coalesce(1 + by_hash(own), F.lit(0))
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), part), first).cast("int"), before + len(bounds) + 1 + sum(hot.values())


def tokenized(docs: DataFrame, path: str, end: int | None, partitions: int | None = None, keep: int = KEEP) -> DataFrame:
    """(part, seq, doc_id, n, ids, counts): in ascending doc_id order over parts and within each.

    ids are little-endian, in n equal parts of two or four bytes (``ids_of``). Null ids come first; rows that tie on
    doc_id are ordered by a hash of their text. Each part ends with a row without
    document, which has how often each id occurs in the part (``counts``,
    uint64; null in all other rows).
    """
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    n = partitions or _parts(d)
    part, n = _part(d, n)
    d = d.repartitionById(n, part).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def rows(part, seq, doc_id, n, ids, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int64()), doc_id, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["part", "seq", "doc_id", "n", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encode = TaskContext.get().partitionId(), 0, encoder(path, end, keep)
        total = np.zeros(0, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                ids = [encode(t) for t in texts(some.column(1))]
                k = len(ids)
                total = added(total, np.bincount(np.frombuffer(b"".join(ids), f"<u{encode.width}")))
                yield rows([part] * k, range(seq, seq + k), some.column(0), [len(x) // encode.width for x in ids], ids, [None] * k)
                seq += k
        if seq:
            yield rows([part], [seq], pa.array([None], pa.int64()), [0], [b""], [total.astype("<u8").tobytes()])

    return d.mapInArrow(run, "part int, seq long, doc_id long, n long, ids binary, counts binary")


def ids_of(packed: bytes, n: int) -> np.ndarray:
    """n ids as uint32."""
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype(np.uint32)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts by id, of two lengths maybe."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] = a
    out[: len(b)] += b
    return out


def _counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one number for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total = added(total, np.frombuffer(x, "<u8").astype(np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    got = tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def write_corpus(docs: DataFrame, folder: str, path: str, end: int | None = None, block_ids: int = BLOCK_IDS, keep: int = KEEP) -> np.ndarray:
    """Encode every document, in ascending doc_id order, to blocks in ``folder``; returns the table of frequencies.

    Null and empty texts have no ids but the end. A text longer than a block
    makes a block of its own.
    """
    staged = Staged(tokenized(docs, path, end, keep=keep))
    freq = frequencies(_counts(staged.read()))
    shared = docs.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, waiting, size, key, start = Coder(shared.value), [], 0, None, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(coder, waiting)], pa.binary())], names=["part", "seq", "n", "block"])

        for b in batches:
            for part, seq, i, n, x in zip(*(b.column(k).to_pylist() for k in range(5))):
                if waiting and (part != key[0] or size + n > block_ids):
                    yield block()
                    waiting, size = [], 0
                if not waiting:
                    key = part, seq
                waiting.append((i, ids_of(x, n)))
                size += n
        if waiting:
            yield block()

    # each staged file is one part in order; a split of it is a run of rows, so blocks keep the order
    blocks = staged.read().where("counts is null").select("part", "seq", "doc_id", "n", "ids").mapInArrow(run, "part int, seq long, n long, block binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    staged.drop()
    spark = docs.sparkSession
    table = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(table or [], "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    return freq


def read_table(spark, folder: str) -> np.ndarray:
    rows = spark.read.schema("id long, freq long").parquet(f"{folder}/table").toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    return out


def read_corpus(spark, folder: str) -> DataFrame:
    """(part, seq, place, doc_id, n_tokens, ids_crc32, start): every document, decoded from the blocks.

    start counts the ids of all documents before it: those of earlier blocks,
    from the blocks' own counts, and of earlier documents in the block.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, folder))
    blocks = spark.read.schema("part int, seq long, n long, block binary").parquet(f"{folder}/blocks")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = durable(blocks.select("part", "seq", "n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    firsts = sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within")).join(parts, "part")
    firsts = firsts.select("part", "seq", (F.col("base") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            for part, seq, block in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows, at = [], 0
                for k, (i, x) in enumerate(unpack(coder, block)):
                    rows.append((part, seq, k, i, at, len(x), zlib.crc32(x.astype("<u4").tobytes())))
                    at += len(x)
                kinds = [pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "seq", "place", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = blocks.select("part", "seq", "block").mapInArrow(run, "part int, seq long, place long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(firsts, ["part", "seq"]).select("part", "seq", "place", "doc_id", "n_tokens", "ids_crc32", (F.col("first") + F.col("at")).alias("start"))


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def encoded(docs: DataFrame, path: str, end: int | None = None, folder: str | None = None, keep: int = KEEP) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files.

    Repeated rows and null ids are documents like any other. An empty table
    makes empty files and an empty result.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    write_corpus(docs, folder, path, end, keep=keep)
    return read_corpus(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
