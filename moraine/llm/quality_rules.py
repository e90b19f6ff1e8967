"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of common words
are each held against the nearest language's reference by Jensen-Shannon
distance (base 2, from 0 to 1). A reference is the median share of each bin over all
documents of that language that pass the base rules and are long enough; a
median stays put while junk is in the minority. What a short text shows by
chance is allowed for: a limit falls with the square root of the length, and
below a minimum length the test isn't made.

A text is held against what it can be expected to be like. Of a language whose
common words aren't listed there is no test of words; of one that has no
reference at all, or is unknown, letters of every kind count as one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pick, texts

#: Common words of each language; fixed values.
COMMON = {
    "en": "the of and to in is that with by for on are it was be as from this at an have not or which you a",
    "fr": "de la le les et des un une en que qui du pour par dans est au sur plus pas elle ou ne se ce avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: Lower and upper case ASCII letters, other letters, digits, stops, further punctuation, symbols, the rest.
CLASSES = 8
REPEAT = 8  # words in a window
#: Documents of a language from which a reference is made, if its common words aren't listed.
ENOUGH = 50


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 3
    t[0x80:0xC0], t[0xC0:] = 8, 2  # a character beyond ASCII counts at its first byte
    for k, chars in ((4, b".,"), (5, b";:!?'\"()-"), (6, SYMBOLS), (8, SPACE)):
        t[list(chars)] = k
    return t


TABLE = _class_table()


def repeat_words(words: list[bytes], width: int = REPEAT) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more.

    Windows are told apart exactly: each doubling step numbers the distinct
    pairs of the step before. ``width`` is a power of two.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    now = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    step = 1
    while step < width:
        _, now = np.unique(now[:-step] * np.int64(len(now) + 1) + now[step:], return_inverse=True)
        step *= 2
    twice = np.bincount(now)[now] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(twice)] += twice
    edge[width : width + len(twice)] -= twice
    return int((np.cumsum(edge) > 0).sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    points = len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(words), points - sum(map(text.count, (bytes([c]) for c in SPACE))), sum(map(text.count, (bytes([c]) for c in SYMBOLS))), len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def char_histogram(text: bytes) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES].astype(float)


class WordHistogram:
    """Counts of a language's common words, and of all others at the end."""

    def __init__(self, lang: str):
        self.at = {w.encode(): i for i, w in enumerate(COMMON[lang].split())}

    def __call__(self, words: list[bytes], total: int) -> np.ndarray:
        """words: all of a text's, or at least the common ones; total: how many the text has."""
        at, out = self.at, np.zeros(len(self.at) + 1)
        hits = [at[w] for w in words if w in at]
        out[:-1] = np.bincount(hits, minlength=len(at)) if hits else 0
        out[-1] = total - len(hits)
        return out


def lowered(text: bytes) -> list[bytes]:
    """Words in lower case without punctuation."""
    low = text.decode("utf-8", "replace").lower().encode()
    return low.translate(None, b".,;:!?'\"()").split()


def folded(chars: np.ndarray) -> np.ndarray:
    """A histogram of classes with all letters as one."""
    return np.concatenate([[chars[:3].sum()], chars[3:]])


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    bits = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (bits(p) + bits(q)) / 2) ** 0.5


def references(docs: DataFrame, min_words: int = 100) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """The reference histograms of each tagged language, from all of its documents; of words only for those in COMMON.

    Two histograms of under 30 bins for each language come to the driver,
    whatever the size of the table.
    """
    width = CLASSES + 1 + max(len(w.split()) for w in COMMON.values())

    def batch(b: pa.RecordBatch) -> dict:
        count = {k: WordHistogram(k) for k in COMMON}
        langs, shares = [], []
        for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            if lang is None or len(words := text.split()) < min_words or base_failed(len(words), repeat_words(words)):
                continue
            chars, both = char_histogram(text), np.zeros(width)
            both[:CLASSES] = chars / max(1, chars.sum())
            if lang in COMMON:
                low = lowered(text)
                common = count[lang](low, len(low))
                both[CLASSES : CLASSES + len(common)] = common / max(1, common.sum())
            langs.append(lang)
            shares.append(both.tolist())
        return {"lang": langs, "shares": pa.array(shares, pa.list_(pa.float64()))}

    each = map_batches(pick(docs, "lang", "text"), batch, "lang string, shares array<double>")
    medians = each.groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("shares")[i], 0.5, 1000).alias(f"m{i}") for i in range(width)])
    out = {}
    for r in medians.where((F.col("n") >= ENOUGH) | F.col("lang").isin(*COMMON)).collect():
        m = np.array(r[2:], float)
        out[r[0]] = m[:CLASSES], m[CLASSES : CLASSES + len(COMMON[r[0]].split()) + 1] if r[0] in COMMON else None
    return out


class Judge:
    """The verdict of the method. Limits are on the distance, by length."""

    def __init__(self, refs: dict, char_limit: float = 0.12, char_slope: float = 4.0, word_limit: float = 0.10, word_slope: float = 2.1, min_chars: int = 200, min_words: int = 50):
        self.refs, self.count = refs, {k: WordHistogram(k) for k, r in refs.items() if r[1] is not None}
        self.known = {w for c in self.count.values() for w in c.at}
        self.char_limit, self.char_slope, self.word_limit, self.word_slope = char_limit, char_slope, word_limit, word_slope
        self.min_chars, self.min_words = min_chars, min_words

    def distances(self, text: bytes, lang: str | None) -> tuple[float | None, float | None]:
        """To the nearest reference of any language, for texts may be tagged wrongly.

        None where the text is too short for the test, or there is no reference.
        """
        chars, c, w = char_histogram(text), None, None
        if chars.sum() >= self.min_chars:
            alike = (lambda x: x) if lang in self.refs else folded
            c = min((distance(alike(chars), alike(r[0])) for r in self.refs.values()), default=None)
        if lang in self.count:
            words = lowered(text)
            common = [x for x in words if x in self.known]
            if len(words) >= self.min_words:
                w = min(distance(count(common, len(words)), self.refs[k][1]) for k, count in self.count.items())
        return c, w

    def keeps(self, text: bytes, c: float | None, w: float | None) -> bool:
        n_chars, n_words = len(text), max(1, len(text.split()))
        return not (c is not None and c > self.char_limit + self.char_slope / max(1, n_chars) ** 0.5 or w is not None and w > self.word_limit + self.word_slope / n_words**0.5)


def judged(docs: DataFrame, **limits) -> DataFrame:
    """One row a document: the base counts, base_failed, both distances, kept.

    Null and empty texts have no words, fail the base rules and aren't kept. A
    text whose ``lang`` is null, or has no reference, is in no reference, and is
    judged by its characters, with letters of every kind as one class. With no
    reference at all (an empty table) the base rules decide alone. Repeated rows
    each have their own row; other columns are ignored.
    """
    refs = references(docs)

    def batch(b: pa.RecordBatch) -> dict:
        judge, out = Judge(refs, **limits), {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")}
        for text, lang in zip(texts(b.column(1)), b.column(2).to_pylist()):
            row = base(text)
            failed = base_failed(row[0], row[4])
            c, w = judge.distances(text, lang)
            for k, v in zip(out, (*row, failed, c, w, not failed and judge.keeps(text, c, w))):
                out[k].append(v)
        return out | {"doc_id": b.column(0)}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    d = pick(docs, "doc_id", "text", "lang")
    return map_batches(d.select(F.col("doc_id").cast("long"), "text", "lang"), batch, schema)


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; see ``judged``.

    Rows with a null or empty text go; ids don't matter and repeated rows each
    stay or go. An empty table stays empty. Columns of any other name pass
    through; without a column ``lang`` no language is known.
    """
    refs = references(docs)
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        judge = Judge(refs, **limits)
        for b in batches:
            keep = []
            for t, tag in zip(texts(b.column(text)), b.column(lang).to_pylist() if lang is not None else [None] * b.num_rows):
                words = t.split()
                ok = not base_failed(len(words), repeat_words(words))
                keep.append(ok and judge.keeps(t, *judge.distances(t, tag)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
