"""A quality classifier by Bradley-Terry ranking.

A document's worth is linear in its features. Of a pair with different labels
the better one should win: the logistic loss on feature differences is
minimised by Newton's method. The threshold is the quantile of the scores that
leaves as many documents above it as have label 1, and the score is a logistic
curve around it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, texts
from .quality_rules import COMMON, SPACE, char_histogram, lowered, repeat_words

KNOWN = {w.encode() for v in COMMON.values() for w in v.split()}
#: Labelled documents that the model is fitted on, at most: those with the least hash of their id.
SAMPLE = 20_000


def features(text: bytes) -> np.ndarray:
    """Shape of a text: lengths, character classes, repetition, common words."""
    words = text.split()
    n = max(1, len(words))
    chars = char_histogram(text)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    low = lowered(text)
    times = Counter(words)
    most = max(times.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    marked = sum(w[-1:] in b"#*$%&!|" for w in words)
    upper = sum(w.isupper() for w in words)
    return np.array(
        [
            np.log1p(len(words)), np.log1p(len(text)), sum(map(len, words)) / n, *(chars / max(1, chars.sum())),
            len(times) / n, most / n, same / n, repeat_words(words) / n, marked / n, upper / n,
            words.count(b"|") / n, np.log1p(len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)),
            sum(w in KNOWN for w in low) / max(1, len(low)), len(set(low)) / max(1, len(low)), float(not words),
        ]
    )


class Ranker:
    """Weights of the standardised features and their squares, with the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 200_000, ridge: float = 3.0, seed: int = 7):
        self.mean, self.std = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self.expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weights = np.zeros(z.shape[1])
        self.cut = 0.0
        self.scale = 1.0
        if not len(good) or not len(bad):
            self.cut = -1.0 if len(good) else 1.0 if len(bad) else 0.0
            return
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ self.weights, -30, 30)))
            slope = d.T @ (1 - p) - ridge * self.weights
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(d.shape[1]), slope)
            self.weights += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-4:
                break
        s = z @ self.weights
        # midway between the scores on both sides of the quantile
        order = np.sort(s)
        self.cut = float(order[max(0, len(bad) - 1)] + order[min(len(s) - 1, len(bad))]) / 2
        self.scale = float(np.std(s)) or 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -5, 5)
        return np.hstack([z, z * z])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = self.expand(x) @ self.weights if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(4 * (s - self.cut) / self.scale, -30, 30)))


def held_out(doc_id):
    """Rows whose id, as text, has a CRC-32 that leaves 1 when divided by 3; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measured(d: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tolist() for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "h", "x"])

    return d.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Learn from at most ``sample`` labelled documents that aren't held out.

    Labels that are null or neither 0 nor 1 say nothing; of several for one id
    the greatest counts, and of several texts that of least hash, so reruns agree.
    """
    known = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    met = d.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # at most ``sample`` ids
    rows = _measured(met).groupBy("doc_id").agg(F.min_by("x", "h").alias("x")).join(known, "doc_id").orderBy("doc_id").collect()
    width = len(features(b""))
    return Ranker(np.array([r["x"] for r in rows]).reshape(-1, width), np.array([r["quality"] for r in rows], int))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null texts count as empty; those have a score like any other. Without
    labels of both kinds every score is on the side of the label there is, or
    0.5 without any. Repeated rows each have a row; other columns are ignored.
    """
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model(x))], names=["doc_id", "held_out", "score"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    out = d.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
