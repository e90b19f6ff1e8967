"""The pipeline's near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from moraine.llm import simhash, similar

DOCS = "doc_id long, text string, source string"


def brute(texts):
    sets = [similar.shingles((t or "").encode()) for t in texts]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if not sets[a] and not sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def near_copies(seed, n=240):
    """Copies with words changed, many of them just above or below 0.8, and a passage that most have."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(r.choice(words) for _ in range(30)).split()
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 6, 9, 40, 120, 300]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3, len(w) // 45])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w + (common if r.random() < 0.7 else [])))
    return out + [None, "", " \n", out[0].upper(), out[1].replace(" ", "\n")]


@pytest.mark.parametrize("often", [(16, 8), (1, 3)])
def test_no_similar_pair_is_lost(spark, monkeypatch, often):
    monkeypatch.setattr(similar, "SAMPLE", often[0])
    monkeypatch.setattr(similar, "SEEN", often[1])
    if often[0] == 1:  # nothing is broadcast
        monkeypatch.setattr(similar, "FEW_TEXTS", 0)
    texts = near_copies(often[0])
    group = brute(texts)
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOCS).selectExpr("*", "'junk' AS `set`", "1 AS root")
    got = {}
    for row in similar.groups(df).collect():
        got.setdefault(row.root, set()).add(row.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(k for k, g in enumerate(group) if g == x) for x in set(group))
    kept = corpus_pipeline.deduplicate(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(k for k, g in enumerate(group) if g == x) for x in set(group))
    assert kept.columns == df.columns
    assert corpus_pipeline.deduplicate(spark, df.where("false"), "").count() == 0


def test_rows_without_id_or_with_one_id_stay_by_text(spark):
    r = random.Random(9)
    prose = [" ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(40)) for _ in range(8)]
    rows = [(None, prose[0], "s"), (None, prose[1], "s"), (None, prose[2], "s"), (None, prose[2].upper(), "s")]
    rows += [(7, prose[3], "s"), (7, prose[4], "s"), (7, prose[4], "s"), (5, prose[5], "s"), (None, prose[5], "s"), (8, prose[5] + " end", "s"), (5, prose[6], "s"), (6, prose[6], "s"), (6, prose[7], "s")]
    kept = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, DOCS), "").collect()
    got = sorted((str(k.doc_id), prose.index(k.text.lower())) for k in kept)
    assert got == [("5", 5), ("5", 6), ("6", 7), ("7", 3), ("7", 4), ("None", 0), ("None", 1), ("None", 2)]


def check(spark, texts):
    group = brute(texts)
    got = {}
    for row in similar.groups(spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOCS)).collect():
        got.setdefault(row.root, set()).add(row.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(k for k, g in enumerate(group) if g == x) for x in set(group))


def hot_group(seed=5, n=260):
    """Copies of one text, some of them too far from it, of which some are alike."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    out, far = [" ".join(base)], []
    for k in range(n):
        w = list(r.choice(far)) if far and k % 4 == 1 else list(base)
        for _ in range(1 if k % 4 == 1 else r.choice([1, 2, 4, 7])):
            w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
        far += [w] * (k % 4 == 0)
        out.append(" ".join(w))
    return out


def test_shingles_of_many_sets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar, "MANY", 2)
    monkeypatch.setattr(similar, "ROUNDS", 2)
    check(spark, near_copies(4, 150))
    check(spark, hot_group(n=120))


def test_pairs_of_a_large_group_are_not_all_met(spark, monkeypatch):
    monkeypatch.setattr(similar, "MANY", 30)
    made, pairs = [], similar._pairs
    monkeypatch.setattr(similar, "_pairs", lambda members, t: (made.append(sum(r[1] ** 2 for r in members.groupBy("key").count().collect())), pairs(members, t))[1])
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(hot_group())], DOCS)
    for rounds in (2, 0):
        monkeypatch.setattr(similar, "ROUNDS", rounds)
        similar.groups(df)
    assert 2 * made[0] < made[1]


def test_simhash_comes_first(spark, monkeypatch):
    texts = hot_group(n=60)
    seen, compared = [], similar._compared
    monkeypatch.setattr(similar, "_compared", lambda pairs, *a, **b: (seen.append(pairs.collect()), compared(pairs, *a, **b))[1])
    check(spark, texts)
    sets = {xxhash.xxh64_intdigest(np.unique(h).tobytes(), 3): simhash.fingerprint_of(h) for h in (simhash.digests(t.encode(), 5) for t in texts)}
    near = {frozenset((a, b)) for a in sets for b in sets if a < b and (sets[a] ^ sets[b]).bit_count() <= 2}
    first = {frozenset((a % 2**64, b % 2**64)) for a, b in seen[0]}
    assert first and first <= near and len(first) <= len(sets)
    assert not first & {frozenset((a % 2**64, b % 2**64)) for a, b in seen[-1]}
