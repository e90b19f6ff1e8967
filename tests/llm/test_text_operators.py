"""Operators on texts against plain versions: mixing, decontamination, quality, SimHash, counts, output, repeats."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import decontaminate, mixing, quality_rank, quality_rules, simhash, substring_dedup, token_codec, token_count
from moraine.llm.components import components
from moraine.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, lang string"
ODD = [(1, None, "a", "en"), (2, "", None, None), (None, "x y z", "b", "xx"), (3, " \t\n", "a", "en"), (3, " \t\n", "a", "en"), (4, "word " * 30000, "b", "en"), (5, "é\x0bö\x1c\xa0ü", "", "de")]


def frame(spark, rows, extra=True):
    """Documents, with columns whose names an operator might want for itself."""
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("size", "fp", "bucket", "start", "n", "host", "kept", "DOC_id2", "_c0", "id"):
            df = df.selectExpr("*", f"'junk' AS `{name}`")
    return df


def some_docs(n=60, seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice("the of and to in a cat dog sat ran far red".split()) for _ in range(r.randint(1, 90))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = r.choice(base).split(" ")
        if r.random() < 0.5:
            t[r.randrange(len(t))] = r.choice(["new", "The", "x\ny"])
        out.append((i, r.choice([" ", "\n"]).join(t), r.choice(["a", "b", "c", None]), r.choice(["en", "fr", None])))
    return out


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing ---


def water(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        shares = sum(w[s] for s in open_)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / shares for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    rows = some_docs(200, 4) + ODD
    got = mixing.taken(frame(spark, rows)).collect()
    again = mixing.taken(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    want = water(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(split(t))) for i, t, _, _ in rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 80 + 0.02 * want[s]


def test_mix_pieces_fill_blocks(spark):
    placed, pieces = mixing.mix(frame(spark, some_docs(80, 9)), block=16)
    per_slot = {}
    for p in pieces.collect():
        assert 0 <= p["first"] < p["last"] <= p["size"]
        per_slot[p.slot] = per_slot.get(p.slot, 0) + p["last"] - p["first"]
    assert max(per_slot.values()) == 16 and sum(v < 16 for v in per_slot.values()) <= 4
    assert mixing.mixed_documents(frame(spark, some_docs(80, 9))).columns[:4] == ["doc_id", "text", "source", "lang"]


# --- decontamination ---


def plain_pairs(docs, items, t=0.8):
    out = []
    for i, text, *_ in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for j, x in items:
            s = decontaminate.shingles(re.findall(r"\w+", (x or "").lower()))
            if s:
                n = len(next(iter(s)))
                k = len(s & set(zip(*(w[a:] for a in range(n)))))
                if k >= t * len(s) - 1e-9:
                    out.append((i, j, len(s), k))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10**9, 0])
def test_decontamination(spark, most):
    r = random.Random(3)
    items = [(k, " ".join(f"w{r.randrange(500)}" for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 17, 40, 40, 41])] + [(90, None), (91, ""), (92, "!!"), (None, "only this one here now")]
    docs = some_docs(20) + ODD
    for k, (_, x) in enumerate(items[:10] + items[-1:]):
        w = x.split()
        if len(w) > 20:
            w[r.randrange(2)] = "changed"
        docs.append((1000 + k, "before, it was " + ", ".join(w).upper() + "! after", "a", "en"))
        docs.append((2000 + k, " ".join(w[: len(w) // 2] + ["gap"] + w[len(w) // 2 :]), "a", "en"))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    got = decontaminate.contaminated(frame(spark, docs), bench, broadcast_bytes=most).collect()
    want = plain_pairs(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got), key=str) == want
    held = {i for i, *_ in want}
    clean = decontaminate.clean_documents(frame(spark, docs), bench, broadcast_bytes=most)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, *_ in docs if i not in held)
    assert clean.columns == frame(spark, docs).columns
    none, empty = bench.where("false"), frame(spark, [])
    assert decontaminate.contaminated(empty, bench, broadcast_bytes=most).count() == decontaminate.contaminated(frame(spark, docs), none, broadcast_bytes=most).count() == 0
    assert decontaminate.clean_documents(empty, bench, broadcast_bytes=most).count() == 0
    assert decontaminate.clean_documents(frame(spark, docs), none, broadcast_bytes=most - 1).count() == len(docs)


# --- quality rules and ranking ---


def plain_base(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    marked = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_base_counts(spark):
    docs = some_docs(60, 8) + ODD[:4] + ODD[6:] + [(70, "a b " * 40 + "c\nx\nx\n\n\nx", "s", "en"), (71, "a b c d e f g h " * 2, "s", "en"), (72, "<a|b>*$%&# é" * 9, "s", "en")]
    want = sorted((str(i), *plain_base(t)) for i, t, *_ in docs)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judged(frame(spark, docs)).collect())
    assert got == want


def test_quality_verdicts(spark):
    r = random.Random(2)
    common = quality_rules.COMMON["en"].split()
    good = [(k, " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("etaoinshr") for _ in range(6)) for _ in range(200)), "a", "en") for k in range(40)]
    junk = [(100, " ".join("".join(r.choice("#$%&*") for _ in range(5)) for _ in range(200)), "a", "en"), (101, " ".join(f"zz{k}qx" for k in range(300)), "a", None)]
    got = {x.doc_id: x for x in quality_rules.judged(frame(spark, good + junk)).collect()}
    assert all(got[k].kept for k in range(40)) and not got[100].kept and not got[101].kept
    kept = quality_rules.kept_documents(frame(spark, good + junk))
    assert {x.doc_id for x in kept.collect()} == set(range(40)) and kept.columns == frame(spark, good).columns
    assert quality_rules.judged(frame(spark, [])).count() == 0 and quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_ranking(spark):
    r = random.Random(5)
    docs = [(k, " ".join(("".join(r.choice("abcdef") for _ in range(5)) + ("###" if k % 2 else "")) for _ in range(30)), "a", "en") for k in range(400)] + ODD
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(0, 400)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality_rank.scored(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    for x in got:
        if x.doc_id is not None:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id > 10]
    assert sum(x.predicted == 1 - x.doc_id % 2 for x in held) / len(held) > 0.95
    assert quality_rank.scored(frame(spark, ODD), labels.where("false")).count() == len(ODD)


# --- SimHash ---


def plain_fingerprint(text):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = some_docs(150, 6) + ODD
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t, *_ in docs)
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in docs]
    group = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(group)
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    least = {}
    for (i, _), g in zip(fps, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(least.get(g))) for (i, _), g in zip(fps, group))
    kept = simhash.without_near_duplicates(frame(spark, docs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(least.get(g)) for g in set(group))
    # unlike texts with one id, or none, stay
    r = random.Random(12)
    unlike = [(i, " ".join(f"w{r.randrange(9999)}" for _ in range(40)), "a", "en") for i in (None, None, 7, 7, 8)]
    assert simhash.without_near_duplicates(frame(spark, unlike + unlike)).count() == 5
    assert simhash.near_duplicates(frame(spark, [])).count() == simhash.without_near_duplicates(frame(spark, [])).count() == 0


def test_close_fingerprints_always_meet(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)]
    for threshold in (0, 1, 2, 3, 4):
        near = {b ^ sum(1 << k for k in r.sample(range(64), threshold)) for b in base}
        every = sorted({*base, *near})
        df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in every], "fp long")
        got = {(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, threshold).collect()}
        want = {(a, b) for a in every for b in every if (a - (1 << 64) * (a >> 63)) < (b - (1 << 64) * (b >> 63)) and (a ^ b).bit_count() <= threshold}
        assert got == want


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    root = {}
    for _ in range(120):
        for a, b in links:
            if a is not None and a != b:
                m = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- tokens ---

PIECES = st.lists(st.sampled_from([*"aeth  \n\t'sdlr123.,;-éßñ日本́\x1c\x85🙂ΣİÉ", "   ", "'ll", "\r\n", "aaaa", "----", "<|endoftext|>", " the", "ing", "\x01", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "X"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=800, deadline=None)
@given(PIECES, st.integers(1, 50))
def test_counts_as_the_library(counter, libraries, text, chunk):
    counter.chunk = chunk
    assert counter(text) == len(libraries["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids)


@settings(max_examples=800, deadline=None)
@given(PIECES)
def test_ids_as_the_library(libraries, text):
    ids = np.frombuffer(token_codec.encoder(tokenizer_path("word_bpe_49k.json"), 2, 1000)(text.encode()), "<u2").tolist()
    assert ids == [*libraries["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids, 2]


def test_token_counts(spark, libraries):
    docs = some_docs(40) + ODD
    got = token_count.token_counts(frame(spark, docs), tokenizer_path("byte_bpe_50k.json")).collect()
    want = []
    for i, t, *_ in docs:
        n = len(libraries["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 1024))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=3000), max_size=4), st.randoms())
def test_codec_round_trip(parts, r):
    ids = [np.array(p, np.uint32) for p in parts]
    freq = token_codec.frequencies(np.bincount(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64), minlength=1))
    coder = token_codec.Coder(freq)
    block = token_codec.pack(coder, [(None if k == 1 else -k, x) for k, x in enumerate(ids)])
    back = list(token_codec.unpack(coder, block))
    assert [i for i, _ in back] == [None if k == 1 else -k for k in range(len(ids))]
    assert all(np.array_equal(a, b) for (_, a), b in zip(back, ids))


def test_codec_checkpoints_and_checksums():
    ids = np.random.default_rng(1).zipf(1.4, 400_000).clip(0, 999).astype(np.uint32)
    coder = token_codec.Coder(token_codec.frequencies(np.bincount(ids)))
    checks, words = coder.encode(ids)
    step = token_codec.LANES * token_codec.CHECK
    assert len(checks) == -(-len(ids) // step)
    out = np.empty(step, np.uint32)
    coder.decode_from(out, checks[1], words)  # from the middle, without what is before
    assert np.array_equal(out, ids[step : 2 * step])
    words = words.copy()
    words[len(words) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(len(ids), checks, words)


def order_of(doc):
    """Null ids first; rows of one id by XXH64 of the text, as a signed number (null: the seed)."""
    h = 42 if doc[1] is None else xxhash.xxh64_intdigest(doc[1].encode(), 42)
    return doc[0] is not None, doc[0] or 0, h - (h >> 63 << 64), doc[1] or ""


def test_token_output_with_hot_ids(spark, libraries):
    r = random.Random(5)
    docs = [(r.choice([None] * 5 + [7] * 4 + [-3, 99, 12, 13, 14]), " ".join(r.choice("the of and x y".split()) for _ in range(r.randrange(12))), "a", "en") for _ in range(500)]
    tokens = token_codec.tokenized(frame(spark, docs), tokenizer_path("word_bpe_49k.json"), 2, partitions=16).where("counts is null")
    rows = sorted(tokens.collect(), key=lambda x: (x.part, x.seq))
    per_part = {}
    for x in rows:
        per_part[x.part] = per_part.get(x.part, 0) + 1
    assert len(rows) == 500 and max(per_part.values()) < 100  # each of the two is a third and more of all rows
    for x, (i, t, *_) in zip(rows, sorted(docs, key=order_of), strict=True):
        assert x.doc_id == i and token_codec.ids_of(x.ids, x.n).tolist() == [*libraries["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids, 2]


def test_token_output(spark, libraries):
    docs = some_docs(70, 2) + [d for d in ODD if d[0] != 3] + [(3, "twice", "a", "en"), (200, "a <|ENDOFTEXT|> b <|endoftext|>X <|EndOfText|>", "a", "en")]
    got = sorted(token_codec.encoded(frame(spark, docs), tokenizer_path("word_bpe_49k.json"), 2).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t, *_) in zip(got, sorted(docs, key=order_of), strict=True):
        ids = np.array([*libraries["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens) == (at, len(ids))
        if i is not None and i > 5:
            assert (r.doc_id, r.ids_crc32) == (i, zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_codec.encoded(frame(spark, []), tokenizer_path("word_bpe_49k.json"), 2).count() == 0


# --- repeated strings ---


def test_repeated_strings(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    docs = [(k, "".join(r.choice("ab \n") for _ in range(r.randrange(50))) + passage[r.randrange(200) : r.randrange(200, 400)] + "".join(r.choice("xyz ") for _ in range(r.randrange(300))), "a", "en") for k in range(60)]
    docs += [(100, "Ing " * 200, "a", "en"), (101, "Ing " * 90, "a", "en"), (102, "é" * 300, "a", "en"), (103, "a" * 99, "a", "en"), (104, "a" * 100, "a", "en"), (105, "a" * 101, "a", "en"), (106, passage, "a", "en"), (107, passage, "a", "en"), (108, None, "a", "en"), (109, "", "a", "en")]
    want = substring_dedup.brute([(i, (t or "").encode()) for i, t, *_ in docs])
    for few in (False, True):
        if few:
            wide, substring_dedup.WIDE = substring_dedup.WIDE, 1
        try:
            got = {x.doc_id: tuple(x[1:]) for x in substring_dedup.digest(frame(spark, docs).repartition(3)).collect()}
        finally:
            if few:
                substring_dedup.WIDE = wide
        assert got == want


def test_repeats_in_long_and_odd_texts(spark, monkeypatch):
    r = random.Random(8)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(5000))
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    docs = [(1, (long + long[1000:2000]).encode()), (2, long[300:4000].encode())]
    parser, phrases = substring_dedup.Parser(), []
    for i, t in docs:
        for p in substring_dedup.pieces_of(i, 0, t):
            phrases.append(parser([p]))
    covered = {}
    for i, t in docs:
        mine = [p for p in np.concatenate(phrases) if p["doc"] == i]
        starts = sorted(s for p in mine for s in range(int(substring_dedup.fields(p["loc"])[0]), int(sum(substring_dedup.fields(p["loc"])))))
        covered[i] = starts == list(range(len(t) - 99))
    assert covered == {1: True, 2: True}
    monkeypatch.undo()
    rows = [(1, long, "a", "en"), (1, long, "a", "en"), (None, long[:500], "a", "en"), (2, long, "a", "en")]
    got = sorted((str(x.doc_id), x.n_removed) for x in substring_dedup.digest(frame(spark, rows)).collect())
    assert got == [("1", 500), ("1", 500), ("2", 5000), ("None", 0)]
    assert substring_dedup.digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
def test_suffix_array_of_a_dictionary(letters):
    r = random.Random(len(letters))
    base = "".join(r.choice(letters) for _ in range(400)).encode()
    cut = [base[a : a + 100 + r.randrange(61)] for a in (r.randrange(240) for _ in range(60))]
    data = b"".join(cut)
    ranks = substring_dedup.suffix_ranks(np.frombuffer(data, np.uint8))
    order = sorted({data[k : k + 100] for k in range(len(data) - 99)})
    assert ranks.tolist() == [order.index(data[k : k + 100]) for k in range(len(data) - 99)]
    # phrases of one key, however unlike: only equal bytes are repeats
    head = np.zeros(len(cut), substring_dedup.CONTEXT)
    head["doc"], head["sub"], head["loc"] = np.arange(len(cut)) // 2, 5, substring_dedup.location(1000 * (np.arange(len(cut)) % 2), np.array([len(c) - 99 for c in cut]))
    seen, want = set(), set()
    for k, c in enumerate(cut):
        for a in range(len(c) - 99):
            if c[a : a + 100] in seen:
                want.add((k // 2, 1000 * (k % 2) + a))
            seen.add(c[a : a + 100])
    got = substring_dedup.later_windows(head, data)
    assert {(x["doc"], x["start"] + k) for x in got for k in range(x["n"])} == want and set(got["sub"]) <= {5}
    assert substring_dedup.later_windows(np.concatenate([head, head]), data * 2).tolist() == got.tolist()
