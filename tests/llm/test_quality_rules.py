"""Quality verdicts: other languages, a plain version, odd rows."""

import math
import random
import re
from statistics import median_low

import pytest

from moraine.llm import quality_rules

DOCS = "doc_id long, text string, source string, lang string"
ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura! Tant' è amara che poco è più morte; ma per trattar del ben ch' io vi trovai, dirò de l' altre cose ch' i' v' ho scorte. Io non so ben ridir com' i' v' intrai, tant' era pien di sonno a quel punto che la verace via abbandonai."
POLISH = "Litwo! Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. Panno święta, co Jasnej bronisz Częstochowy i w Ostrej świecisz Bramie! Ty, co gród zamkowy nowogródzki ochraniasz z jego wiernym ludem! Jak mnie dziecko do zdrowia powróciłaś cudem, gdy od płaczącej matki pod Twoją opiekę ofiarowany, martwą podniosłem powiekę."
RUSSIAN = "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил и лучше выдумать не мог. Его пример другим наука; но, боже мой, какая скука с больным сидеть и день и ночь, не отходя ни шагу прочь! Какое низкое коварство полуживого забавлять, ему подушки поправлять, печально подносить лекарство, вздыхать и думать про себя: когда же черт возьмет тебя! Так думал молодой повеса, летя в пыли на почтовых, всевышней волею Зевеса наследник всех своих родных."


def prose(r, lang, n):
    common = quality_rules.COMMON[lang].split()
    letters = {"en": "etaoinshr", "fr": "esaitnrulé", "de": "enisratdhü", "es": "eaosrnidló"}[lang]
    words = [r.choice(common) if r.random() < 0.4 else "".join(r.choice(letters) for _ in range(6)) for _ in range(n)]
    return ". ".join(" ".join(words[k : k + 12]).capitalize() for k in range(0, n, 12))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    out = [(k, prose(r, lang, r.choice([25, 60, 150, 400])), "s", lang) for k in range(240) for lang in [r.choice(["en", "fr", "de", "es"])]]
    junk = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) + r.choice(["&&&", "###", "%%%", "$$$"]) for _ in range(r.choice([60, 200])))
    out += [(1000 + k, junk(), "s", r.choice(["en", "it", None])) for k in range(12)]
    out += [(2000, None, None, None), (2001, "", "s", "en"), (None, prose(r, "en", 200), "s", "en"), (2002, "short text", "s", "en"), (2003, out[0][1], "s", out[0][3]), (2003, out[0][1], "s", out[0][3]), (2004, prose(r, "en", 60_000), "s", "en"), (2005, "x" * 300_000, "s", "en")]
    return out


def plain_verdicts(rows):
    """By the definition, with plain lists."""
    classes = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: ord(c) > 127, lambda c: "0" <= c <= "9", lambda c: c in ".,", lambda c: c in ";:!?'\"()-", lambda c: c in "#*$%&|<>", lambda c: c not in " \t\n\x0b\x0c\r"]

    def chars(t):
        out = [0] * 8
        for c in t:
            k = next((k for k, f in enumerate(classes) if f(c)), None)
            if k is not None:
                out[k] += 1
        return out

    def low(t):
        return [w for w in re.sub(r"[.,;:!?'\"()]", "", t.lower()).split() if w]

    def common(ws, lang):
        names = quality_rules.COMMON[lang].split()
        return [ws.count(n) for n in names] + [len(ws) - sum(ws.count(n) for n in set(names))]

    def share(h):
        return [x / max(1, sum(h)) for x in h]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
        return max(0.0, kl) ** 0.5

    def base_fails(t):
        w = t.split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        marked = {k for i, x in enumerate(windows) if seen[x] > 1 for k in range(i, i + 8)}
        return len(w) < 20 or 100 * len(marked) > 30 * len(w)

    refs = {}
    for lang in quality_rules.COMMON:
        own = [t for _, t, _, tag in rows if tag == lang and t and len(t.split()) >= 100 and not base_fails(t)]
        if own:
            refs[lang] = [median_low(x) for x in zip(*(share(chars(t)) for t in own))], [median_low(x) for x in zip(*(share(common(low(t), lang)) for t in own))]
    fold = lambda h: [sum(h[:3]), *h[3:]]
    out = []
    for i, t, _, tag in rows:
        t = t or ""
        kept = not base_fails(t)
        if kept and sum(chars(t)) >= 200:
            how = (lambda h: h) if tag in refs else fold
            kept = min(distance(how(chars(t)), how(r[0])) for r in refs.values()) <= 0.12 + 4.0 / len(t.encode()) ** 0.5
        if kept and tag in refs and len(low(t)) >= 50:
            kept = min(distance(common(low(t), k), r[1]) for k, r in refs.items()) <= 0.10 + 2.1 / len(t.split()) ** 0.5
        out.append((str(i), kept))
    return sorted(out)


def test_verdicts_against_a_plain_version(spark, docs):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'junk' AS kept", "1 AS n_words", "'x' AS shares")
    got = sorted((str(r.doc_id), r.kept) for r in quality_rules.judged(df).collect())
    assert got == plain_verdicts(docs)
    kept = quality_rules.kept_documents(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, ok in got if ok) and kept.columns == df.columns
    assert not any(ok for i, ok in got if 1000 <= int(i.replace("None", "0")) < 1012)
    assert quality_rules.kept_documents(df.where("false")).count() == 0


def test_other_languages_stay(spark, docs):
    more = [(5000, ITALIAN, "s", "it"), (5001, POLISH, "s", "pl"), (5002, RUSSIAN, "s", "ru"), (5003, ITALIAN, "s", None), (5004, RUSSIAN * 9, "s", None), (5005, POLISH, "s", "xx")]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(docs + more, DOCS)).collect()}
    assert all(got[k] for k in range(5000, 5006) if k != 5004)  # that one repeats itself
    r = random.Random(4)
    words = RUSSIAN.split()
    tagged = [(6000 + k, " ".join(r.choice(words) for _ in range(150)), "s", "ru") for k in range(60)]
    refs = quality_rules.references(spark.createDataFrame(docs + tagged, DOCS))
    assert refs["ru"][1] is None and refs["ru"][0][2] > 0.8 and set(refs) == {"en", "fr", "de", "es", "ru"}
    got = {x.doc_id: x.kept for x in quality_rules.judged(spark.createDataFrame(docs + tagged, DOCS)).collect()}
    assert all(got[6000 + k] for k in range(60))
    assert quality_rules.judged(spark.createDataFrame(docs, DOCS).drop("lang")).where("kept").count() > 200
