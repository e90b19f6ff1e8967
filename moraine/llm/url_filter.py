"""URL filters: rules by longest fit, else naive Bayes over segmented names.

Names in hosts are split into words by a unigram model and Viterbi search, and
multinomial naive Bayes scores the words of host and path. The unigram model
has counts from a corpus of texts. The classes are learned from the URLs for
which a rule decides: what those have in common with other URLs decides there.
How many URLs the rules happen to cover says nothing of the others, so both
classes weigh the same beforehand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, pick, small

#: (verdict, host, path); fixed values of the query's contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LONGEST = 20  # letters of a word
FEW_WORDS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url, or one without ``://``. Only A-Z are lower-cased."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): of the rules that fit the longest; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segment(name: str, log_p: dict[str, float], total: float) -> list[str]:
    """The likeliest split of a name into words; unknown runs cost tenfold a letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for z in range(1, len(name) + 1):
        options = []
        for a in range(max(0, z - LONGEST), z):
            w = name[a:z]
            p = log_p.get(w)
            options.append((best[a][0] + (p if p is not None else math.log(10 / total) - len(w) * math.log(10)), a))
        best.append(max(options))
    out, z = [], len(name)
    while z:
        out.append(name[best[z][1] : z])
        z = best[z][1]
    return out[::-1]


def _word_counts(pieces: DataFrame, corpus: DataFrame) -> DataFrame:
    """(word, n) of those pieces that are words of the corpus."""
    words = pick(corpus, "text").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word != ''")
    each = words.join(small(pieces, FEW_WORDS), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return durable(each)


def segmented(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(label, words) of each distinct host label, by a model of the corpus' words.

    Only words that a label holds matter, so the model never leaves the
    cluster: a label meets its own candidate words.
    """
    labels = labels.select("label").distinct()
    a, n = F.explode(F.sequence(F.lit(1), F.length("run"))), F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("a") + 1))
    runs = labels.select("label", F.explode(F.regexp_extract_all("label", F.lit("[a-z]+"), F.lit(0))).alias("run"))
    pieces = durable(runs.select("label", "run", a.alias("a")).select("label", F.explode(F.transform(n, lambda k: F.substr(F.col("run"), F.col("a"), k))).alias("word")).distinct())
    counts = _word_counts(durable(pieces.select("word").distinct()), corpus)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 10_000
    candidates = pieces.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))

    def split(frames):
        for f in frames:
            out = []
            for label, found in zip(f["label"], f["found"]):
                log_p = {x["word"]: math.log(x["n"] / total) for x in (found if found is not None else ())}
                out.append([w for run in _letters(label) for w in segment(run, log_p, total)])
            yield pd.DataFrame({"label": f["label"], "words": out})

    return labels.join(candidates, "label", "left").mapInPandas(split, "label string, words array<string>")


def _letters(label: str) -> list[str]:
    return re.findall("[a-z]+", label)


def judged(pages: DataFrame, corpus: DataFrame, rules=RULES, learn: Callable[[Column], Column] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_log_odds) of every row.

    corpus: a table with a ``text`` column, for the unigram model. learn: given
    the host, whether the classes may be learned from it (all by default). A
    null url, or one without ``://``, has empty host and path and fits no rule.
    Names without a known word, and all names where no rule decides anything,
    have odds of 0 and are allowed. Repeated rows each have a row and count
    each; other columns are ignored. Empty tables are fine: without URLs there
    is no result, and without texts no word is known to the segmentation.
    """
    p = pick(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    p = p.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    keys = durable(p.groupBy("host", "path").agg(F.count("*").alias("rows")))
    key = keys.select("host", "path", "rows", F.explode(F.filter(F.split("host", r"[.:@-]"), lambda x: x != "")).alias("label"))
    by_label = durable(segmented(key, corpus))
    of_host = key.join(by_label, "label").select("host", "path", "rows", F.explode("words").alias("word"), F.lit(True).alias("in_host"))
    of_path = keys.select("host", "path", "rows", F.explode(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]+"), F.lit(0))).alias("word"), F.lit(False).alias("in_host"))
    tokens = durable(of_host.unionByName(of_path).withColumn("word", F.concat(F.when(F.col("in_host"), "h:").otherwise("p:"), "word")))
    _, decided = rule_for(F.col("host"), F.col("path"), rules)
    known = tokens.withColumn("by_rule", decided).where("by_rule IS NOT NULL")
    if learn:
        known = known.where(learn(F.col("host")))
    of = lambda verdict: F.coalesce(F.sum(F.when(F.col("by_rule") == verdict, F.col("rows"))), F.lit(0))
    each = durable(known.groupBy("word").agg(of("block").alias("b"), of("allow").alias("a")))
    b, a, v = each.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    weights = durable(each.select("word", (F.log((F.col("b") + 1) / F.lit(float(b + v + 1))) - F.log((F.col("a") + 1) / F.lit(float(a + v + 1)))).alias("w")))
    odds = tokens.join(small(weights, FEW_WORDS), "word").groupBy("host", "path").agg(F.sum("w").alias("odds"))
    out = p.join(odds, ["host", "path"], "left")
    rule, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    score = F.coalesce("odds", F.lit(0.0))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("block_log_odds"))
