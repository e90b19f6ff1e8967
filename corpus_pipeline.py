"""A pipeline from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next
stage's ``docs`` is that one, written and read again. All but the last return
the columns of documents.

Any column may hold nulls, rows may repeat, texts may be empty or very long,
and there may be further columns of any name, which pass through up to the
last stage. No stage of an empty table leaves any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import decontaminate, mixing, quality_rules, similar, token_codec
from moraine.llm.common import Staged
from moraine.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null and empty texts. Repeated rows each stay or go."""
    return quality_rules.kept_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays, null last: SimHash first, then exact prefixes, a Jaccard similarity of five-word shingles of 0.8 or more.

    Rows are told apart by id and text, so unlike texts stay with any ids. Texts without a word are one group.
    """
    return similar.without_similar(docs, width=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null and empty texts hold none, and null items are held by none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and of each document what was read back from them. Null ids come first; rows that repeat are documents each."""
    return token_codec.encoded(docs, tokenizer_path("word_bpe_49k.json"), end=2, keep=150_000)


STAGES = [("quality rules", quality), ("near-duplicates", deduplicate), ("decontamination", decontaminated), ("mixing", mixed), ("token output", tokens)]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder. What a stage leaves is deleted when the next one's is written."""
    out, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        now = Staged(out) if k + 1 < len(STAGES) else None
        if last:
            last.drop()  # the last stage has read its rows when it returns: its result comes from the token files
        if now:
            out, last = now.read(), now
    return out
