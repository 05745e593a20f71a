"""Corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. A caller may write what a
stage returns and hand the reread table to the next; :func:`run` cuts the plan between stages with a checkpoint instead.

Nulls: a null text has no language and goes in the first stage; later stages given one keep it as it is (line dedup drops
it, as it has no word). A null id, language, source or length is kept; ties for what stays of a group go to the least id, a
null one last, then to the text. Of rows equal in id and text, near dedup keeps one. Extra columns stay up to the last stage,
whatever their names. Empty tables pass every stage. Texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm import bpe, decontaminate, langid, lines, near
from corepick.llm.common import cut, table

#: A document whose nearest language profile is further than this is in none of the languages.
MIN_LANG_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters and those far from every profile go."""
    columns = docs.columns
    guessed = langid.identify(docs, langid.model_of(docs), label="lang_pred", score="lang_score")
    return guessed.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= MIN_LANG_SCORE)).select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines; ``n_chars`` follows, and documents left without a word go."""
    kept = lines.dedup_lines(docs).filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, whole or in part."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text decoded from them."""
    out = bpe.encode_documents(docs, bpe.default_path())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded_text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL has no near-duplicate groups and no BPE; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
