"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents with a toxicity score of 0.5 or more go;
2. line dedup: repeated chunks of lines go, and documents that this leaves empty;
3. n-gram Jaccard join: of linked documents the one with the least id stays;
4. benchmark decontamination: contaminated documents go;
5. byte-level BPE: what is left is encoded, and decoded again.

Every stage works on all rows of the one before.  Rows without an id are never
linked or contaminated by another row and stay; null texts stay null until the last stage, which
counts them as empty; rows of equal id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultshift.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from vaultshift.llm.common import table
from vaultshift.session import written

LEAST_TOXIC = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents outside the held-out fold."""
    model, share = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.in_fold(F.col("doc_id"), 5, 0))
    scored = toxicity.score(docs, model, share, keep_text=True)
    return scored.where(F.col("toxicity.score") < LEAST_TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeats(docs)
    emptied = (F.col("dedup.removed_chunks") > 0) & (F.col("text") == "")
    kept = kept.where(F.col("text").isNull() | ~emptied)
    changed = F.when(F.col("dedup.removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rule is op10's: shingles of four words, 85 per cent."""
    found = ngram_join.ngram_components(docs, size=4, percent=85)
    first = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of the token ids and of the decoded text, and the ids."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), path, pattern, ids="ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_and_decode),
]

#: Learned scores, content-defined chunks and BPE can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
