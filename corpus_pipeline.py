"""The corpus pipeline: stages over the table documents, each written as Parquet and read again for the next.

1. language ID: documents go whose language can't be told (no text, no letter), or that score well below what the training
   texts of that language and length do; where those are too few to tell, only below LEAST_SCORE.
2. near-dedup: documents are linked whose SimHash fingerprints differ in two bits or fewer, found by the pigeonring index of
   op8, and further those whose five-word shingles are alike by 0.8 (Jaccard), most of which differ in more bits; of each
   group of linked documents the one with the least doc_id stays.
3. benchmark decontamination: benchmark spans are cut; documents that are mostly benchmark go.
4. PII: found spans are replaced by their kinds.
5. byte-level BPE: token ids of the text that is left, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

All but the last return the columns of documents. Null texts go in the first stage; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, common, decontaminate, langid, nearcopies, pii

LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told; profiles and limits are learned from the training split of docs."""
    train = docs.where(~langid.held_out())
    profiles = langid.learn(train)
    return langid.keep_told(docs, profiles, langid.limits(train, profiles, LEAST_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs, fingerprints=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.public(), with_ids=True)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", tokens),
]

#: Profiles, fingerprints and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
