"""From raw documents to packed training sequences: reject toxic texts, keep one of each group of near-duplicates, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the columns of documents, further ones included, and
leave the values of what they keep as they are, but for masked texts and their n_chars. An empty table passes through all stages as one. Rows that are repeated whole
are rows like others, but for the stage that drops copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import minhash, packing, secrets, toxicity
from lorekeep.llm.common import durable

#: No SQL tokenizes or fits a classifier; tests/llm/test_pipeline.py compares the rows with a brute-force version.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, learnt from the labels, takes for toxic go: those with a score of one half or more.

    A null or empty text has the score of no words at all, which the share of toxic labels decides; rows with a null doc_id are judged like others. Equal texts have equal scores.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id: five-word shingles, similarity of at least 0.8.

    Of rows repeated whole one stays. Null, empty and blank texts are like nothing and stay, as do rows with a null doc_id; a text of fewer than five words is one shingle.
    Of rows that share a doc_id but not their text each stays, unless the document goes as a copy of another one.
    """
    return minhash.keep_one(docs, k=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, copied examples are not; every document stays.

    Null and empty texts stay as they are. A value that more than two sources hold is a copied example; documents of a null source count as one source's. Where spans overlap, the first is masked
    and what the others reach beyond it goes with it.
    """
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096; the rows are op6's.

    A null or empty text is the end token alone. Repeated rows and null doc_ids are packed like others. Which of equally long pieces comes first is up to their ids and checksums.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("minhash", drop_copies), ("secrets", mask_secrets), ("packing", pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
