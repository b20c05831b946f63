"""Quality rules, near-dedup, PII, source mixing and tokens, one after another over documents.

Each stage takes what its predecessor kept and works on all of it. All but the last return the columns of documents.

Null and empty texts fail the quality rules, so the stages behind see none; on their own these keep them (see the operators). Rows
with a null id are never near-duplicates; rows that share an id are one document, of which near_dedup keeps one row. A null source is a
source of its own. Repeated rows and very long texts are nothing special, an empty table gives an empty result. Extra columns stay
until the last stage, which returns its own columns only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import bpe, minhash, mixing, pii, quality
from siftwork.llm.common import cut, drop, mark, read, sweep
from siftwork.llm.queries import pii_key

#: The stages can't be told in SQL; tests compare them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels"))).where("verdict.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return minhash.representatives(docs, percent=80).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; the lengths stay."""
    return pii.pseudonymise(docs, pii_key(spark)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.resample(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of what the ids decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("pseudonyms", pseudonyms), ("source mixing", mixed_sources), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a table in the shared folder; what it was made from is deleted once it is written."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        since = mark()
        after = cut(stage(spark, docs, sf_dir), "pipeline")
        sweep(spark, since, after)
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
