"""From raw documents to token ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtally.llm import bpe, lines, minhash, mixing, quality
from soundtally.llm.common import stored, table

#: Tokenizer file of the last stage, as each executor has it.
TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good: all rows that score at least 0.3, repeated ones and those without doc_id among them; null and empty texts score the labelled sample's share of good ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one makes superfluous. Rows without doc_id, and those with a null or blank text, stay as they are; rows that share a doc_id count as one document."""
    return lines.dedup_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8. Of rows that share a doc_id one stays; those without doc_id, and those with a null or blank text, all stay."""
    return minhash.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them; source weights reach 0.95 of the largest entropy. A null source is one of its own; rows without doc_id are repeated like others, those without a word come with their block."""
    return mixing.mixed(docs, entropy=0.95)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text decoded from them; a null or empty text has no ids."""
    out = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the classifier; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written to the shared folder before the next reads it. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
