"""From documents to token ids: quality, exact copies, near copies, source mix, byte-level BPE.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that the stage before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, minhash, mixing, quality
from corvane.llm.common import staged


def quality_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach grade 1 with probability quality.KEEP at least, by a model of the rated ones."""
    _, ratings = quality.read(spark, sf_dir)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return quality.selected(docs, "text", quality.fit(texts, ratings))


def exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over runs of five words."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 3 times) as the mix begins them, so that each source's words come near its target."""
    return mixing.repeated_documents(docs)


def token_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    tokens = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mix),
    ("bpe", token_ids),
]

#: The classifier and MinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
