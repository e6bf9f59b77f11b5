"""Training-data pipeline over ``documents``: five stages, each written before the next.

Stages 1 to 4 return the columns of documents, extra ones too, whatever they are called; what
one drops or changes is gone for the next.  The last returns each kept document's tokens.
A null text counts as empty in every stage; a text of any length is read whole; an empty
table gives no rows; rows of one id are scored, checked and tokenised each for itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontam, neardup, pii, quality_cnn
from riskloom.llm.common import materialise, read

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    model = quality_cnn.train(docs, read(spark, sf_dir, "labels"))
    # a column of documents may be called score too: its values wait under another name
    own = [f"own_{i}" for i in range(len(docs.columns))]
    waiting = docs.select("text", *[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own) if c != "text"])
    kept = quality_cnn.score(waiting, model).where(F.col("score") >= quality_cnn.THRESHOLD)
    return kept.select(*[F.col("text" if c == "text" else o).alias(c) for c, o in zip(docs.columns, own)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest doc_id."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that reveal it replaced, ``n_chars`` anew."""
    return pii.sanitised(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded bytes, ids."""
    return bpe.digests(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", tokens),
]

# A trained classifier and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{i}")
    return docs
