"""From raw documents to token ids: quality rules, one document of each near-duplicate group,
personal data replaced, sources mixed to target weights, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept, on whole
texts of any length. All but the last return the columns of ``documents``, with any further
ones as they came. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import minhash, mixing, pii, quality, tokenize
from foliant.sources.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition and symbol limits.

    A null or empty text has no words and goes; repeated rows are judged alike.
    """
    return quality.score_quality(docs, passthrough=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id.

    Texts without words are in no group and stay. Of rows that repeat an id one stays; rows
    with a null id stay if they are not near a row with an id.
    """
    return minhash.keep_one_of_each(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars counts the new text (null for a null text)."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by Poisson draw, sources weighted by the root of their size, in random order.

    A null source is one of its own; a source without bytes gets no copies. Repeated ids are
    drawn alike. Columns named as the draw's own (copy, shuffle_key) are kept as they came.
    """
    return mixing.mix_sources(docs, size=F.coalesce(F.octet_length("text"), F.lit(0))).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy and the digest of their decoding; a null text counts as empty."""
    return tokenize.encode_documents(docs).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", replace_pii),
    ("source mixing", mix),
    ("SentencePiece", encode),
]

#: Rolling hashes, signatures and the tokenizer are outside SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
