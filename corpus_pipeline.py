"""Documents to token ids: five stages of the corpus operators, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.llm import bpe, language, mixing, simhash, suffixes
from vetloom.llm.common import keep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language or between two go."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.where(~F.col("_ambiguous") & (F.col("_lang_pred") != language.UNKNOWN)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.one_of_each(docs, shingle=3, radius=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 50 that a document with a smaller id has go; so do documents left empty by it."""
    left = suffixes.without_repeats(docs, match=50)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating; documents come as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    import public_tokenizers

    found = bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The stages learn, hash with XXH64 and build suffix arrays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = keep(docs, name)
    return docs
