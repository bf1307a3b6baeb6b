"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import common, exact_dedup, langid, mixing, packing, simhash
from palimpsest.session import ship

#: Words that an encoder remembers here: fewer than by default, as its workers serve other stages, too.
WORDS = 100_000
#: SQL can't express language profiles, fingerprints, the cube method or the tokenizer.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned; those without a letter or unlike all of them go.

    Null and empty texts go, too. Repeated rows stay or go together; texts of any length are judged whole.
    """
    ship(spark)
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest id, null last; of repeated rows one.

    Null and empty texts are equal to each other.
    """
    ship(spark)
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, the smallest id, null last.

    Repeated rows and texts that differ in case or white space are copies; null and empty texts are one group, and texts
    below five words are compared as a whole.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word are never taken, a null source is one of its own."""
    ship(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids (little-endian, 32 bits), and their places in sequences.

    Null and empty texts are the end id alone; each repeated row is packed on its own.
    """
    ship(spark)
    pieces = packing.cut_pieces(docs, words=WORDS).withColumn("ids_crc32", packing.crc32_of("ids"))
    return packing.place(pieces)


STAGES = [("language ID", identified), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = common.materialise(stage(spark, docs, sf_dir), f"{path}/stage-{k}")
    return docs
