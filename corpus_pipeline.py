"""A corpus pipeline in five stages, each one operator of ``lectern.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, language_id, mixing, packing, simhash
from lectern.llm.common import discard, materialize, small_batches, too_many

#: A text is rejected at so many bits a byte under its best language: twice what running text of a known language takes,
#: near what bytes without any order take.
REJECT_BITS = 6.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without a letter, or that no learned language codes at all well, go."""
    small_batches(spark)
    model = language_id.train(docs)
    # an id may repeat or be null: a row is found again by id and the digest of its text
    named = docs.withColumn("__of", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    found = language_id.identify(named, model, carry=("__of",)).where((F.col("lang_pred") == "und") | (F.col("bits_per_byte") > REJECT_BITS))
    bad = materialize(found.select(F.col("id").alias("__id"), F.col("__of").alias("__sha")).distinct())
    gone = named["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (named["__of"] == bad["__sha"])
    # its size is known now: a few rows are sent to every task, and no text is shuffled
    return named.join(bad.hint("shuffle_hash") if too_many(bad, 200_000) else F.broadcast(bad), gone, "left_anti").drop("__of")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the document with the largest id stays."""
    small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup at a Jaccard similarity of 0.8 of five-word shingles: of each group the document with the smallest id stays."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, words=5, similarity=(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document comes as often as the mix takes it."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document in a sequence."""
    small_batches(spark)
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), lookup_bytes=4 << 20, held=250_000).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models, fingerprints and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            if written:  # its only reader is written now
                discard(written)
            written = docs
    return docs
