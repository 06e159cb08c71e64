"""The queries of this subpackage and, where SQL can say it, their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, exact_dedup, html_extract, language_id, mixing, packing, periodic_runs, quality_rules, simhash
from . import substring_dedup, token_count, topk_search, url_filter
from .common import materialize, small_batches
from .oracles import ORACLES  # noqa: F401

VOCABULARY = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = language_id.train(docs, allowed=F.coalesce(fold != 2, F.lit(False)))
    found = language_id.identify(docs, model)
    held = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) == 2
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.verdicts(pages, url_filter.train(pages)).withColumnRenamed("id", "page_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    # words are counted once: what is ranked afterwards are short rows
    sized = materialize(docs.select("doc_id", "source", mixing.word_count("text").alias("size")))
    mixed = mixing.mix(sized, size_col="size")
    taken = (F.col("__copies") * F.col("__size")).alias("taken")
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken)


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"))
    found = quality_rules.judge(_read(spark, sf_dir, "documents"), labels)
    return found.withColumnRenamed("id", "doc_id").withColumn("reasons", F.concat_ws(",", "reasons"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.plant(_read(spark, sf_dir, "documents")))
    # the highest length / period, compared as a fraction; runs come by start, then period, and the first of equals stays
    higher = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", higher)
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_read(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clustering.cluster(_read(spark, sf_dir, "embeddings"))
    return centroid_clustering.inertia(found, centroids).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_language_id, op3_html_extraction, op4_simhash, op5_url_filter, op6_substring_dedup, op7_mixing,
        op8_token_count, op9_packing, op10_quality_rules, op11_periodic_runs, op12_topk_search, op13_centroid_clustering,
    )
}
