"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing, topk, url_filter, warc
from .classifier import score_documents
from .mixing import mix
from .near_dedup import near_duplicates
from .oracles import ORACLE_SQL
from .quality_rules import repetition_rules
from .substring_dedup import repeated_passages
from .token_counts import count_tokens


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.term_labels(pages), folds=url_filter.FOLDS))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cold cache each time, so that its cost is that of a corpus not met before."""
    return count_tokens(common.documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(common.documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(common.documents(spark, sf_dir))
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(common.written(digest, "pieces"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).drop("source")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages")).drop("target_uri")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(common.documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}
