"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.decontaminate import find_leaks
from docloom.llm.embedding_dedup import near_vectors
from docloom.llm.language_id import identify
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.oracles import ORACLE_SQL
from docloom.llm.packing import pack
from docloom.llm.quality import classify
from docloom.llm.secret_scan import scan_secrets
from docloom.llm.sharding import assign_shards
from docloom.llm.substring_dedup import repeats


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(_table(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir), width=2)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir), 40)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_secret_scan, op3_packing, op4_substring_dedup, op5_near_dedup, op6_embedding_dedup, op7_sharding, op8_quality, op9_language, op10_decontaminate)}

__all__ = ["ORACLE_SQL", "QUERIES"]
