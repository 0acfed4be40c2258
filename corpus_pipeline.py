"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch
from docloom.llm.decontaminate import drop_leaks
from docloom.llm.line_dedup import drop_repeated_lines
from docloom.llm.near_dedup import drop_near_duplicates
from docloom.llm.packing import pack
from docloom.llm.quality import fit, labelled_sample, score

THRESHOLD, LABELLED_ROWS = 0.3, 4000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below the threshold go.

    Null and empty texts score as texts without evidence; without labels all stay. Rows with a null id are scored like any other.
    """
    model = fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LABELLED_ROWS))
    return docs.where(score(F.col("text"), model) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with the text that is left and its new length.

    A null text stays null; a null id sorts last, so its lines go first.
    """
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id. Null ids and texts without words stay."""
    return drop_near_duplicates(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go. Null and empty texts contain none; null ids are treated like any other."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row per piece. A null text is empty and gives one piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Trained scores and packing are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Intermediate results are written to the shared folder."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return done
        kept = scratch.save(done)
        scratch.drop(docs)
        docs = kept
    return docs
