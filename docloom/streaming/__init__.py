"""Streams: the row-local plans over ``readStream`` sources. Appending, without state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docloom.plans.pipeline import Pipeline


def stream_files(spark: SparkSession, path: str, pattern: str | None = None, max_files: int = 1000) -> DataFrame:
    """New files below a folder as they appear."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def stream_texts(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def process_stream(source: DataFrame, pipeline: Pipeline, text_col: str | None = None) -> DataFrame:
    """The same plan as in a batch: over texts if ``text_col`` is given, else over files."""
    return pipeline.process_text(source, text_col) if text_col else pipeline.process_files(source)


def write_chunks(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
