"""The document pipeline: parse, clean, normalise, chunk; one lazily composed plan without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import word_count
from docloom.operators import evaluation
from docloom.plans.config import ChunkerSettings, Settings
from docloom.sources.registry import REGISTRY, ParserRegistry, parse_files, read_files


@dataclass(frozen=True)
class Pipeline:
    """Immutable: every setter returns a new one. Without configuration there are no preprocessors and a recursive chunker.

    ``error_strategy``: ``skip`` and ``log`` leave failed documents as rows with ``success`` false; ``raise`` fails the job.
    """

    preprocessors: tuple = ()
    chunker: ChunkerSettings | None = ChunkerSettings()
    error_strategy: str = "skip"
    parser_options: dict | None = None
    registry: ParserRegistry = REGISTRY

    @classmethod
    def from_settings(cls, settings: Settings) -> Pipeline:
        return cls((settings.chain(),), settings.chunker, settings.error_strategy, settings.parser)

    def add_preprocessor(self, step) -> Pipeline:
        return replace(self, preprocessors=(*self.preprocessors, step))

    def set_chunker(self, chunker: ChunkerSettings | None) -> Pipeline:
        return replace(self, chunker=chunker)

    def set_error_strategy(self, strategy: str) -> Pipeline:
        return replace(self, error_strategy=strategy)

    def preprocess(self, c: Column) -> Column:
        return reduce(lambda out, step: getattr(step, "process", step)(out), self.preprocessors, c)

    def process_text(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds content, word_count, char_count and chunks (after cleaning) to a table of texts; works on streams too."""
        out = docs.withColumn("content", self.preprocess(F.col(text_col)))
        out = out.withColumn("word_count", word_count("content").cast("long")).withColumn("char_count", F.length("content").cast("long"))
        return out.withColumn("chunks", self.chunker.column(F.col("content"))) if self.chunker else out

    def process_files(self, files: DataFrame) -> DataFrame:
        """From ``binaryFile`` rows; failed files keep their row."""
        parsed = parse_files(files, self.parser_options, self.registry)
        if self.error_strategy == "raise":
            stop = F.raise_error(F.concat(F.col("source_path"), F.lit(": "), F.col("error"))).cast("boolean")
            parsed = parsed.withColumn("success", F.when(F.col("success"), True).otherwise(stop)).where("success")
        return self.process_text(parsed.withColumnRenamed("content", "_raw"), "_raw").drop("_raw")

    def process_directory(self, spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None, extensions: list[str] | None = None) -> DataFrame:
        return self.process_files(read_files(spark, path, recursive, pattern, extensions))


def failed_files(results: DataFrame) -> DataFrame:
    """(source_path, error) of all failed files."""
    return results.where("not success").select("source_path", "error")


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: totals and success rate. The files that failed are a table of their own (``failed_files``)."""
    return evaluation.batch_totals(results)


def notify(results: DataFrame, on_progress: Callable[[int, int, str], None] | None = None, on_error: Callable[[str, str], None] | None = None, on_complete: Callable[[Row], None] | None = None) -> int:
    """Calls back on the driver for every processed document, and returns their number.

    ``on_progress`` gets the number so far, the total and the path; ``on_error`` the path and error of a failed one; ``on_complete`` the row of
    any other. Rows come one partition at a time, and without ``on_complete`` only paths and errors do. ``results`` should be a written table.
    """
    total, done = results.count(), 0
    columns = results if on_complete else results.select("source_path", "success", "error")
    for done, row in enumerate(columns.toLocalIterator(prefetchPartitions=True), 1):
        if row["success"] and on_complete:
            on_complete(row)
        if not row["success"] and on_error:
            on_error(row["source_path"] or "unknown", row["error"])
        if on_progress:
            on_progress(done, total, row["source_path"])
    return done


def run_benchmark(docs: DataFrame, configs: dict[str, ChunkerSettings], clean: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text", parse: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(config_name, document, chunk table columns, vector with ``embed``): one branch of the plan per configuration, over the same scan.

    ``parse`` makes ``docs`` (id_col, text_col) from another table first, as of files; ``embed`` makes a vector of a chunk's content.
    """
    from docloom.operators.chunking import chunk_table

    docs = parse(docs) if parse else docs
    base = docs.select(F.col(id_col).alias("document"), (clean(F.col(text_col)) if clean else F.col(text_col)).alias("_t"))
    parts = [chunk_table(base, c.column(F.col("_t")), "document").withColumn("config_name", F.lit(name)) for name, c in configs.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("vector", embed(F.col("content"))) if embed else out
