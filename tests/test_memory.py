"""Steps in Python: what a worker holds must not grow with the batches that it gets."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import markup, normalize
from docloom.operators import chunking
from docloom.sources import registry, samples

psutil = pytest.importorskip("psutil")
LINE = "Café number %d is here. It was open! "


def peak_mb(spark, make):
    """MB of the largest Python worker while ``make()`` is computed in full, by workers that nothing else has used."""
    workers = lambda: {p.pid for p in psutil.Process().children(recursive=True) if p.name().startswith("python")}
    before = workers()
    spark.sparkContext.environment["DOCLOOM_WORKERS"] = uuid.uuid4().hex
    make().write.format("noop").mode("overwrite").save()
    del spark.sparkContext.environment["DOCLOOM_WORKERS"]
    return max(int(re.search(r"VmHWM:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) for pid in workers() - before) / 1024


def texts(spark, n):
    lines = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.format_string(LINE + "<p><a href='#%d'>x</a>", i, i))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat("id", F.array_join(lines, "\n")).alias("text"), F.lit("s").alias("source"))


def parsed(kind):
    return lambda df: registry.parse_files(samples.sample_files(df, kind))


CASES = {
    "F1": lambda df: df.select(chunking.semantic("text", catalog._letter_vectors, 0.99, size=2000)),
    "F2": lambda df: df.select(chunking.recursive(normalize.unicode_form("text"), 20, 0, 10)),
    "F3": parsed("hwpx"),
    "F4": parsed("hwp"),
    "F7": parsed("xlsx"),
    "F8": lambda df: df.select(normalize.strip_accents("text")),
    "F9": lambda df: df.select(markup.html("text")),
    "F10": parsed("docx"),
    "F13": lambda df: df.select(markup.html("text", structured=True)),
}


@pytest.mark.parametrize("case", CASES)
def test_memory_of_a_worker_does_not_grow_with_the_batch(spark, case):
    few, many = (peak_mb(spark, lambda n=n: CASES[case](texts(spark, n))) for n in (256, 4000))
    assert many < few + 35, f"{few:.0f} MB for 256 rows, {many:.0f} MB for 4000"
