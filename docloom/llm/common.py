"""Shared parts: tables written to the cluster's shared folder, and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a new local folder serves a local session, as in tests; on a cluster it is an error, since executors
    would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes that may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 2_000_000


def _width(name: str, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if kind.startswith("array"):
        return 8 * F.greatest(F.size(name), F.lit(0)) + 32
    return F.lit(8)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` (columns of fixed width, strings, binaries, arrays of those) take no more than ``most`` bytes.

    One aggregation, partial in every task; ``df`` should be a written table.
    """
    width = F.lit(16)
    for name, kind in df.dtypes:
        width = width + _width(name, kind)
    return (df.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0) <= most


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast ``df`` if it is measured to be small."""
    return F.broadcast(df) if is_small(df, most) else df


class Scratch:
    """Tables written as Parquet in the shared folder, which cuts lineage: a lost executor costs a reread, not a rerun.

    ``drop`` removes a table that no unfinished plan reads any more; ``drop_all`` all but those named. What a returned plan
    still reads stays: its caller reads it after the function has ended.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append(back)
        self.paths[id(back)] = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                self.kept = [x for x in self.kept if x is not df]
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*[x for x in self.kept if all(x is not y for y in but)])


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node links its larger neighbours to the smallest node it
    sees, then itself and its smaller neighbours to the smallest. Every round is two aggregations with map-side
    combine and two equi-joins that adaptive execution may split where one node has very many links; the number
    of rounds grows with the logarithm of the longest path. Nothing but a count and a checksum comes to the driver.

    Null ends and self-links are ignored; no edges give no rows.
    """
    now = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    before = _checksum(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (
            both.join(low, F.col("a") == F.col("u")).where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        )
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
            .unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        )
        after_df = scratch.save(small)
        scratch.drop(now)
        now, after = after_df, _checksum(after_df)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
