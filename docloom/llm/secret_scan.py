"""Secret scans: spans found in every text, then ownership frequency of each candidate over the corpus.

A candidate that many repositories of many owners hold is a copied example; one that stays with a single owner is
live-looking. Candidates travel as hashes only.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(?P<k>password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Added by this operator: long mixed runs that no base kind covers.
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KINDS = ("assign", "access", "hex", "owned")

FOUND = T.StructType([
    T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("owner", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()), T.StructField("value", T.LongType())]))),
])


def entropy(value: str) -> float:
    """Bits per character of the characters' own distribution."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def find_spans(text: str | None) -> list[tuple[int, int, int, int]]:
    """(kind, start, stop, value hash) by start, then kind; kinds as in ``KINDS``. Offsets count code points."""
    if not text:
        return []
    found = []
    for m in ASSIGN.finditer(text):
        if len(m["v"]) >= 12:
            found.append((0, m.start(), m.end(), m["v"]))
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    # starts in order, and how far the spans up to each of them reach
    taken = sorted((x[1], x[2]) for x in found)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in MIXED.finditer(text):
        v, before = m[0], bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        if re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and entropy(v) >= 3.5:
            found.append((3, m.start(), m.end(), v))
    return [(k, s, e, _hash(v)) for k, s, e, v in sorted(found, key=lambda x: (x[1], x[0]))]


def _scan(batches):
    schema = pa.schema([
        ("rid", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()),
        ("spans", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64())]))),
    ])
    for batch in batches:
        spans = [[dict(kind=k, start=s, stop=e, value=v) for k, s, e, v in find_spans(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("owner"), pa.array(spans, schema.field("spans").type)], schema=schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied.

    The repository of a candidate is its document, its owner that document's ``owner_col``. Ownership frequency: hashes are first
    reduced to one row per (hash, owner) with map-side combine, then to owners and repositories per hash, so a
    candidate that a third of all rows hold never meets in one task. A candidate with at most ``max_owners`` owners
    and ``max_repositories`` repositories is live-looking, any other a copied example. Live-looking ``owned`` spans join the base spans; base spans
    always stay.

    Nulls: a null text is an empty one; a null owner is an owner of its own; a null id is kept. Repeated rows are each
    returned and count as one repository if their ids agree. Columns besides the three named are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    from docloom.llm.common import Scratch

    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    found = Scratch(spark).save(base.mapInArrow(_scan, FOUND))
    spans = found.select("rid", "doc_id", "owner", F.explode("spans").alias("s")).select("rid", "doc_id", "owner", "s.*")
    per_owner = spans.groupBy("value", "owner").agg(F.count_distinct("doc_id").alias("repos"))
    ownership = per_owner.groupBy("value").agg(
        (F.count("owner") + F.max(F.when(F.col("owner").isNull(), 1).otherwise(0))).alias("owners"), F.sum("repos").alias("repos"))
    live = spans.join(ownership.where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories)).select("value"), "value", "left_semi")
    live = live.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("live"))
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    is_live = lambda s: F.exists(F.col("live"), lambda x: (x["start"] == s["start"]) & (x["kind"] == s["kind"]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    whole = found.join(live, "rid", "left").withColumn("live", F.coalesce("live", F.array().cast("array<struct<start:int,kind:int,stop:int>>")))
    return whole.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < 3), named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.filter("spans", lambda s: (s["kind"] < 3) | is_live(s)), named), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: (s["kind"] == 3) & is_live(s))).cast("long").alias("n_owned"),
        F.size("live").cast("long").alias("n_live"),
        (F.size("spans") - F.size("live")).cast("long").alias("n_copied"),
    )
