"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the size of their shingle set. Each item is posted under the shingles of its bottom-k MinHash
sketch (the whole set where it has no more than k). A document holds an item's sketch shingles with the
probability of its containment, however long the document is, so counting them in the document's own
shingles estimates containment directly. Items that reach their partition's threshold are counted exactly.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 64
BITS = 22
#: Words whose hashes a Python worker keeps.
KEPT_WORDS = 250_000
_OTHER = re.compile(r"[\W_]+")
M1, M2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash of its lower-cased letters and digits, 0 if it has none. Emptied when full."""

    def __missing__(self, word: str) -> int:
        bare = _OTHER.sub("", word.lower())
        value = (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1) if bare else 0
        if len(self) > KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    h = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h + words[i : i + size]) * ODD
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * M1
        h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def item_shingles(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, width, shingles): distinct shingles of each item; shorter items are one shingle of their own width."""

    def run(batches):
        table = WordHashes()
        for batch in batches:
            widths, sets = [], []
            for t in batch.column("text").to_pylist():
                words = table.of(t or "")
                widths.append(min(n, len(words)))
                sets.append(np.unique(shingles(words, widths[-1])).view(np.int64) if len(words) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "width", "shingles"])

    base = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "item_id long, width int, shingles array<bigint>").where(F.size("shingles") > 0)


class Index:
    """A block of items: size partitions, posted sketches and whole sets."""

    def __init__(self, rows: list, least: float):
        self.least = least
        self.ids = [r["item_id"] for r in rows]
        self.sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
        sizes = np.array([len(s) for s in self.sets])
        self.widths = np.array([r["width"] for r in rows])
        part = np.ceil(np.log2(np.maximum(sizes, K) / K)).astype(int)
        self.smallest = {(w, p): int(sizes[(self.widths == w) & (part == p)].min()) for w, p in set(zip(self.widths.tolist(), part.tolist(), strict=True))}
        self.part = part
        k = np.minimum(sizes, K)
        whole = sizes <= K
        self.need = np.where(whole, np.ceil(least * sizes - 1e-9), np.maximum(1, np.floor(k * (least - 4 * math.sqrt(least * (1 - least) / K)))))
        posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            for v in np.sort(s)[:K].tolist():
                posts[int(self.widths[i])].append((v, i))
        self.posts = {}
        for w, p in posts.items():
            p.sort()
            keys, owner = np.array([x[0] for x in p], np.uint64), np.array([x[1] for x in p])
            mask = np.zeros(1 << BITS, bool)
            mask[keys >> np.uint64(64 - BITS)] = True
            self.posts[w] = keys, owner, mask

    def search(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, shingles found) of the items that the words contain."""
        out = []
        for w, (keys, owner, mask) in self.posts.items():
            own = shingles(words, w)
            hit = np.unique(own[mask[own >> np.uint64(64 - BITS)]])
            lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            lo, hi = lo[lo < hi], hi[lo < hi]
            if not len(lo):
                continue
            counts = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), minlength=len(self.ids))
            own_set = None
            for i in np.flatnonzero((counts >= self.need) & (counts > 0)).tolist():
                if own_set is None:
                    own_set = np.unique(own)
                if len(own_set) < self.least * self.smallest[w, int(self.part[i])]:
                    continue
                found = int(np.isin(self.sets[i], own_set).sum())
                if found >= self.least * len(self.sets[i]) - 1e-9:
                    out.append((i, found))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int, block_shingles: int) -> Iterator[list]:
    """Items in blocks of about ``block_shingles`` shingles, so that what is sent to the executors at once is bounded."""
    known = item_shingles(items, id_col, text_col, n)
    total = known.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["shingles"]))
        if rows:
            yield rows


def _matches(text: Column, rows: list, least: float, spark) -> Column:
    shared = spark.sparkContext.broadcast([(r["item_id"], r["width"], r["shingles"]) for r in rows])

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_found", pa.int64())]))

    @F.arrow_udf("array<struct<item_id:long,n_item:long,n_found:long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index([dict(item_id=i, width=w, shingles=s) for i, w, s in shared.value], least)
        table = WordHashes()
        for texts in batches:
            found = [index.search(table.of(t)) if (t := x.as_py()) else [] for x in texts]
            yield pa.array([[dict(item_id=index.ids[i], n_item=len(index.sets[i]), n_found=f) for i, f in own] for own in found], kind)

    return run(text)


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 5, least: float = 0.8, block_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and test item it contains: doc_id, item_id, n_item, n_found, containment.

    An item is contained when at least ``least`` of its distinct shingles of ``n`` words are in the whole document; words are
    lower-cased letters and digits, so case and punctuation don't hide a leak. Items of fewer words are one shingle; items
    without words and null items are in no document. Items go to the executors in blocks of bounded size, one
    pass over the documents for each block; documents are never shuffled.

    Null and empty texts contain nothing; null ids are kept. Repeated documents and repeated items each give rows. Other columns
    are not read. Empty tables give no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for rows in _blocks(items, item_id, item_text, n, block_shingles):
        some = base.select("doc_id", F.explode(_matches(F.col("text"), rows, least, docs.sparkSession)).alias("m")).select("doc_id", "m.*")
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = base.where("false").selectExpr("doc_id", "0L as item_id", "0L as n_item", "0L as n_found")
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, n: int = 5, least: float = 0.8, block_shingles: int = 2_000_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that contain a test item (see ``find_leaks``)."""
    for rows in _blocks(items, item_id, item_text, n, block_shingles):
        docs = docs.where(F.size(_matches(F.col(text_col), rows, least, docs.sparkSession)) == 0)
    return docs
