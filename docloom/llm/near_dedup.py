"""MinHash near-dedup by a signature-coordinate inverted join.

Each document's word-shingle set has a signature of ``COORDS`` minima. Documents are posted under their coordinate-value
pairs ("tokens"). A pair at the similarity threshold agrees in at least ``MATCHES`` coordinates but with a probability of about one in a
million, so only tokens that two documents share count, documents with fewer shared tokens are skipped, and of the others
only a prefix is posted: the rarest tokens, so many that two documents with ``MATCHES`` tokens in common meet in one of them.
Candidates count their collisions over whole signatures and are confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, if_small
from docloom.llm.linking import link

COORDS, MATCHES = 64, 36
#: One bit of each coordinate makes a 64-bit sketch; links agree in at least so many bits, but for one in a million.
SKETCH_BITS = 46
_rng = np.random.Generator(np.random.PCG64(20))
_XOR = _rng.integers(0, 1 << 63, COORDS, np.uint64)
_MUL = _rng.integers(0, 1 << 63, COORDS, np.uint64) | np.uint64(1)
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 4096
#: Words whose hashes a Python worker keeps.
KEPT_WORDS = 250_000
#: Bytes of node numbers that may be broadcast to pick out their shingle sets, which are far larger.
NODE_BYTES = 48_000_000
#: Shingles of either block of documents of a large group that a task compares.
BLOCK_SHINGLES = 1_000_000


class ByteWords(dict):
    """Word (bytes) -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) > KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_set(text: str | None, width: int, table: ByteWords) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; a shorter text is one run.

    Words are runs of anything but blanks and U+0009 to U+000D; A to Z are lower-cased (both as ``bytes`` have them).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    size = len(h) - k + 1
    out = np.full(size, 0x9E3779B97F4A7C15 + k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + size]) * _MIX
            out ^= out >> np.uint64(31)
        out *= _MIX2
    return np.unique(out ^ (out >> np.uint64(30)))


def signature(found: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash over the set."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), BLOCK):
            np.minimum(low, ((found[None, i : i + BLOCK] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=low)
    return low


def _sketch(low: np.ndarray) -> int:
    mixed = (low ^ (low >> np.uint64(33))) * _MIX
    return int(np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.int64)[0])


def _sign(width: int):
    def run(batches):
        table = ByteWords()
        for batch in batches:
            n, k1, k2, sig, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width, table)
                n.append(len(found))
                if not len(found):
                    k1.append(0), k2.append(0), bits.append(0), sig.append(None)
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
                low = signature(found)
                with np.errstate(over="ignore"):
                    bits.append(_sketch(low))
                k1.append(a), k2.append(b), sig.append(low.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                ["rid", "doc_id", "th", "n", "k1", "k2", "bits", "sig"])

    return run


def _sets(width: int):
    def run(batches):
        table = ByteWords()
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array([shingle_set(texts[i].as_py(), width, table).tobytes() for i in range(len(texts))], pa.binary())], ["cls", "found"])

    return run


def _meet(percent: int):
    """Blocks of ``one`` rows and of the others: for each of the first, links to one node of every other component that it links to."""

    def run(key, rows):
        one = np.asarray(rows.column("one"))
        node, comp = np.asarray(rows.column("node")), np.asarray(rows.column("comp"))
        sig = np.array(rows.column("sig").to_pylist(), np.int64).reshape(-1, COORDS)
        found = [np.frombuffer(x, np.uint64) for x in rows.column("found").to_pylist()]
        size = np.array([len(x) for x in found])
        others = np.flatnonzero(~one)
        a, b = [], []
        for i in np.flatnonzero(one).tolist():
            own = found[i]
            near = others[(comp[others] != comp[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
            match = (sig[near] == sig[i]).sum(1)
            near, match = near[match >= MATCHES], match[match >= MATCHES]
            near = near[np.lexsort((node[near], -match))]
            while len(near):
                some, near = near[:64], near[64:]
                whole = np.concatenate([found[j] for j in some.tolist()])
                at = np.minimum(np.searchsorted(own, whole), len(own) - 1)
                both = np.add.reduceat((own[at] == whole).astype(np.int64), np.concatenate(([0], np.cumsum(size[some])[:-1])))
                linked = some[100 * both >= percent * (size[some] + len(own) - both)]
                if len(linked):
                    _, first = np.unique(comp[linked], return_index=True)
                    a += [node[i]] * len(first)
                    b += node[linked[first]].tolist()
                    near = near[~np.isin(comp[near], comp[linked])]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``width``-word shingles have a similarity of ``percent`` / 100 or more are linked; component_id is the
    smallest id reachable, and the row with that id is kept. Documents with equal sets are one class, made by a hash
    aggregation, before any pair is made; links between classes are found and confirmed on full sets.

    Texts without words, and null texts, link with nothing. A null id is never a component_id, unless no other id is in the component;
    such rows are kept only then. Rows that repeat a kept id are all kept. Columns besides the two named are not read.
    An empty table gives no rows. ``percent`` must be 80 or more: the signature's constants are set for it.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(base.mapInArrow(_sign(width), "rid long, doc_id long, th long, n long, k1 long, k2 long, bits long, sig array<bigint>"))
    classes = scratch.save(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("cls")))
    heads = signed.join(classes.select(F.col("cls").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cls"), "doc_id", "th", "n", "bits", "sig")

    tokens = heads.select(F.col("cls").alias("node"), F.posexplode("sig")).select("node", F.xxhash64("pos", "col").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    prefix = (
        tokens.join(often, "token").withColumn("_c", F.count(F.lit(1)).over(own)).where(F.col("_c") >= MATCHES)
        .withColumn("_r", F.row_number().over(own.orderBy("df", "token"))).where(F.col("_r") <= F.col("_c") - MATCHES + 1).select("node", "token")
    )
    prefix = scratch.save(prefix)
    nodes = scratch.save(heads.join(prefix.select(F.col("node").alias("cls")).distinct(), "cls", "left_semi"))
    postings = prefix.join(nodes.select(F.col("cls").alias("node"), F.col("n").alias("size"), "bits"), "node")
    # the documents in question grow with the corpus, so they are never broadcast: texts are shuffled once here, whatever the size
    wanted = nodes.select("cls", F.col("doc_id").alias("_d"), F.col("th").alias("_h")).hint("merge")
    texts = base.select("doc_id", "th", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("th").eqNullSafe(F.col("_h"))).select("cls", "text")
    sets = scratch.save(texts.mapInArrow(_sets(width), "cls long, found binary"))
    sigs = nodes.select("cls", "sig")

    def verify(pairs: DataFrame) -> DataFrame:
        seen = (
            pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
            .where(F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= MATCHES).select("a", "b")
        )
        seen = scratch.save(seen)
        ends = scratch.save(seen.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        some = sets.join(if_small(ends, NODE_BYTES), "cls", "left_semi")
        full = seen.join(some.select(F.col("cls").alias("a"), F.col("found").alias("fa")), "a").join(some.select(F.col("cls").alias("b"), F.col("found").alias("fb")), "b")
        return full.select("a", "b", "fa", "fb").mapInArrow(_confirm(percent), "a long, b long").distinct()

    def may_link(sa, ba, sb, bb):
        return (100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)) & (F.bit_count(ba.bitwiseXOR(bb)) <= COORDS - SKETCH_BITS)

    def dense(groups: DataFrame) -> DataFrame:
        outside = F.col("comp") != F.col("main")
        blocks = groups.groupBy("main").agg(F.ceil(F.sum(F.when(outside, F.col("size"))) / BLOCK_SHINGLES).cast("int").alias("bi"), F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("bj")).where("bi > 0")
        dealt = groups.join(blocks, "main")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
        one = dealt.where(outside).select("main", "node", "comp", F.lit(True).alias("one"), of("bi").alias("i"), numbers("bj").alias("j"))
        all_ = dealt.select("main", "node", "comp", F.lit(False).alias("one"), numbers("bi").alias("i"), of("bj").alias("j"))
        named = lambda df: df.withColumnRenamed("cls", "node")
        some = groups.select(F.col("node").alias("cls")).distinct()
        full = one.unionByName(all_).join(named(sigs), "node").join(named(sets.join(if_small(some, NODE_BYTES), "cls", "left_semi")), "node")
        return full.groupBy("main", "i", "j").applyInArrow(_meet(percent), "a long, b long")

    linked = link(spark, scratch, postings, verify, may_link, dense)
    root = classes.join(linked, F.col("cls") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "cls").alias("root"))
    rows = signed.select("doc_id", "n", "k1", "k2").join(root, ["k1", "k2"], "left").withColumn("root", F.when(F.col("n") > 0, F.col("root")))
    rows = scratch.save(rows.select("doc_id", "n", "root"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    scratch.drop_all(rows)
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group (see ``near_duplicates``). Rows with a null id stay."""
    gone = near_duplicates(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_docloom_gone")).where("_docloom_gone is not null").distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == F.col("_docloom_gone"), "left_anti")
