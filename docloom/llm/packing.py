"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEQUENCES = PIECES + ", sequence_id long, offset long"
#: Bytes of words and ids that a Python worker keeps; the table is emptied when they are reached.
KEPT_BYTES = 100_000_000
#: Fixed value: the tokenizer's own pattern, for lower-cased text.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of no higher characters are put through the pattern here: their composed forms and classes are the same everywhere.
_LATIN = "\u024f"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


_LETTERS = str.maketrans({b: c for b, c in enumerate(_byte_letters())})


class WordIds(dict):
    """Blank-separated word -> its ids as little-endian 32-bit bytes.

    The tokenizer drops white space, and no rule of it reaches across, so a text's ids are those of its words in
    order; each distinct word is encoded once. Printable Latin words go to the tokenizer's model piece by piece, all others
    through its whole chain. Long words are not kept, and the table is emptied when it is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        if word.isprintable() and "<|" not in word and max(word) <= _LATIN:
            low = word.lower()
            found = []
            for piece in (low,) if low.isalpha() else _PATTERN.findall(low):
                data = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
                found += [t.id for t in self.model.tokenize(data)]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if self.held > KEPT_BYTES:
                self.clear()
                self[""], self.held = b"", 0
            self[word] = ids
            self.held += 180 + 2 * len(word) + len(ids)
        return ids

    def of(self, text: str) -> bytes:
        # the tokenizer lower-cases, so an ASCII text may be before it is split: fewer distinct words
        text = text.lower() if text.isascii() and "<|" not in text else text
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table per worker process, kept between its tasks."""
    return WordIds(path)


def _pieces(tokenizer_path: str, end_id: int, size: int):
    def run(batches):
        table = word_ids(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column("text")
            rows: list[list[int]] = [[], [], [], [], [], []]
            for at, (row, doc) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                data = table.of(texts[at].as_py() or "") + end
                n = len(data) // 4
                for s in range(0, n, size):
                    k = min(size, n - s)
                    for col, v in zip(rows, (row, doc, s, k, zlib.crc32(data[4 * s : 4 * (s + k)]), n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class FirstFit:
    """Open bins under a tournament tree: each inner node holds the larger free space of its two halves."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """The lowest bin with room, and its free space before."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        free = tree[i]
        tree[i] = free - need
        leaf = i
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return leaf - self.leaves, free


def _pack(size: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        tree = FirstFit(len(pieces), size)
        placed = [tree.place(n) for n in pieces["length"].tolist()]
        return pieces.assign(
            sequence_id=[(int(key[0]) << 32) + b for b, _ in placed], offset=[size - free for _, free in placed]
        )[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, group_docs: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (and ``end_id``) are cut at multiples of ``size``; the pieces of about ``group_docs`` documents,
    grouped by a hash of their place and id, are packed first-fit decreasing into sequences of ``size``. A group's memory has a fixed
    bound on average, and groups are independent, so packing scales with their number. Token ids do not travel.

    Nulls: a null text is empty and gives one piece with ``end_id`` alone; a null id is kept. Repeated rows are each packed.
    Ties in length go by id, then start. Columns besides the two named are not read. An empty table gives no rows.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, -(-base.select("doc_id").count() // group_docs))
    pieces = base.mapInArrow(_pieces(tokenizer_path, end_id, size), "row long, " + PIECES)
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("row", "doc_id"), F.lit(groups))).drop("row")
    return grouped.groupBy("_group").applyInPandas(_pack(size), SEQUENCES)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, doc_id, offset, ids): the pieces of ``packed`` with their token ids, for writers. Ids must be unique."""

    def run(batches):
        table = word_ids(tokenizer_path)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                data = table.of(r["text"] or "") + end_id.to_bytes(4, "little")
                ids = memoryview(data).cast("I")
                out += [dict(sequence_id=p["sequence_id"], doc_id=r["doc_id"], offset=p["offset"], ids=ids[p["start"] : p["start"] + p["length"]].tolist()) for p in r["pieces"]]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("sequence_id", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    per_doc = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["doc_id"])).select(base["doc_id"], "text", "pieces").mapInArrow(
        run, "sequence_id long, doc_id long, offset long, ids array<int>")
