"""Substring dedup by recompression.

A document's words are rewritten in rounds. Each round names runs of equal symbols, then names adjacent pairs whose first
symbol falls on the left and whose second on the right side of that round's random partition of all symbols. A name is a
hash of what it stands for, so the whole corpus shares one naming without a dictionary, and equal substrings get equal
symbols but near their ends. Every symbol carries the stretch of words that its existence depends on (``lo`` to ``hi``); wherever that stretch
occurs, in any document, the symbol occurs.

A window of words can therefore only occur in another document if all symbols whose stretch lies inside it do. One
aggregation of symbol names finds those of several documents; windows without an unshared symbol are candidates, and
the candidates' exact word sequences are compared (by 96 bits of hashes of all words) in a second aggregation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch
from docloom.llm.near_dedup import ByteWords

ROUNDS, LEAST_WORDS = 4, 4
#: Words that are put through one operation together.
BLOCK_WORDS = 100_000
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xA0761D6478BD642F
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 4096), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n <= 1 << 20:
            _powers[base] = found
    return found[:n]


@dataclass
class Symbols:
    """Names in order, with the first word and the word after the last of each, and of what it depends on.

    Words are numbered through all documents; ``doc`` numbers the document.
    """

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray


def recompress(words: np.ndarray, bounds: np.ndarray | None = None, rounds: int = ROUNDS) -> Symbols:
    """The symbols of documents after ``rounds`` rounds. Document i has the words from bounds[i] to bounds[i + 1], one at least.

    What depends on an end of its document has a ``lo`` before the document or a ``hi`` after it.
    """
    bounds = np.array([0, len(words)]) if bounds is None else np.asarray(bounds, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(words), dtype=np.int64)
    name, start, stop, lo, hi = words, at, at + 1, at, at + 1
    with np.errstate(over="ignore"):
        for r in range(rounds):
            m = len(name)
            same = doc[1:] == doc[:-1]
            first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | ~same)))
            last = np.append(first[1:], m) - 1
            count = last - first + 1
            doc = doc[first]
            opens, closes = np.concatenate(([True], doc[1:] != doc[:-1])), np.append(doc[1:] != doc[:-1], True)
            name = np.where(count > 1, _mix((name[first] ^ _C) + count.astype(np.uint64) * _A), name[first])
            # a run depends on its symbols, and on the one symbol at either side that ends it
            before, after = np.where(opens, first, first - 1), np.where(closes, last, last + 1)
            lo, hi = (np.minimum(np.minimum.reduceat(lo, first), np.where(opens, bounds[doc] - 1, lo[before])),
                      np.maximum(np.maximum.reduceat(hi, first), np.where(closes, bounds[doc + 1] + 1, hi[after])))
            start, stop = start[first], stop[last]

            right = (_mix(name + np.uint64(r + 1) * _C) >> np.uint64(63)).astype(bool)
            pair = np.concatenate((~right[:-1] & right[1:] & ~opens[1:], [False]))
            second = np.concatenate(([False], pair[:-1]))
            # a pair depends on both symbols; a left one that stays also on what follows it, a right one on what precedes it
            at = np.arange(len(name))
            before, after = np.where(opens, at, at - 1), np.where(closes, at, at + 1)
            other_lo = np.where(right, np.where(opens, bounds[doc] - 1, lo[before]), lo[after])
            other_hi = np.where(right, hi[before], np.where(closes, bounds[doc + 1] + 1, hi[after]))
            lo, hi = np.minimum(lo, other_lo), np.maximum(hi, other_hi)
            name = np.where(pair, _mix(_mix(name * _A + _C) ^ (name[after] * _B)), name)
            stop = np.where(pair, stop[after], stop)
            keep = ~second
            name, start, stop, lo, hi, doc = name[keep], start[keep], stop[keep], lo[keep], hi[keep], doc[keep]
    return Symbols(name, start, stop, lo, hi, doc)


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of the word sequences of the windows at ``starts``."""
    with np.errstate(over="ignore"):

        def one(values, base, inverse):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _power(base, len(words)), dtype=np.uint64)))
            return _mix((sums[starts + width] - sums[starts]) * _power(inverse, len(words))[starts])

        return one(words, _BASE, _INVERSE), (one(_mix(words ^ _C), _BASE2, _INVERSE2) >> np.uint64(32)).astype(np.uint32)


def open_windows(bounds: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that hold none of the stretches (lo, hi) of their documents ``doc``."""
    change = np.zeros(bounds[-1] + 1, np.int64)
    first, after = np.maximum(hi - width, bounds[doc]), np.minimum(lo, bounds[doc + 1] - width) + 1
    inside = (first < after) & (lo >= bounds[doc]) & (hi <= bounds[doc + 1])
    np.add.at(change, first[inside], 1)
    np.add.at(change, after[inside], -1)
    free = np.cumsum(change[:-1]) == 0
    for k in np.flatnonzero(np.diff(bounds) > 0).tolist():
        free[max(bounds[k], bounds[k + 1] - width + 1) : bounds[k + 1]] = False
    return np.flatnonzero(free)


@dataclass
class Block:
    """Some documents' words, as hashes, and their symbols; ``rows`` says which rows of a batch they are."""

    rows: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    symbols: Symbols
    inner: np.ndarray


def _blocks(texts, width: int, table: ByteWords):
    """Blocks of documents with a window at least, about ``BLOCK_WORDS`` words in each, so that short ones share the cost of an operation."""
    at = 0
    while at < len(texts):
        rows, bounds, words = [], [0], []
        while at < len(texts) and len(words) < BLOCK_WORDS:
            own = (texts[at].as_py() or "").encode("utf-8", "surrogatepass").split()
            if len(own) >= width:
                rows.append(at)
                words += own
                bounds.append(len(words))
            at += 1
        if rows:
            hashed = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
            b = np.array(bounds, np.int64)
            s = recompress(hashed, b)
            whole = (s.stop - s.start >= LEAST_WORDS) & (s.lo >= b[s.doc]) & (s.hi <= b[s.doc + 1]) & (s.hi - s.lo <= width)
            yield Block(np.array(rows), b, hashed, s, whole)


KEYS, NAMES, WINDOWS = "rank long, th long, th2 long", "names array<bigint>", "values array<bigint>, checks array<int>, starts array<int>"


def _lists(owner: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Values in order of their owners 0 to n - 1, as a list for each of them."""
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _windows(block: Block, starts: np.ndarray, width: int) -> list[pa.Array]:
    doc = np.searchsorted(block.bounds, starts, "right") - 1
    value, check = window_hashes(block.words, starts, width)
    return _lists(doc, len(block.rows), value.view(np.int64), check.view(np.int32), (starts - block.bounds[doc]).astype(np.int32))


def _parse(width: int):
    """Of each document: distinct names of the symbols whose stretch a window can hold, and the windows that hold none."""

    def run(batches):
        table = ByteWords()
        for batch in batches:
            for block in _blocks(batch.column("text"), width, table):
                s, k = block.symbols, block.inner
                order = np.lexsort((s.name[k], s.doc[k]))
                name, doc = s.name[k][order], s.doc[k][order]
                new = np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))[: len(name)]
                keys = [batch.column(c).take(pa.array(block.rows)) for c in ("rank", "th", "th2")]
                bare = open_windows(block.bounds, s.doc[k], s.lo[k], s.hi[k], width)
                columns = keys + _lists(doc[new], len(block.rows), name[new].view(np.int64)) + _windows(block, bare, width)
                yield pa.RecordBatch.from_arrays(columns, ["rank", "th", "th2", "names", "values", "checks", "starts"])

    return run


def _candidates(width: int):
    """Windows that hold a symbol's stretch, but none of a symbol that no other text has."""

    def run(batches):
        table = ByteWords()
        for batch in batches:
            shared = batch.column("shared")
            for block in _blocks(batch.column("text"), width, table):
                s, k = block.symbols, block.inner
                known = [np.asarray(shared[int(i)].values).view(np.uint64) for i in block.rows]
                with np.errstate(over="ignore"):
                    tag = lambda name, doc: _mix(name + _mix(doc.astype(np.uint64) * _B + _C))
                    of = tag(np.concatenate(known), np.repeat(np.arange(len(known)), [len(x) for x in known]))
                    own = k & ~np.isin(tag(s.name, s.doc), of)
                open_ = lambda which: open_windows(block.bounds, s.doc[which], s.lo[which], s.hi[which], width)  # noqa: B023, E731
                starts = np.setdiff1d(open_(own), open_(k), assume_unique=True)
                keys = [batch.column(c).take(pa.array(block.rows)) for c in ("rank", "th")]
                yield pa.RecordBatch.from_arrays(keys + _windows(block, starts, width), ["rank", "th", "values", "checks", "starts"])

    return run


def _cut(width: int, digest: bool):
    def run(batches):
        for batch in batches:
            ids, texts, gone = batch.column("doc_id"), batch.column("text"), batch.column("gone")
            n, removed, kept = [], [], []
            for i in range(len(ids)):
                words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if gone[i].is_valid and len(words) >= width:
                    spans = np.asarray(gone[i].values).reshape(-1, 2)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, spans[:, 0], 1)
                    np.add.at(change, np.minimum(spans[:, 1] + width, len(words)), -1)
                    left = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    words = [words[j] for j in left]
                removed.append(n[-1] - len(words))
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _spans(batches):
    """Starts -> the spans of consecutive starts, as first and last in turn."""
    for batch in batches:
        out = []
        for x in batch.column("starts"):
            v = np.unique(np.asarray(x.values))
            cut = np.flatnonzero(np.diff(v) > 1)
            out.append(np.stack([v[np.append(0, cut + 1)], v[np.append(cut, len(v) - 1)]], 1).ravel().astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("th"), pa.array(out, pa.list_(pa.int64()))], ["rank", "th", "gone"])


#: The last start of a span that covers a whole document.
WHOLE = 1 << 40


def repeated_windows(base: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(rank, th, gone): first and last starts of windows of ``width`` words that also start in a document of a smaller rank.

    ``base`` has rank (the id), th and th2 (hashes of the text) and text. Of equal texts all but the first are repeats from end to end;
    they are told by their hashes, and a symbol only counts as shared when different texts have it.
    """
    parsed = scratch.save(base.mapInArrow(_parse(width), f"{KEYS}, {NAMES}, {WINDOWS}"))
    copies = parsed.groupBy("th", "th2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("th", "th2", "first")
    spare = parsed.select("rank", "th", "th2").join(copies, ["th", "th2"]).where("rank > first").select("rank", "th").distinct()
    spare = scratch.save(spare.withColumn("gone", F.array(F.lit(0), F.lit(WHOLE)).cast("array<bigint>")))

    named = parsed.select("rank", "th", F.explode("names").alias("name"))
    several = named.groupBy("name").agg(F.min("th").alias("first"), F.max("th").alias("last")).where("first < last").select("name")
    several = scratch.save(several)
    shared = named.join(several, "name").join(spare.drop("gone"), ["rank", "th"], "left_anti").groupBy("rank", "th").agg(F.collect_list("name").alias("shared"))
    shared = scratch.save(shared)
    found = scratch.save(base.join(shared.hint("merge"), ["rank", "th"]).select("rank", "th", "text", "shared").mapInArrow(_candidates(width), f"rank long, th long, {WINDOWS}"))
    scratch.drop(several, shared)
    lists = parsed.select("rank", "th", "values", "checks", "starts").where(F.size("values") > 0).unionByName(found)
    windows = lists.select("rank", "th", "checks", "starts", F.posexplode("values").alias("_at", "value")).select("rank", "th", "value", F.get("checks", "_at").alias("check"), F.get("starts", "_at").alias("start"))
    earliest = scratch.save(windows.groupBy("value", "check").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("value", "check", "first"))
    starts = windows.join(earliest, ["value", "check"]).where(F.col("first") < F.col("rank")).groupBy("rank", "th").agg(F.collect_list("start").alias("starts"))
    gone = scratch.save(starts.mapInArrow(_spans, "rank long, th long, gone array<bigint>"))
    gone = scratch.save(gone.join(spare.drop("gone"), ["rank", "th"], "left_anti").unionByName(spare))
    scratch.drop_all(gone)
    return gone


def _cut_all(docs: DataFrame, width: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("th2"), "text")
    gone = repeated_windows(base.select("rank", "th", "th2", "text"), scratch, width)
    # what is to go grows with the corpus, so it is never broadcast: texts are shuffled once here, whatever the size
    joined = base.join(gone.hint("merge"), ["rank", "th"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_cut(width, digest), "doc_id long, n_words long, n_removed long, kept string")


def cut_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the text of the words that stay, joined by blanks."""
    return _cut_all(docs, width, id_col, text_col, False)


def repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks).

    A word goes if a window of ``width`` consecutive words covers it whose word sequence also starts in a document with a
    smaller id. Words are runs of anything but blanks and U+0009 to U+000D, unchanged; windows are those of the input.

    Nulls: a null text has no words; a null id counts as larger than any other, and null ids as equal. Documents of fewer
    words than a window lose nothing. Rows that repeat id and text are treated alike. Of equal texts under different ids, the
    smallest id keeps what no other text has. Columns besides the two named are not
    read. An empty table gives no rows.
    """
    return _cut_all(docs, width, id_col, text_col, True).withColumnRenamed("kept", "kept_sha256")
