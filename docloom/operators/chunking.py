"""Chunkers: a text column -> an array of chunks, or a document table -> one row per chunk.

Chunks are structs (index, start_char, end_char, content); ``content`` is stripped, offsets are those before stripping.
Null and empty texts give no chunks. The sliding chunker is native; the others depend on what came before and run as Arrow-batched functions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby, pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import each
from docloom.functions.text import NOT_WS, col, strip

CHUNK = "array<struct<index:int,start_char:int,end_char:int,content:string>>"
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_AFTER_STOP = r"(?<=[.!?])\s+(?=[가-힣A-Z])"
SENTENCE_END = re.compile(rf"{_AFTER_STOP}|(?<=[.!?])\s*\n|(?<=\n)\n+")
PLAIN_SENTENCE_END = re.compile(rf"{_AFTER_STOP}|(?<=\n)\n+")
Chunk = tuple[int, int, int, str]


def check_sizes(size: int, overlap: int, least: int = 0) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    if least > size:
        raise ValueError("the least size must not exceed the chunk size")


def fixed_chunks(text: str, size: int, overlap: int) -> Iterator[Chunk]:
    """Windows that rather end after a blank in their second half. The last end may lie beyond the text."""
    at, index, before = 0, 0, None
    while at < len(text):
        end = at + size
        if end < len(text) and (blank := text.rfind(" ", at, end)) > at + size // 2:
            end = blank + 1
        piece = text[at:end]
        if piece.strip():
            yield index, at, end, piece.strip()
            index, before = index + 1, at
        at = end - overlap
        if before is None or at <= before:
            at = end


def token_chunks(text: str, size: int, overlap: int, encode: Callable[[str], list], decode: Callable[[list], str]) -> Iterator[Chunk]:
    """Windows of tokens; positions are lengths of decoded prefixes."""
    tokens = encode(text)
    if len(tokens) <= size:
        yield 0, 0, len(text), text.strip()
        return
    index = prefix = done = 0
    for first in range(0, len(tokens), size - overlap):
        prefix, done = prefix + len(decode(tokens[done:first])), first
        piece = decode(tokens[first : first + size])
        if piece.strip():
            yield index, prefix, prefix + len(piece), piece.strip()
            index += 1
        if first + size >= len(tokens):
            return


def _gather(parts: list[str], joint: str, size: int, overlap: int, least: int, most: int | None, shift: bool) -> Iterator[Chunk]:
    """Parts in order, as many as fit, joined. ``shift``: with overlap, a chunk starts before the parts it repeats.

    Every chunk is a slice of the joined text, so only part numbers are decided, each from the running lengths by bisection.
    """
    ends = list(accumulate(len(p) + len(joint) for p in parts))
    starts = [0, *ends]
    whole, stops = joint.join(parts), [e - len(joint) for e in ends]
    first = new = index = 0
    while new < len(parts):
        fits = bisect_right(stops, starts[first] + size)
        after = min(max(new + 1, first + least, min(fits, first + most) if most else fits), len(parts))
        content = whole[starts[first] : stops[after - 1]]
        at = starts[first if shift else new]
        yield index, at, at + len(content), content.strip()
        first, new, index = (after - overlap if 0 < overlap < after - first else after), after, index + 1


def _parts(pattern: re.Pattern, text: str) -> list[str]:
    return [x.strip() for x in pattern.split(text) if x and x.strip()]


def sentence_chunks(text: str, size: int, overlap: int = 0, least: int = 1, most: int | None = None) -> Iterator[Chunk]:
    """Whole sentences up to ``size``; ``overlap`` counts sentences. Offsets are those in the joined text."""
    return _gather(_parts(SENTENCE_END, text), " ", size, overlap, least, most, True)


_PARAGRAPH_END = re.compile(r"\n\s*\n")


def paragraph_chunks(text: str, size: int, overlap: int = 0, least: int = 1) -> Iterator[Chunk]:
    """Whole paragraphs up to ``size``; ``overlap`` counts paragraphs."""
    return _gather(_parts(_PARAGRAPH_END, text), "\n\n", size, overlap, least, None, False)


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, keep: bool = True, length: Callable[[str], int] = len) -> list[str]:
    """Pieces between the coarsest separator present, packed up to ``size``; larger ones are split by the finer separators.

    A chunk may exceed ``size`` by what it repeats of the one before it. All results are slices of the text, so a level works on
    the borders between its pieces: stretches of pieces that fit are packed, pieces between stretches go one level down.
    """
    if not text:
        return []
    if length(text) <= size:
        return [text]
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators))
    mark, finer = (separators[level], separators[level + 1 :]) if level < len(separators) else (separators[-1], ())
    borders = list(range(len(text) + 1)) if not mark else [0, *(m.end() for m in re.finditer(re.escape(mark), text))]
    cut = 0 if keep or not mark else len(mark)
    pieces = list(pairwise(borders)) if not mark else [(a, b - cut) for a, b in pairwise(borders)]
    if mark and (borders[-1] < len(text) or not keep):
        pieces.append((borders[-1], len(text)))
    weights = [length(text[a:b]) for a, b in pieces]
    out: list[str] = []
    for fitting, group in groupby(range(len(pieces)), key=lambda i: weights[i] <= size):
        numbers = list(group)
        if fitting:
            out += _packed(text, pieces, weights, numbers[0], numbers[-1] + 1, size, overlap, length(mark), length)
            continue
        for i in numbers:
            one = text[slice(*pieces[i])]
            out += recursive_pieces(one, size, overlap, finer, keep, length) if finer and mark else [one[x : x + size] for x in _strides(len(one), size, overlap)]
    return out


def _strides(n: int, size: int, overlap: int) -> range:
    """Starts of windows of ``size``, up to the first that reaches the end."""
    step = size - overlap
    return range(0, max(1, -(-(n - overlap) // step)) * step, step)


def _packed(text: str, pieces: list[tuple[int, int]], weights: list[int], first: int, stop: int, size: int, overlap: int, gap: int, length: Callable[[str], int]) -> Iterator[str]:
    """Pieces ``first`` to ``stop`` in as few slices as greedy packing gives; ``gap`` counts between any two of a slice."""
    load = list(accumulate((weights[i] + gap for i in range(first, stop)), initial=0))
    span = lambda a, b: text[pieces[a][0] : pieces[b - 1][1]]
    new, repeated = first, 0
    while new < stop:
        base = length(span(new - repeated, new)) + gap if repeated else 0
        after = max(new + 1, first + bisect_right(load, size + gap - base + load[new - first]) - 1)
        yield span(new - repeated, after)
        back = range(new - repeated, after)
        repeated = after - back[bisect_left(back, True, key=lambda i: length(span(i, after)) <= overlap)] if overlap > 0 and length(span(after - 1, after)) <= overlap else 0
        new = after


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, keep: bool = True, length: Callable[[str], int] = len) -> Iterator[Chunk]:
    """Indices count blank pieces too, which give no chunk."""
    at = 0
    for index, piece in enumerate(recursive_pieces(text, size, overlap, separators, keep, length)):
        if piece.strip():
            found = text.find(piece, at)
            start = at if found < 0 else found
            yield index, start, start + len(piece), piece.strip()
            at = start + 1


def semantic_chunks(text: str, size: int, embed: Callable[[list[str]], list] | None = None, threshold: float = 0.5, buffer: int = 1) -> Iterator[Chunk]:
    """Breaks between sentences whose neighbourhoods' mean vectors are less similar than ``threshold``; without vectors, after each ``size`` characters."""
    sentences = _parts(PLAIN_SENTENCE_END, text)
    if len(sentences) <= 1:
        yield 0, 0, len(text), text.strip()
        return
    breaks, length = [], 0
    if embed:
        vectors = np.asarray(embed(sentences), float)
        for i in range(1, len(sentences)):
            a, b = vectors[max(0, i - buffer) : i].mean(0), vectors[i : i + buffer].mean(0)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            if (a @ b / norm if norm else 0.0) < threshold:
                breaks.append(i)
    else:
        for i, s in enumerate(sentences, 1):
            length += len(s)
            if length >= size:
                breaks.append(i)
                length = 0
    at = 0
    edges = [0, *breaks, len(sentences)]
    for index, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        whole = " ".join(sentences[a:b])
        found = text.find(sentences[a], at) if a < b else at
        start = at if found < 0 else found
        if whole.strip():
            yield index, start, start + len(whole), whole.strip()
        at = start + len(whole)


def _chunk_rows(chunks: Iterator[Chunk]) -> list[dict]:
    return [dict(index=i, start_char=s, end_char=e, content=t) for i, s, e, t in chunks]


def _chunker(c: str | Column, one: Callable[[str], Iterator[Chunk]]) -> Column:
    return each(col(c), CHUNK, lambda x: _chunk_rows(one(x)) if x else [])


def fixed(c: str | Column, size: int = 1000, overlap: int = 200, least: int = 100) -> Column:
    check_sizes(size, overlap, least)
    return _chunker(c, lambda t: fixed_chunks(t, size, overlap))


def token(c: str | Column, size: int = 500, overlap: int = 50, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of a tiktoken vocabulary file (``pattern`` splits words before merging); without one, runs of blanks and of anything else."""
    check_sizes(size, overlap)

    def tools():
        if not vocabulary:
            return re.compile(r"\s+|\S+").findall, "".join
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=pattern or r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})
        return e.encode_ordinary, e.decode

    held: list = []  # a worker makes its own: vocabularies are not sent

    def one(text: str) -> Iterator[Chunk]:
        if not held:
            held.extend(tools())
        return token_chunks(text, size, overlap, *held)

    return _chunker(c, one)


def sentence(c: str | Column, size: int = 1000, overlap: int = 0, least_sentences: int = 1, most_sentences: int | None = None) -> Column:
    return _chunker(c, lambda t: sentence_chunks(t, size, overlap, least_sentences, most_sentences))


def paragraph(c: str | Column, size: int = 2000, overlap: int = 0, least_paragraphs: int = 1) -> Column:
    return _chunker(c, lambda t: paragraph_chunks(t, size, overlap, least_paragraphs))


def recursive(c: str | Column, size: int = 1000, overlap: int = 200, least: int = 100, separators: tuple[str, ...] = SEPARATORS, keep_separator: bool = True, length: Callable[[str], int] = len) -> Column:
    check_sizes(size, overlap, least)
    return _chunker(c, lambda t: recursive_chunks(t, size, overlap, tuple(separators), keep_separator, length))


def semantic(c: str | Column, embed: Callable[[list[str]], list] | None = None, threshold: float = 0.5, least: int = 100, size: int = 2000, buffer: int = 1) -> Column:
    check_sizes(size, 0, least)
    return _chunker(c, lambda t: semantic_chunks(t, size, embed, threshold, buffer))


def sliding(c: str | Column, window: int = 1000, step: int = 500) -> Column:
    """Windows at 0, step, 2 step ... until one reaches the end; native. Blank windows take no index."""
    check_sizes(window, window - step)
    if not 0 < step <= window:
        raise ValueError("step must be from 1 to the window size")
    n = F.length(col(c))
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(step)).cast("int")) * step

    def windows(wide: Column) -> Column:
        # four bytes for every character, so that a window is found without a scan of what precedes it
        return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(
            s.alias("start_char"), F.least(s + window, n).alias("end_char"), F.decode(F.substring(wide, 4 * s + 1, F.lit(4 * window)), "UTF-32").alias("raw")))

    spans = F.get(F.transform(F.array(F.encode(col(c), "UTF-32")), windows), 0)
    full = F.filter(spans, lambda x: x["raw"].rlike(NOT_WS))
    chunks = F.transform(full, lambda x, i: F.struct(i.alias("index"), x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), strip(x["raw"]).alias("content")))
    return F.when(n > 0, chunks).otherwise(F.array().cast(CHUNK))


STRATEGIES = {"fixed": fixed, "token": token, "sentence": sentence, "paragraph": paragraph, "recursive": recursive, "semantic": semantic, "sliding": sliding}


def chunk_table(docs: DataFrame, chunks: Column, *keep: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """One row per chunk: the columns ``keep``, then index, start_char, end_char, content, length (and metadata)."""
    out = docs.select(*keep, F.explode(chunks).alias("_chunk")).select(*keep, "_chunk.*").withColumn("length", F.length("content"))
    if metadata:
        out = out.withColumn("metadata", F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]))
    return out


def semantic_breaks(sentences: DataFrame, group: str, order: str, vector: str, threshold: float = 0.5, buffer: int = 1) -> DataFrame:
    """Segment numbers for sentences that carry vectors: a window over the neighbours instead of a call per text.

    ``sentences`` has one row per sentence; a row starts a new segment when the mean vectors of the ``buffer`` rows before it and
    from it on have a cosine below ``threshold``.
    """
    from pyspark.sql import Window

    from docloom.functions.vector import cosine_similarity

    w = Window.partitionBy(group).orderBy(order)
    mean = lambda rows: F.transform(
        F.aggregate(rows, F.transform(F.get(rows, 0), lambda _: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double"))),
        lambda x: x / F.size(rows))
    near = sentences.withColumn("_before", F.collect_list(vector).over(w.rowsBetween(-buffer, -1))).withColumn("_after", F.collect_list(vector).over(w.rowsBetween(0, buffer - 1)))
    cut = F.when(F.size("_before") == 0, False).otherwise(cosine_similarity(mean(F.col("_before")), mean(F.col("_after"))) < threshold)
    return near.withColumn("_cut", cut.cast("int")).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_before", "_after", "_cut")
