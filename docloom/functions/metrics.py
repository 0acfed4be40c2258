"""Scores of one text against another. Word sets and bags are native; word alignment is not expressible and is Arrow-batched, as are n-grams."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import each
from docloom.functions.text import col, words


def _lower(c: str | Column) -> Column:
    return words(F.lower(col(c)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of the lower-cased word sets; 0 if either text is empty."""
    x, y = _lower(a), _lower(b)
    union = F.size(F.array_union(x, y))
    return F.when((F.length(col(a)) == 0) | (F.length(col(b)) == 0) | (union == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def sequence_similarity(a: str | Column, b: str | Column) -> Column:
    """The matching-blocks ratio of ``difflib``, with its shortcut for long texts; 0 if either text is empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y, strict=True)])

    return run(col(a), col(b))


def word_error_rate(reference: str | Column, hypothesis: str | Column) -> Column:
    """Word edits over reference words; an empty reference gives 1, or 0 against an empty hypothesis. Two rows of the table are held."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _wer(p.split(), q.split()) for p, q in zip(x, y, strict=True)])

    return run(F.lower(col(reference)), F.lower(col(hypothesis)))


def _wer(ref: list[str], hyp: list[str]) -> float:
    if not ref:
        return 1.0 if hyp else 0.0
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in ref])
    b = np.array([ids.setdefault(w, len(ids)) for w in hyp], int)
    at = np.arange(len(b) + 1)
    row = at.copy()
    for i, w in enumerate(a, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != w))))
        row = np.minimum.accumulate(best - at) + at
    return float(row[-1]) / len(a)


def extraction_scores(candidate: str | Column, truth: str | Column) -> list[Column]:
    """precision, recall, f1 over word sets, and the sorted words missing from, or extra in, the candidate (100 at most)."""
    x, y = F.array_distinct(_lower(candidate)), F.array_distinct(_lower(truth))
    both = F.size(F.array_intersect(x, y))
    p = F.when(F.size(x) > 0, both / F.size(x)).otherwise(0.0)
    r = F.when(F.size(y) > 0, both / F.size(y)).otherwise(0.0)
    return [
        p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.slice(F.array_sort(F.array_except(y, x)), 1, 100).alias("missing_words"), F.slice(F.array_sort(F.array_except(x, y)), 1, 100).alias("extra_words"),
    ]


def bag_cosine(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, cosine) of the word counts of two columns: explode once, count, and sum products; pairs with an empty text give 0."""
    sides = [pairs.select(F.col(id_col), F.explode(_lower(c)).alias("w"), F.lit(s).alias("side")) for s, c in ((0, a), (1, b))]
    counts = sides[0].unionByName(sides[1]).groupBy(id_col, "w").agg(F.sum(1 - F.col("side")).alias("x"), F.sum("side").alias("y"))
    sums = counts.groupBy(id_col).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    cosine = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).otherwise(0.0)
    return pairs.select(id_col).join(sums.select(id_col, cosine.alias("cosine")), id_col, "left").select(id_col, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def _matches(max_n: int) -> Callable[[dict], list[int]]:
    """Clipped n-gram matches for each n of two texts, given as words with a blank between any two."""

    def one(pair: dict) -> list[int]:
        r, c = (pair[k].split(" ") if pair[k] else [] for k in ("r", "c"))
        out = [0] * max_n
        for n in range(1, max_n + 1):
            x, y = (Counter(zip(*[w[i:] for i in range(n)], strict=False)) for w in (r, c))
            out[n - 1] = sum(min(k, y[g]) for g, k in x.items() if g in y)
            if not out[n - 1]:  # then no longer one matches either
                break
        return out

    return one


def bleu(pairs: DataFrame, id_col: str, reference: str, candidate: str, max_n: int = 4, weights: list[float] | None = None) -> DataFrame:
    """(id, bleu) of every pair: clipped n-gram precisions and brevity penalty, without smoothing, so fewer than ``max_n`` words give 0.

    Words are split natively and their n-grams counted in Python, pair by pair: no n-gram is a row, and none is shuffled.
    """
    weights = weights or [1.0 / max_n] * max_n
    r, c = _lower(reference), _lower(candidate)
    found = each(F.struct(F.array_join(r, " ").alias("r"), F.array_join(c, " ").alias("c")), "array<bigint>", _matches(max_n))
    exact = pairs.select(F.col(id_col), F.size(r).alias("rl"), F.size(c).alias("cl"), found.alias("m"))
    exact = exact.select(id_col, "rl", "cl", *[F.get("m", n - 1).alias(f"m{n}") for n in range(1, max_n + 1)])
    p = [F.col(f"m{n}") / F.greatest(F.col("cl") - n + 1, F.lit(1)) for n in range(1, max_n + 1)]
    none = F.lit(False)
    for x in p:
        none = none | (x <= 0)
    total = F.lit(0.0)
    for w, x in zip(weights, p, strict=True):
        total = total + F.lit(w) * F.log(x)
    penalty = F.when(F.col("cl") >= F.col("rl"), F.lit(1.0)).otherwise(F.exp(1 - F.col("rl") / F.col("cl")))
    return exact.select(id_col, F.when((F.col("cl") == 0) | (F.col("rl") == 0) | none, F.lit(0.0)).otherwise(penalty * F.exp(total)).alias("bleu"))


def similarity(a: str | Column, b: str | Column, method: str = "sequence") -> Column:
    """``sequence`` or ``jaccard``; ``bag_cosine`` is a table operation."""
    if method not in ("sequence", "jaccard"):
        raise ValueError(f"unknown similarity: {method}")
    return {"sequence": sequence_similarity, "jaccard": jaccard}[method](a, b)
