"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each permuted by its
place; a document is the sum of its n-grams (a bundle), and so is a language. Documents and languages are compared by
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 3
SPAN = 0x110000
SEGMENT, TABLE = 200_000, 40_000
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(SPAN)), bool, SPAN)
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of lower-cased letters; anything else is a gap of one blank, also at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_is_letter()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < N:
        return codes[:0]
    return (codes[:-2] * SPAN + codes[1:-1]) * SPAN + codes[2:]


class Vectors:
    """n-gram -> vector, made on demand from the letters' seeded vectors; the table is emptied when full."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((TABLE, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= 20_000:
                self.letters.clear()
            self.letters[code] = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[code]

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) > TABLE // 2:
            return np.concatenate([self.of(grams[: len(grams) // 2]), self.of(grams[len(grams) // 2 :])])
        if len(self.rows) + len(grams) > TABLE:
            self.rows.clear()
        at = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            row = self.rows.get(g)
            if row is None:
                row = self.rows[g] = len(self.rows)
                a, b, c = g // SPAN // SPAN, g // SPAN % SPAN, g % SPAN
                self.table[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            at[i] = row
        return self.table[at].astype(np.float32)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, all zero where it has no letter. Whole texts, in segments that share no n-gram."""
        out = np.zeros((len(texts), self.dim))
        docs: list[int] = []
        grams: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            if held:
                seen, inverse = np.unique(np.concatenate(grams), return_inverse=True)
                who = np.repeat(np.arange(len(docs)), [len(g) for g in grams])
                for lo in range(0, len(seen), 8192):
                    part = (inverse >= lo) & (inverse < lo + 8192)
                    k = min(8192, len(seen) - lo)
                    counts = np.bincount(who[part] * k + inverse[part] - lo, minlength=len(docs) * k).reshape(len(docs), k).astype(np.float32)
                    np.add.at(out, docs, counts @ self.of(seen[lo : lo + k]))
            docs.clear()
            grams.clear()

        for i, text in enumerate(texts):
            codes = ngrams(text) if text else np.empty(0, np.int64)
            codes = codes[codes != (32 * SPAN + 32) * SPAN + 32]
            for s in range(0, len(codes), SEGMENT):
                docs.append(i)
                grams.append(codes[s : s + SEGMENT])
                held += len(grams[-1])
                if held >= SEGMENT or len(docs) >= 64:
                    flush()
                    held = 0
        flush()
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x, dtype=float), where=norm > 0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, seed: int = 7) -> dict[str, list[float]]:
    """Language -> prototype: the sum of its documents' unit vectors. Partial sums of each partition come to the driver."""

    def run(batches):
        vectors, sums = Vectors(dim, seed), {}
        for batch in batches:
            unit = _unit(vectors.bundle(batch.column("text").to_pylist()))
            for lang, row in zip(batch.column("lang").to_pylist(), unit, strict=True):
                sums[lang] = sums.get(lang, 0) + row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").mapInArrow(run, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["v"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    return {k: v.tolist() for k, v in sorted(total.items()) if np.any(v)}


def language(text: Column, prototypes: dict[str, list[float]], seed: int = 7, sharpness: float = 40.0) -> Column:
    """Struct (lang_pred, score): the language of the nearest prototype and a softmax of the cosines.

    Null texts and texts without a letter, or an empty model, give ``und`` and 0. Ties go to the first name.
    """
    names = list(prototypes)
    matrix = _unit(np.array([prototypes[k] for k in names])) if names else np.zeros((0, 1))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: "Iterator[pd.Series]") -> "Iterator[pd.DataFrame]":
        vectors = Vectors(matrix.shape[1], seed) if names else None
        for texts in batches:
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if names:
                bundled = vectors.bundle(texts.tolist())
                cosine = _unit(bundled) @ matrix.T
                best = cosine.argmax(1)
                odds = np.exp(sharpness * (cosine - cosine.max(1, keepdims=True)))
                for i in np.flatnonzero(bundled.any(1)):
                    lang[i], score[i] = names[best[i]], float(odds[i, best[i]] / odds[i].sum())
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(text)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == remainder


def sample(df: DataFrame, keys: list[str], about: int) -> DataFrame:
    """About ``about`` rows, chosen by a hash of ``keys``: the same on every run and for every layout."""
    n = df.count()
    share = min(1.0, about / n) if n else 1.0
    return df.where(F.pmod(F.xxhash64(F.lit("fit"), *keys), F.lit(1 << 20)) < int(share * (1 << 20)))


def identify(docs: DataFrame, fit_rows: int = 6000, dim: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The prototypes come from about ``fit_rows`` labelled documents outside the held-out fold, chosen by a hash of the
    id and text; every whole text is scored. Null and letterless texts give ``und`` and 0; null labels are not learned; a null id is
    kept and is not held out. Repeated rows are each returned. Other columns are not read. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = base.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    model = fit(sample(labelled, ["doc_id", "text"], fit_rows), dim=dim)
    return base.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), language(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
