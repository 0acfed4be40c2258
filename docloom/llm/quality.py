"""Compression classifier: two zstandard dictionaries, one from good and one from bad labelled text.

A block of text is compressed with either; the size difference over the block's length says which kind of text it is
like. A logistic curve over a document's normalised differences calibrates them to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.language_id import held_out

BLOCK = 1024


@dataclass
class Model:
    """Two dictionaries and the curve: centre, scale and weights (the last is the constant)."""

    good: bytes
    bad: bytes
    centre: list[float]
    scale: list[float]
    weights: list[float]


class Compressors:
    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        def one(data: bytes):
            kept = zstandard.ZstdCompressionDict(data)
            kept.precompute_compress(level)
            return zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = one(good), one(bad)

    def features(self, text: str | None) -> list[float]:
        """Mean and least normalised difference, and mean and least ratio under the good dictionary, over all blocks."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return [0.0, 0.0, 1.0, 1.0]
        good, bad, n = [], [], []
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            good.append(len(self.good.compress(block)))
            bad.append(len(self.bad.compress(block)))
            n.append(len(block))
        g, b, n = np.array(good, float), np.array(bad, float), np.array(n, float)
        whole = n >= min(BLOCK, n.max()) / 2
        return [(b.sum() - g.sum()) / n.sum(), ((b - g) / n)[whole].min(), g.sum() / n.sum(), (g / n)[whole].min()]


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few for training, the samples themselves."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\n"


def fit(labelled: DataFrame, max_rows: int = 4000, max_blocks: int = 8, dict_size: int = 65536, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> Model | None:
    """Learns from (id, text, label 0/1); None without labels of both kinds.

    Bounds: the caller passes at most ``max_rows`` rows; ``max_blocks`` blocks of 2 kB per text, spread over the text, come to
    the driver for the dictionaries. Dictionaries learn from one half of the rows, by a hash of the id; the curve is
    fitted on whole texts of the other half, whose features are made on the executors.
    """
    half = F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)) == 0
    base = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), half.alias("half")).where("text is not null and label in (0, 1)")

    def blocks(batches):
        for batch in batches:
            out, label, ids = [], [], []
            for i, t, y in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                starts = range(0, len(data), 2048)
                for s in list(starts)[:: max(1, -(-len(starts) // max_blocks))]:
                    out.append(data[s : s + 2048])
                    label.append(y)
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(out, pa.binary())], ["i", "label", "block"])

    rows = sorted(base.where("half").select(F.col("i").cast("long").alias("i"), "text", "label").mapInArrow(blocks, "i long, label int, block binary").collect(), key=lambda r: (r["i"] is None, r["i"], bytes(r["block"])))
    samples = {y: [bytes(r["block"]) for r in rows if r["label"] == y and r["block"]] for y in (0, 1)}
    if not samples[0] or not samples[1]:
        return None
    good, bad = _train(samples[1], dict_size), _train(samples[0], dict_size)

    def features(batches):
        tool = Compressors(good, bad)
        for batch in batches:
            f = [tool.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(f, pa.list_(pa.float64()))], ["label", "f"])

    rows = base.where("not half").select("text", "label").mapInArrow(features, "label int, f array<double>").collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["label"], r["f"]))
    return Model(good, bad, *_curve(np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows], float)))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression with a small ridge, by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pull = ridge * np.diag([1.0] * (z.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre.tolist(), scale.tolist(), w.tolist()


def score(text: Column, model: Model | None, prior: float = 1.0) -> Column:
    """Probability of label 1, 0 to 1, from the text alone. Null and empty texts score as a text without evidence.

    Without a model every text scores ``prior``.
    """
    if model is None:
        return F.lit(float(prior))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Compressors(model.good, model.bad)
        centre, scale, w = np.array(model.centre), np.array(model.scale), np.array(model.weights)
        for texts in batches:
            f = np.array([tool.features(t) if (t := x.as_py()) else model.centre for x in texts]).reshape(-1, len(centre))
            yield pa.array(1 / (1 + np.exp(-np.clip((f - centre) / scale @ w[:-1] + w[-1], -30, 30))))

    return run(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled ids outside the held-out fold, chosen by a hash of the id.

    Ids without a label or with both labels are left out; of an id that documents repeat, the text that comes first counts.
    The chosen ids have that fixed bound, so they are broadcast.
    """
    ids = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("label")).where(F.col("i").isNotNull() & F.col("label").isin(0, 1))
        .where(~held_out("i", 5, 0)).groupBy("i").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most")
        .select("i", "label").orderBy(F.xxhash64(F.lit("quality"), "i"), "i").limit(max_rows)
    )
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.join(F.broadcast(ids), base["doc_id"] == ids["i"]).groupBy("doc_id", F.col("label").alias("quality")).agg(F.min("text").alias("text"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    Nulls: a null id is kept; null and empty texts get the score of a text without evidence. Repeated rows are each scored.
    Columns besides the two named are not read. An empty table gives no rows; without labels every score is 1.
    """
    model = fit(labelled_sample(docs, labels, max_rows, id_col, text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score(F.col("text"), model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
