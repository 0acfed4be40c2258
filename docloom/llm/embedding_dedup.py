"""Embedding near-dedup by collision-counting projections.

Each round sorts the vectors along projections of its own: the sides of ``bits`` of them make a cell, and along one more a pair
collides if one vector lies in the window centred on the other. The number of rounds in which a pair collides is
counted; pairs that reach a count calibrated for recall at the threshold are verified by their cosine. Sides and projections follow from the
vector alone, so a task that meets a pair in one round knows its collisions in all rounds: it counts the pair only in
the first round that brings it together, and no pair ever leaves a task. In a task the cosines of a block are one matrix product,
which is cheaper than counting, so pairs clearly below the threshold are put aside before their collisions are counted.

A window of one projection alone holds most of all vectors at a cosine of 0.9 (in 64 dimensions 62 % of them), and so nearly every pair
would collide in most rounds; that is why a round's window is taken within a cell of further projections.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Scratch, connected_components

COUNT, CELL, BLOCK = 2, 64, 1500


def plan_rounds(n: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, rounds): cells of about ``CELL`` vectors, and rounds for ``COUNT`` collisions at the threshold with this recall."""
    bits = max(1, round(math.log2(max(n, 2) / CELL)))
    p = (1 - math.acos(least) / math.pi) ** bits * math.erf(2 / math.sqrt(2))
    rounds = COUNT
    while sum(math.comb(rounds, k) * p**k * (1 - p) ** (rounds - k) for k in range(COUNT)) > 1 - recall:
        rounds += 1
    return bits, rounds


class Projections:
    """Unit directions of every round: ``bits`` for the cell, the last for the window.

    The sides meet at the origin, so whether a pair is parted depends on its angle alone and not on where the other vectors lie.
    """

    def __init__(self, dim: int, bits: int, rounds: int, least: float, seed: int = 11):
        g = np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, rounds * (bits + 1)))
        self.directions = g / np.linalg.norm(g, axis=0)
        self.bits, self.rounds = bits, rounds
        self.half_width = 2 * math.sqrt(2 - 2 * least) / math.sqrt(dim)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every round, and place along its window's direction."""
        at = (units @ self.directions).reshape(len(units), self.rounds, self.bits + 1)
        side = at[:, :, :-1] > 0
        return side @ (np.int64(1) << np.arange(self.bits, dtype=np.int64)), at[:, :, -1]


def _units(vectors: pd.Series) -> np.ndarray:
    """Vectors of length 1; the largest component is scaled away first, so that no square over- or underflows."""
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=8)
def projections(dim: int, bits: int, rounds: int, least: float) -> Projections:
    return Projections(dim, bits, rounds, least)


def _meet(bits: int, rounds: int, least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, r, i, j = int(key[0]), int(key[1]), int(key[3]), int(key[4])
        model = projections(dim, bits, rounds, least)
        rows = rows.sort_values("vec")
        units, vec, weight = _units(rows["embedding"]), rows["vec"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
        cell, place = model.of(units)
        home = rows["block"].to_numpy() == i
        a = np.flatnonzero(home)
        b = a if i == j else np.flatnonzero(~home)
        x, y = [], []
        for k in range(0, len(a), 256):
            u, v = np.nonzero(units[a[k : k + 256]] @ units[b].T >= least - 1e-9)
            x.append(a[k : k + 256][u])
            y.append(b[v])
        x, y = np.concatenate(x or [a[:0]]), np.concatenate(y or [b[:0]])
        if i == j:
            x, y = x[x < y], y[x < y]
        counts, own = np.zeros(len(x), np.int16), np.ones(len(x), bool)
        for q in range(model.rounds):
            met = (cell[x, q] == cell[y, q]) & (np.abs(place[x, q] - place[y, q]) <= model.half_width)
            counts += met
            own &= ~met if q < r else met if q == r else True
        own &= counts >= COUNT
        x, y = x[own], y[own]
        linked = np.concatenate([np.einsum("ij,ij->i", units[x[s : s + 65536]], units[y[s : s + 65536]]) >= least for s in range(0, len(x), 65536)] or [np.empty(0, bool)])
        x, y = x[linked], y[linked]
        links = np.zeros(len(vec), np.int64)
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        root = np.arange(len(vec))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = links > 0
        return pd.DataFrame({"vec": vec[hit], "links": links[hit], "root": vec[root][hit]})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of ``least`` or more (in double precision) are linked if they collide often enough, which pairs at the threshold do
    with a probability of ``recall`` and nearer ones almost surely; no pair below it is linked. Equal vectors are one
    class with a weight before anything is compared. Cells that hold many vectors are met in pairs of blocks of bounded size.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and so do vectors of different
    lengths. A null id is kept as a row of its own, without links. Rows that repeat an id with the same vector count as
    copies. Columns besides the two named are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    ok = F.coalesce(finite & F.exists(e, lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    base = scratch.save(base.select("vec_id", F.when(ok, e).alias("embedding")))
    good = base.where("embedding is not null")
    classes = scratch.save(good.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("embedding")))
    bits, rounds = plan_rounds(classes.count(), least, recall)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cells(embedding: pd.Series) -> pd.Series:
        out: list = [None] * len(embedding)
        lengths = embedding.map(len).to_numpy()
        for dim in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == dim)
            cell, _ = projections(dim, bits, rounds, least).of(_units(embedding.iloc[which]))
            for k, c in zip(which.tolist(), cell, strict=True):
                out[k] = c
        return pd.Series(out)

    celled = classes.select("dim", "vec", "weight", cells("embedding").alias("cells"))
    spots = scratch.save(celled.select("dim", "vec", "weight", F.posexplode("cells").alias("round", "cell")))
    blocks = spots.groupBy("dim", "round", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    placed = spots.join(blocks, ["dim", "round", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec", "round"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "vec", "weight", "dim", "round", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = dealt.join(classes.select("vec", "embedding"), "vec")
    met = scratch.save(full.groupBy("dim", "round", "cell", "i", "j").applyInPandas(_meet(bits, rounds, least), "vec long, links long, root long"))
    linked = connected_components(spark, met.select(F.col("vec").alias("a"), F.col("root").alias("b")), scratch)
    counts = met.groupBy("vec").agg(F.sum("links").alias("links"))
    per_class = scratch.save(classes.join(counts, "vec", "left").join(linked, F.col("vec") == F.col("node"), "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id")))
    scratch.drop_all(base, per_class)
    return base.join(per_class, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
