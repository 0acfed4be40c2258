"""From postings (nodes under shared tokens) to connected groups, without listing the pairs of a group.

Shared by the near-duplicate operators, which differ in their tokens and in how a pair is verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, connected_components

#: Pairs in token groups of up to so many nodes are joined; those of larger ones are left to ``dense``.
LARGE = 64


def link(
    spark: SparkSession, scratch: Scratch, postings: DataFrame, verify: Callable[[DataFrame], DataFrame], may_link: Callable[[Column, Column, Column, Column], Column],
    dense: Callable[[DataFrame], DataFrame], star_rounds: int = 2,
) -> DataFrame:
    """(node, component) of all nodes that have a verified link.

    ``postings``: token, node, size, bits (bigint), one row per token of a node. Two nodes are candidates when they share a token
    and ``may_link(size, bits, size, bits)``. ``verify`` takes distinct candidates (a, b) and returns the true links among them.
    ``dense`` takes large groups as rows (main, node, comp, size, bits), where main is a group's largest component, and returns
    links (a, b) of their nodes with comp other than main: one at least with every other component that such a node links to.

    1. Stars: each node is verified against one node only, the smallest node of a token group it shares most
       tokens with. The links give first components; large groups of near copies are mostly one component after it.
    2. More stars: in each token group, the nodes outside the group's largest component are verified against one node
       of that component, another one for every token and round.
    3. Crossings: every candidate pair whose nodes are still in different components is verified. In groups of up to ``LARGE``
       nodes the rows outside the group's largest component are joined with the group; larger groups, those with the same largest component
       as one, go to ``dense``.

    A candidate that is never verified has both ends in one component already, so the components are those of all
    candidates. Groups of one token are only met in aggregations with map-side combine and in joins that adaptive
    execution can split.
    """
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    shared = scratch.save(postings.join(often, "token"))
    first = shared.groupBy("token").agg(F.min("node").alias("centre"), F.min_by("size", "node").alias("_size"), F.min_by("bits", "node").alias("_bits"))
    star = shared.join(first, "token").where((F.col("node") != F.col("centre")) & may_link(F.col("size"), F.col("bits"), F.col("_size"), F.col("_bits")))
    star = star.groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = star.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("_r = 1").select("a", "b")
    links = scratch.save(verify(best))
    component = scratch.save(connected_components(spark, links, scratch))

    for r in range(star_rounds):
        mixed = scratch.save(_mixed(shared, component, r))
        near = mixed.where((F.col("comp") != F.col("main")) & may_link(F.col("size"), F.col("bits"), F.col("_size"), F.col("_bits")))
        more = scratch.save(verify(near.select(F.least("node", "pick").alias("a"), F.greatest("node", "pick").alias("b")).distinct()))
        scratch.drop(mixed)
        if not more.isEmpty():
            component = _merged(spark, component, more, scratch)
    mixed = scratch.save(_mixed(shared, component, star_rounds))
    scratch.drop(shared)
    few = mixed.where(F.col("rows") <= LARGE)
    a = few.where("comp != main").select("token", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba"), F.col("comp").alias("ca"))
    b = few.select("token", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb"), F.col("comp").alias("cb"), "main")
    crossing = (
        a.join(b, "token").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & may_link(F.col("sa"), F.col("ba"), F.col("sb"), F.col("bb")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    more = scratch.save(verify(crossing))
    many = scratch.save(mixed.where(F.col("rows") > LARGE).groupBy("main", "node").agg(*[F.first(c).alias(c) for c in ("comp", "size", "bits")]))
    if not many.isEmpty():
        more = scratch.save(more.unionByName(dense(many)))
    return component if more.isEmpty() else _merged(spark, component, more, scratch)


def _mixed(shared: DataFrame, component: DataFrame, r: int) -> DataFrame:
    """The rows of tokens of several components, each with its component, the token's largest one, and a node of that."""
    labelled = shared.join(component, "node", "left").select("token", "node", "size", "bits", F.coalesce("component", "node").alias("comp"))
    order = F.xxhash64("token", "node", F.lit(r))
    parts = labelled.groupBy("token", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("node", order).alias("pick"), F.min_by("size", order).alias("_size"), F.min_by("bits", order).alias("_bits"))
    groups = parts.groupBy("token").agg(F.max(F.struct("n", "comp", "pick", "_size", "_bits")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows")).where("parts > 1")
    return labelled.join(groups.select("token", "rows", F.col("top.comp").alias("main"), "top.pick", "top._size", "top._bits"), "token")


def _merged(spark: SparkSession, component: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    known = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return scratch.save(connected_components(spark, known.unionByName(links.select("a", "b")), scratch))
