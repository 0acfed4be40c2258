"""Evaluation tables: chunk metrics, retrieval quality, configuration comparison, benchmark summaries and rankings.

All joins are equi-joins on declared keys; rankings are windows. Vector search runs queries in blocks against the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import WS, word_count
from docloom.functions.vector import cosine_similarity, pearson, spearman

BUCKETS = (("tiny", 0, 50), ("small", 50, 200), ("medium", 200, 500), ("large", 500, 1000), ("huge", 1000, None))


def chunk_metrics(chunks: DataFrame, keys: list[str], content: str = "content", original_length: str | None = None, tokens: Column | None = None) -> DataFrame:
    """Per group: totals, sizes (mean, extremes, population deviation), boundary ratios; coverage if the original's length is given."""
    size, count = F.length(content), tokens if tokens is not None else word_count(content)
    aggs = [
        F.count(F.lit(1)).alias("total_chunks"), F.sum(count).cast("long").alias("total_tokens"), F.sum(size).cast("long").alias("total_chars"), F.avg(size).alias("avg_chunk_size"),
        F.min(size).alias("min_chunk_size"), F.max(size).alias("max_chunk_size"), F.stddev_pop(size).alias("std_chunk_size"),
        F.avg(F.col(content).rlike(rf"[.!?]{WS}*\z").cast("int")).alias("sentence_boundary_ratio"), F.avg(F.col(content).rlike(rf"\n{WS}*\z").cast("int")).alias("paragraph_boundary_ratio"),
    ]
    if original_length:
        aggs.append(F.least(F.lit(1.0), F.sum(size) / F.max(original_length)).alias("coverage_ratio"))
    return chunks.groupBy(*keys).agg(*aggs)


def chunk_histogram(chunks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    size = F.length(content)
    return chunks.groupBy(*keys).agg(*[
        F.count_if((size >= lo) & (size < hi) if hi else size >= lo).alias(name) for name, lo, hi in BUCKETS])


def _scores(queries: np.ndarray, items: np.ndarray, metric: str) -> np.ndarray:
    """Rows: queries. Cosines (0 where a norm is 0), or distances over the shorter length."""
    if metric == "cosine":
        if queries.shape[1] != items.shape[1]:
            raise ValueError("vectors differ in length")
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None] * np.sqrt(np.einsum("ij,ij->i", items, items))[None]
        return np.divide(np.einsum("qd,nd->qn", queries, items), size, out=np.zeros(size.shape), where=size > 0)
    n = min(queries.shape[1], items.shape[1])
    return np.stack([np.sqrt(((items[:, :n] - q[:n]) ** 2).sum(1)) for q in queries])


def _nearest(queries: list, k: int, metric: str):
    """Scores a block of queries against each batch of items; a partition keeps k items for each query."""
    best = -1 if metric == "cosine" else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(queries):
            sizes.setdefault(len(v), []).append(i)
        matrices = {n: (own, np.array([queries[i][1] for i in own], np.float64).reshape(len(own), n)) for n, own in sizes.items()}
        held: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            ids, vectors = batch.column("item").to_pylist(), batch.column("vector").to_pylist()
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                items = np.array([vectors[i] for i in at], np.float64).reshape(len(at), length)
                for own, matrix in matrices.values():
                    for i, row in zip(own, _scores(matrix, items, metric) * best, strict=True):
                        # all that tie with the k-th stay until they are ranked by id
                        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else range(len(row))
                        held[i] = sorted(held[i] + [(row[j], ids[at[j]]) for j in near])[:k]
        rows = [(i, item, s * best) for i, found in enumerate(held) for s, item in found]
        kind = batch_kind[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([float(r[2]) for r in rows], pa.float64())], ["_q", "item", "score"])

    batch_kind: list = [None]
    return run, batch_kind


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", query_id: str = "query_id", query_vector: str = "query_vector", item_id: str = "item_id", vector: str = "vector", max_queries: int = 1000, embed: Callable[[list[str]], list] | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items of each query; ties go to the smaller item id.

    Exact search: blocks of about ``max_queries`` queries meet the corpus as matrices, each task keeps k items for a query, and a
    ranking over tasks follows. The corpus is read once for each block and never shuffled. ``embed`` turns the column
    ``query_vector`` of texts into vectors. Null vectors find nothing and are not found.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, spark = corpus.schema[item_id].dataType, corpus.sparkSession
    base = corpus.select(F.col(item_id).alias("item"), F.col(vector).alias("vector")).where("vector is not null and item is not null")
    some = queries.select(query_id, query_vector).where(F.col(query_vector).isNotNull())
    blocks = max(1, -(-some.count() // max_queries))
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), "item"]
    out = None
    for b in range(blocks):
        rows = (some if blocks == 1 else some.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)).collect()
        vectors = embed([r[1] for r in rows]) if embed else [r[1] for r in rows]
        run, batch_kind = _nearest([(i, list(map(float, v))) for i, v in enumerate(vectors)], k, metric)
        batch_kind[0] = to_arrow_type(kind)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("_q", T.IntegerType()), T.StructField(query_id, queries.schema[query_id].dataType)]))
        found = base.mapInArrow(run, T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("item", kind), T.StructField("score", T.DoubleType())]))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(*order))).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(names), "_q").select(query_id, F.col("item").alias(item_id), "score", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10), query_id: str = "query_id", item: str = "item", cut: int = 10) -> DataFrame:
    """Per query: recall_at_k and precision_at_k (distinct items), mrr, ndcg_at_10.

    ``ranked``: (query_id, item, rank from 1); ``relevant``: (query_id, item), distinct. Queries without relevant items get 0.
    """
    pairs = relevant.select(query_id, item).distinct()
    hit = ranked.join(pairs.withColumn("_rel", F.lit(1)), [query_id, item], "left")
    return _hit_metrics(hit, pairs.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n")), queries, ks, query_id, item, cut)


def label_retrieval_metrics(ranked: DataFrame, queries: DataFrame, items: DataFrame, label: str = "label", ks: tuple[int, ...] = (1, 5, 10), query_id: str = "query_id", item: str = "item", cut: int = 10) -> DataFrame:
    """``retrieval_metrics`` where the relevant items of a query are those with its label; their pairs are never made.

    ``queries``: (query_id, label); ``items``: (item, label). Only retrieved items are looked up, and items are counted once for each label.
    """
    pairs = items.select(item, label).where(F.col(label).isNotNull()).distinct()
    own = queries.select(query_id, label).where(F.col(label).isNotNull()).distinct()
    labels = lambda df, key, name: df.groupBy(key).agg(F.collect_set(label).alias(name))
    hit = ranked.join(labels(own, query_id, "_own"), query_id, "left").join(labels(pairs, item, "_its"), item, "left")
    hit = hit.withColumn("_rel", F.when(F.arrays_overlap("_own", "_its"), 1))
    sizes = own.join(pairs.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), label).groupBy(query_id).agg(F.sum("_n").alias("_n"))
    return _hit_metrics(hit, sizes, queries, ks, query_id, item, cut)


def _hit_metrics(hit: DataFrame, sizes: DataFrame, queries: DataFrame, ks: tuple[int, ...], query_id: str, item: str, cut: int) -> DataFrame:
    """``hit``: (query_id, item, rank, _rel: 1 if relevant); ``sizes``: (query_id, _n) relevant items."""
    at = lambda k: F.count_distinct(F.when((F.col("_rel") == 1) & (F.col("rank") <= k), F.col(item)))
    per = hit.groupBy(query_id).agg(
        *[at(k).alias(f"_h{k}") for k in ks], F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"),
        F.sum(F.when((F.col("_rel") == 1) & (F.col("rank") <= cut), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"))
    all_ = queries.select(query_id).join(per, query_id, "left").join(sizes, query_id, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("_n"), F.lit(cut)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select(
        query_id,
        *[zero(F.when(F.col("_n") > 0, F.col(f"_h{k}") / F.col("_n"))).alias(f"recall_at_{k}") for k in ks],
        *[zero(F.when(F.col("_n") > 0, F.col(f"_h{k}") / F.lit(k))).alias(f"precision_at_{k}") for k in ks],
        zero(1 / F.col("_first")).alias("mrr"), zero(F.when(F.col("_n") > 0, F.col("_dcg") / ideal)).alias("ndcg_at_10"))


def average_metrics(per_query: DataFrame, query_id: str = "query_id") -> DataFrame:
    names = [c for c in per_query.columns if c != query_id]
    return per_query.agg(F.count(F.lit(1)).alias("num_queries"), *[F.avg(c).alias(c) for c in names])


def compare_embeddings(a: DataFrame, b: DataFrame, text: str = "text", vector: str = "vector", index: str = "idx") -> DataFrame:
    """One row: chunks of either side, matched pairs, mean cosine and mean Pearson over texts that both have.

    Of equal texts in ``a`` the last counts; every one in ``b`` does. Pearson needs more than two pairs.
    """
    last = a.groupBy(text).agg(F.max_by(vector, index).alias("_va"))
    pairs = b.select(text, F.col(vector).alias("_vb")).join(last, text)
    both = pairs.agg(F.count(F.lit(1)).alias("matching_chunks"), F.avg(cosine_similarity("_va", "_vb")).alias("_cos"), F.avg(pearson("_va", "_vb")).alias("_cor"))
    counts = a.agg(F.count(F.lit(1)).alias("chunks_a")).join(b.agg(F.count(F.lit(1)).alias("chunks_b")))
    return both.join(counts).select(
        "chunks_a", "chunks_b", "matching_chunks", F.coalesce("_cos", F.lit(0.0)).alias("avg_cosine_similarity"),
        F.when(F.col("matching_chunks") > 2, F.coalesce("_cor", F.lit(0.0))).otherwise(0.0).alias("correlation"))


def compare_retrieval(a: DataFrame, b: DataFrame, query_id: str = "query_id", item: str = "item") -> DataFrame:
    """Per query: agreement (Jaccard of the retrieved items) and ranking_correlation (Spearman over more than two common ones, else null)."""
    x = a.groupBy(query_id, item).agg(F.max("rank").alias("_ra"))
    y = b.groupBy(query_id, item).agg(F.max("rank").alias("_rb"))
    both = x.join(y, [query_id, item], "full_outer")
    d = F.col("_ra") - F.col("_rb")
    sums = both.groupBy(query_id).agg(F.count(F.lit(1)).alias("_u"), F.count(d).alias("_n"), F.sum(d * d).alias("_d2"))
    return sums.select(query_id, (F.col("_n") / F.col("_u")).alias("agreement"), F.when(F.col("_n") > 2, spearman(F.col("_n"), F.col("_d2"))).alias("ranking_correlation"))


def config_pairs(results: DataFrame, config: str = "config_name", document: str = "document_path", order: str = "config_pos", sequence: str = "seq") -> DataFrame:
    """Each unordered pair of configurations per document (columns with suffixes _a and _b); of repeated results the last counts."""
    last = results.withColumn("_r", F.row_number().over(Window.partitionBy(config, document).orderBy(F.desc(sequence)))).where("_r = 1").drop("_r")
    a = last.select(document, *[F.col(c).alias(f"{c}_a") for c in last.columns if c != document])
    b = last.select(document, *[F.col(c).alias(f"{c}_b") for c in last.columns if c != document])
    return a.join(b, document).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


def judge_pairs(pairs: DataFrame, strict: bool = True) -> DataFrame:
    """Differences and ``better_config``. Words count 1, F1 beyond 0.01 counts 2, time beyond 100 ms counts 1.

    ``strict``: as the word difference is absolute, side a gets its point whenever the counts differ. Otherwise the larger count does.
    """
    words = F.col("word_count_a") - F.col("word_count_b")
    f1, ms = F.col("f1_a") - F.col("f1_b"), F.col("parse_time_ms_a") - F.col("parse_time_ms_b")
    point = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
    a = point(words != 0 if strict else words > 0, 1) + point(f1 > 0.01, 2) + point(ms < -100, 1)
    b = (F.lit(0) if strict else point(words < 0, 1)) + point(f1 < -0.01, 2) + point(ms > 100, 1)
    return pairs.withColumns({
        "content_diff_chars": F.abs(F.col("content_length_a") - F.col("content_length_b")), "content_diff_words": F.abs(words), "chunk_count_diff": F.col("chunk_count_a") - F.col("chunk_count_b"),
        "f1_diff": f1, "parse_time_diff_ms": ms, "a_score": a, "b_score": b,
        "better_config": F.when(a > b, F.col("config_name_a")).when(b > a, F.col("config_name_b")).otherwise("tie"),
    })


def config_rankings(judged: DataFrame, configs: DataFrame, config: str = "config_name", order: str = "config_pos") -> DataFrame:
    """(config, wins, rank): ties give no win; equal wins keep the configurations' order, and no rank is shared."""
    wins = judged.where("better_config != 'tie'").groupBy(F.col("better_config").alias(config)).agg(F.count(F.lit(1)).alias("wins"))
    all_ = configs.select(config, order).distinct().join(wins, config, "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return all_.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wins"), order))).select(config, "wins", "rank")


def comparator_summary(results: DataFrame, config: str = "config_name") -> DataFrame:
    return results.groupBy(config).agg(
        F.count(F.lit(1)).alias("documents"), F.avg("parse_time_ms").alias("avg_parse_time_ms"), F.avg("content_length").alias("avg_content_length"),
        F.avg("chunk_count").alias("avg_chunk_count"), F.avg("f1").alias("avg_f1"), F.avg("bleu").alias("avg_bleu"))


def benchmark_summary(results: DataFrame, config: str = "config_name") -> DataFrame:
    """Successful runs only; F1 and BLEU over runs whose F1 is above 0. Configurations without success are absent."""
    ok, scored = F.col("success"), F.col("success") & (F.col("f1") > 0)
    avg = lambda c: F.avg(F.when(ok, F.col(c)))
    out = results.groupBy(config).agg(
        F.count_if(ok).alias("successful"), (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"), avg("parse_time_ms").alias("avg_parse_time_ms"),
        avg("total_time_ms").alias("avg_total_time_ms"), avg("content_length").alias("avg_content_length"), avg("chunk_count").alias("avg_chunk_count"),
        F.coalesce(F.avg(F.when(scored, F.col("f1"))), F.lit(0.0)).alias("avg_f1"), F.coalesce(F.avg(F.when(scored, F.col("bleu"))), F.lit(0.0)).alias("avg_bleu"))
    return out.where("successful > 0")


def benchmark_rankings(summary: DataFrame, config: str = "config_name") -> DataFrame:
    """score = 0.7 * 100 F1 + 0.3 * max(0, 100 - ms / 10)."""
    score = 0.7 * (F.col("avg_f1") * 100) + 0.3 * F.greatest(F.lit(0.0), 100 - F.col("avg_total_time_ms") / 10)
    ranked = summary.select(config, score.alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), config)))


def recommendations(summary: DataFrame, rankings: DataFrame, config: str = "config_name") -> DataFrame:
    """(kind, config, value): the best ranked, the fastest, and the most accurate if any F1 is above 0."""
    best = rankings.where("rank = 1").select(F.lit("best").alias("kind"), F.col(config).alias("config"), F.col("wins").cast("double").alias("value"))
    one = lambda kind, f, c: summary.agg(f(config, F.struct(c, config)).alias("config"), (F.min if f is F.min_by else F.max)(c).alias("value")).select(F.lit(kind).alias("kind"), "config", "value")
    return best.unionByName(one("fastest", F.min_by, "avg_parse_time_ms")).unionByName(one("most_accurate", F.max_by, "avg_f1").where("value > 0"))


def grid(configs: DataFrame, documents: DataFrame) -> DataFrame:
    """Every configuration with every document: configurations are few (a configuration is a plan) and broadcast."""
    if configs.count() > 10_000:
        raise ValueError("more than 10,000 configurations")
    return documents.join(F.broadcast(configs))


def with_truth(results: DataFrame, truth: DataFrame, document: str = "document_path") -> DataFrame:
    return results.join(truth, document, "left")


def batch_totals(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """total, successful, failed, success_rate (0 without rows)."""
    n = F.count(F.lit(1))
    return results.groupBy(*(keys or [])).agg(
        n.alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.when(n > 0, F.count_if(F.col("success")) / n), F.lit(0.0)).alias("success_rate"))


def config_details(chunks: DataFrame, config: str = "config_name", model: str = "model", text: str = "text", vector: str = "vector") -> DataFrame:
    """(config, model, dim, num_chunks, avg_chunk_length) of each configuration's embedded chunks."""
    return chunks.groupBy(config).agg(
        F.max(model).alias("model"), F.max(F.size(vector)).alias("dim"), F.count(F.lit(1)).alias("num_chunks"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("avg_chunk_length"))


def embedding_report(chunks: DataFrame, config: str = "config_name", text: str = "text", vector: str = "vector", index: str = "idx") -> dict[str, DataFrame]:
    """Tables of a report: ``configs``' details, and ``comparisons`` of every two of them. Configurations are few: their names come to the driver."""
    names = [r[0] for r in chunks.select(config).distinct().orderBy(config).collect()]
    of = lambda name: chunks.where(F.col(config) == name)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = {"config_details": config_details(chunks, config, text=text, vector=vector)}
    parts = [compare_embeddings(of(a), of(b), text, vector, index).select(F.lit(a).alias("config_a"), F.lit(b).alias("config_b"), "*") for a, b in pairs]
    for i, part in enumerate(parts):
        out["comparisons"] = part if not i else out["comparisons"].unionByName(part)
    return out
