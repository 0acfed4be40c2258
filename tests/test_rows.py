"""Steps must not make more rows between them than their input or their result has."""

import random

from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import metadata, metrics
from docloom.operators import evaluation


def most_rows(df):
    """Of any step of the plan, once ``df`` has been computed."""
    df.collect()

    def of(plan):
        found = plan.metrics().get("numOutputRows")
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
        name = plan.getClass().getSimpleName()
        inner += [plan.finalPhysicalPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
        return max([found.get().value() if found.isDefined() else 0, *map(of, inner)])

    return of(df._jdf.queryExecution().executedPlan())


def test_retrieval_by_label_makes_no_pairs_of_queries_and_items(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("vec_id"), (F.col("id") % 2).alias("label"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("retrieval_metrics", "retrieval_averages"):
        assert most_rows(catalog.QUERIES[name](spark, str(tmp_path))) <= 2000, name


def test_retrieval_by_label_equals_pairs(spark):
    r = random.Random(5)
    items = spark.createDataFrame([(i, r.choice(["a", "b", "c", None])) for i in range(60)], "item int, label string")
    queries = spark.createDataFrame([(i, r.choice(["a", "b", "none", None])) for i in range(12)], "query_id int, label string")
    ranked = spark.createDataFrame([(q, i, k) for q in range(11) for k, i in enumerate(r.sample(range(60), 10), 1)], "query_id int, item int, rank int")
    pairs = queries.join(items, "label").select("query_id", "item")
    rounded = lambda df: df.select("query_id", *[F.round(c, 9).alias(c) for c in df.columns[1:]]).orderBy("query_id").collect()
    got = rounded(evaluation.label_retrieval_metrics(ranked, queries, items.unionByName(items)))
    assert got == rounded(evaluation.retrieval_metrics(ranked, pairs, queries))
    assert any(x["mrr"] > 0 for x in got) and any(x["mrr"] == 0 for x in got)


def test_bleu_makes_no_row_of_an_ngram(spark):
    words = "the cat sat on the mat and the cat sat on a hat".split()
    pairs = spark.createDataFrame([(1, " ".join(words * 20), " ".join(words * 30)), (2, "a b", "a b"), (3, "", "a b c d"), (4, None, "a"), (5, "The Cat sat on it", "the cat  sat on　it")], "i int, r string, c string")
    out = metrics.bleu(pairs, "i", "r", "c")
    assert most_rows(out) <= 5
    got = {x["i"]: x["bleu"] for x in out.collect()}
    # of n words, n - 1 pairs and so on of the candidate, those of the reference are found: it is a longer run of the same
    assert abs(got[1] - ((260 / 390) * (259 / 389) * (258 / 388) * (257 / 387)) ** 0.25) < 1e-12
    assert got[2] == got[3] == got[4] == 0 and got[5] == 1


def test_keywords_make_no_row_of_a_word(spark):
    rows = [(i, " ".join(f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst")) for i in range(20)]
    assert most_rows(metadata.keywords(spark.createDataFrame(rows, "i long, t string"), "i", "t", 10)) <= 200


def test_keywords_of_repeated_and_null_ids(spark):
    rows = [("x", "one pear apple apple"), ("x", "kiwi pear cherry kiwi"), (None, "plum"), (None, "plum fig"), ("y", "the a of"), ("z", None), ("w", "")]
    got = {(r["i"], r["keyword"]): (r["count"], r["rank"]) for r in metadata.keywords(spark.createDataFrame(rows, "i string, t string").repartition(4), "i", "t", 3).collect()}
    assert got.pop(("x", "pear"))[0] == 2 and {got.pop(("x", w))[0] for w in ("apple", "kiwi")} == {2}
    # of words that are as frequent, that comes first which is the earlier in any of the documents: kiwi at 0, pear at 0 after the stop word, apple at 1
    assert got == {(None, "plum"): (2, 1), (None, "fig"): (1, 2)}
