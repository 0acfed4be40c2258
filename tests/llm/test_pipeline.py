"""The corpus pipeline against a brute-force version of every stage, on a small corpus with planted cases."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import decontaminate, quality
from test_operators import edited, jaccard_lines, union, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    """(doc_id, text) and {doc_id: quality}: prose and junk, copies, near copies, repeated lines, a leak, odd rows."""
    prose = lambda seed, n: "\n".join(" ".join(words(seed * 100 + k, 25)) for k in range(n))
    junk = lambda seed: "\n".join("BUY NOW!!! $$$ " * 6 + f"{seed}x{k}" * 9 for k in range(6))
    rows = [(i, prose(i, 4 + i % 5)) for i in range(60)] + [(100 + i, junk(i)) for i in range(40)]
    labels = {i: 1 for i in range(60)} | {100 + i: 0 for i in range(40)}
    whole = words(7, 200)
    broken = lambda w, first, size: "\n".join(" ".join(w[max(0, k) : k + size]) for k in range(first - size, len(w), size))
    rows += [(200, broken(whole, 40, 40)), (201, broken(whole, 20, 40)), (202, broken(edited(whole, 3, 0.01), 7, 15))]
    rows += [(210, prose(300, 5) + "\nthis very line stands in two of the documents\n" + prose(301, 2)), (211, prose(302, 4) + "\nthis very line stands in two of the documents.\n" + prose(303, 3))]
    rows += [(220, prose(400, 3) + "\n" + " ".join(words(9999, 40)) + "\n" + prose(401, 3))]
    rows += [(230, None), (231, ""), (232, " \n\t\n"), (None, prose(500, 4)), (240, "\n".join(" ".join(words(600 + k, 300)) for k in range(20)))]
    return rows, labels, [(1, " ".join(words(9999, 40))), (2, " ".join(words(8888, 40))), (3, None), (4, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, gone string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def brute_force(spark, folder):
    rows, labels, items = corpus()
    # quality: the model is learned as in the stage; every text is then scored on its own
    model = quality.fit(quality.labelled_sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), corpus_pipeline.LABELLED_ROWS))
    tool = quality.Compressors(model.good, model.bad)

    def score(t):
        f = np.array(tool.features(t) if t else model.centre)
        return 1 / (1 + np.exp(-np.clip((f - model.centre) / model.scale @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)))

    rows = [(i, t) for i, t in rows if score(t) >= corpus_pipeline.THRESHOLD]
    yield rows
    gone = jaccard_lines(rows)
    rows = [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i is None, i or 0, p, t) not in gone)) for i, t in rows]
    yield rows
    sets = [{tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]].append(i)
    rows = [(i, t) for k, (i, t) in enumerate(rows) if i is None or i == min(least[root[k]])]
    yield rows
    bare = lambda t: [x for x in (decontaminate._OTHER.sub("", w.lower()) for w in (t or "").split()) if x]
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    tests = [(min(5, len(w)), runs(w, min(5, len(w)))) for w in (bare(t) for _, t in items) if w]
    rows = [(i, t) for i, t in rows if not any(len(s & runs(bare(t), n)) >= 0.8 * len(s) for n, s in tests)]
    yield rows
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    yield sorted((str(i), s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, x in whole for s in range(0, len(x), 4096) for p in [x[s : s + 4096]])


def test_pipeline(spark, folder):
    want = list(brute_force(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=False):
        done = stage(spark, docs, folder)
        assert done.columns == docs.columns, name
        done = spark.createDataFrame(done.collect(), docs.schema)
        assert sorted((str(r.doc_id), str(r.text)) for r in done.collect()) == sorted((str(i), str(t)) for i, t in rows), name
        docs = done
    ids = [{i for i, _ in rows} for rows in want[:-1]]
    assert not ids[0] & {*range(100, 140)} and ids[0] >= {*range(60)} and ids[2] & {200, 201, 202} == {200} and 220 in ids[2] and 220 not in ids[3] and None in ids[3]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in packed) == want[-1]
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 4096 and sorted(o for o, _ in b) == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] for b in bins.values())


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    assert [stage(spark, docs, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
