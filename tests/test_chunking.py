"""Chunkers: exact cases, properties, and the table form."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import chunking as c

TEXT = "This is a test. " * 10


def test_sizes():
    for bad in ((10, 10, 0), (10, 3, 11), (0, 0, 0)):
        with pytest.raises(ValueError):
            c.check_sizes(*bad)
    with pytest.raises(ValueError):
        c.sliding("x", 10, 0)


def test_fixed():
    got = list(c.fixed_chunks(TEXT, 50, 10))
    assert [x[0] for x in got] == list(range(len(got))) and all(len(x[3]) <= 50 for x in got)
    assert all(x[3] == TEXT[x[1] : x[2]].strip() for x in got)
    assert list(c.fixed_chunks("abcdefghij", 4, 1)) == [(0, 0, 4, "abcd"), (1, 3, 7, "defg"), (2, 6, 10, "ghij"), (3, 9, 13, "j")]
    assert list(c.fixed_chunks(" " * 30, 10, 2)) == []


def test_sentences():
    text = "One two. Three four! Five? Éa no. six"
    assert [x[3] for x in c.sentence_chunks(text, 20)] == ["One two. Three four!", "Five? Éa no. six"]
    assert [x[3] for x in c.sentence_chunks("A. B. C. D.", 10, 1, most=2)] == ["A. B.", "B. C.", "C. D."]
    assert [x[3] for x in c.sentence_chunks("가다. 나다.\n다음 줄.", 5)] == ["가다.", "나다.", "다음 줄."]


def test_paragraphs():
    assert [x[3] for x in c.paragraph_chunks("aa\n \nbb\n\ncc", 5)] == ["aa", "bb", "cc"]
    assert [x[3] for x in c.paragraph_chunks("aa\n\nbb\n\ncc", 8, 1)] == ["aa\n\nbb", "bb\n\ncc"]


def test_recursive():
    assert c.recursive_pieces("short", 10, 0) == ["short"]
    assert c.recursive_pieces("aaa bbb ccc", 7, 0) == ["aaa ", "bbb ", "ccc"]
    assert c.recursive_pieces("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5] and c.recursive_pieces("x" * 25, 10, 3, (",",)) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    got = list(c.recursive_chunks("one\n\n" + "w " * 30 + "\n\ntwo", 20, 4))
    assert all(TEXT is not None and x[3] for x in got) and max(len(x[3]) for x in got) <= 24


def test_semantic():
    text = "Aa bb. Cc dd. Ee ff."
    vectors = {"Aa bb.": [1, 0], "Cc dd.": [1, 0.1], "Ee ff.": [0, 1]}
    assert [x[3] for x in c.semantic_chunks(text, 100, lambda s: [vectors[x] for x in s])] == ["Aa bb. Cc dd.", "Ee ff."]
    assert [x[3] for x in c.semantic_chunks(text, 6)] == ["Aa bb.", "Cc dd.", "Ee ff."]
    assert list(c.semantic_chunks("only one", 6)) == [(0, 0, 8, "only one")]


def test_tokens():
    import re

    got = list(c.token_chunks("a b c d e", 4, 1, re.compile(r"\s+|\S+").findall, "".join))
    assert [(x[1], x[2]) for x in got] == [(0, 4), (3, 7), (6, 9)] and got[0][3] == "a b"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(3, 30), st.integers(0, 2))
def test_pieces_keep_the_text(text, size, overlap):
    joined = "".join(c.recursive_pieces(text, size, 0))
    assert joined == text
    at = -1
    for index, start, end, content in c.fixed_chunks(text, size, overlap):
        assert start > at and content == text[start:end].strip()
        at = start


def test_columns(spark):
    docs = spark.createDataFrame([(1, "A" * 150), (2, "ABCDEFGHIJ"), (3, ""), (4, None), (5, "   ")], "d int, x string")
    got = c.chunk_table(docs, c.sliding("x", 50, 50), "d", metadata={"k": "v"})
    assert got.where("d = 1").count() == 3 and got.where("d > 2").count() == 0 and got.first()["metadata"] == {"k": "v"}
    assert "".join(r.content for r in c.chunk_table(docs, c.sliding("x", 5, 5), "d").where("d = 2").orderBy("index").collect()) == "ABCDEFGHIJ"
    for name, f in c.STRATEGIES.items():
        out = c.chunk_table(docs, f("x"), "d")
        assert out.columns == ["d", "index", "start_char", "end_char", "content", "length"], name
        assert {r.d for r in out.collect()} >= {1, 2} and out.where("d in (3, 4)").count() == 0


def test_sliding_counts_characters(spark):
    """Letters beyond the first plane count once, and windows are cut between whole characters."""
    text = "a😀é中" * 20
    got = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "   ")], "d int, x string")
    rows = c.chunk_table(got, c.sliding("x", 7, 3), "d").orderBy("d", "index").collect()
    assert [(r.start_char, r.end_char, r.content) for r in rows] == [(s, min(s + 7, 80), text[s : s + 7]) for s in range(0, 76, 3)]
