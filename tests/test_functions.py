"""Text functions against plain Python, on ordinary and adversarial inputs."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import clean, markup, metadata, metrics, normalize, text, vector

ODD = [
    "Hello   World  ", "a\x1cb\x85c\xa0d e　f", "x\r\ny\rz w\n\n\n\n\nend\n", "😀 한글 text", "&amp;lt;b&amp;gt; <b>x</b>&nbsp;y", "“a” ‘b’ «c» ‹d› „e‚", "I'm CAN'T Won't she'd I’m i'd",
    "one\n \ntwo\n\t\nthree", "mail me@x.org. or call (555) 123-4567 or 010-1234-5678", "12: line\n  34| other\n- 3 -\nPage 4 of 9\n  77  \n", "5 apples, 55 pears, a5", "wait.... so… —–−", "", " ", None, "tail   \nnext\t\t\n",
]


def apply(spark, column, values=ODD):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column.alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def expect(spark, column, f, values=ODD):
    assert apply(spark, column, values) == [None if v is None else f(v) for v in values]


def test_white_space(spark):
    expect(spark, text.strip("x"), str.strip)
    expect(spark, text.word_count("x"), lambda v: len(v.split()))
    expect(spark, text.char_count("x"), len)
    expect(spark, text.line_count("x"), lambda v: v.count("\n") + 1)
    expect(spark, text.blank_line_parts("x"), lambda v: len(re.split(r"\n\s*\n", v)))
    expect(spark, text.paragraph_count("x"), lambda v: sum(bool(p.strip()) for p in re.split(r"\n\s*\n", v)))
    expect(spark, text.sentence_count("x"), lambda v: sum(bool(p.strip()) for p in re.split(r"[.!?]+\s+", v)))


def test_clean_steps(spark):
    for column, pattern, flags in (
        (clean.remove_emails("x"), r"[\w.+-]+@[\w-]+\.[\w.-]+", 0), (clean.remove_line_numbers("x"), r"^\s*\d+(?:\s|[|:.])", re.M),
        (clean.remove_phones("x"), r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}", 0),
        (clean.remove_page_numbers("x"), r"^\s*(?:[-—]\s*\d+\s*[-—]|Page\s+\d+\s*(?:of\s+\d+)?|\d+)\s*$", re.M | re.I),
    ):
        expect(spark, column, lambda v, p=pattern, f=flags: re.sub(p, "", v, flags=f))
    assert apply(spark, clean.remove_html("x"), ["&amp;lt;b&amp;gt; <b>x</b>&nbsp;y&#39;&quot;"]) == ["<b> x y'\""]
    assert apply(spark, clean.remove_urls("x"), ["go to https://a.b/c?d=e now, www.x.org/y end"]) == ["go to  now,  end"]
    assert apply(spark, clean.remove_urls("x", "[$1]"), ["http://a.b"]) == ["[$1]"]
    assert apply(spark, clean.remove_emojis("x"), ["a😀b한글c"]) == ["abc"]
    expect(spark, clean.remove_special_chars("x", ".,"), lambda v: "".join(c for c in v if c.isalnum() or c.isspace() or c in ".,"), ["a-b_c. d, é한1! x y", "[^]\\"])
    assert apply(spark, clean.remove_special_chars("x", only="-]"), ["a-b]c"]) == ["abc"]
    assert apply(spark, clean.drop_short_lines("x", 3), ["ab\n abc \nd"]) == [" abc "]


def test_clean_order(spark):
    assert apply(spark, clean.TextCleaner().process("x"), ["Hello   World  ", "a\r\n\r\n\r\n\r\nb\t c", None, ""]) == ["Hello World", "a\n\nb c", None, ""]
    assert apply(spark, clean.TextCleaner(custom_patterns=("b+", "(")).process("x"), ["abba"]) == ["aa"]
    assert apply(spark, clean.TextCleaner()("x", min_line_length=3), ["ab\nabcd"]) == ["abcd"]
    chain = normalize.PreprocessorChain(clean.TextCleaner()).add(normalize.TextNormalizer(lowercase=True)).add(lambda c: F.concat(c, F.lit("!")))
    assert apply(spark, chain("x"), ["<b>Hello</b>   WORLD"]) == ["hello world!"]


def test_normalize(spark):
    for form in normalize.FORMS:
        expect(spark, normalize.unicode_form("x", form), lambda v, f=form: unicodedata.normalize(f, v), ["ﬁ é é 한글", "plain", None])
    assert apply(spark, normalize.unicode_form("x", "other"), ["é"]) == ["é"]
    assert apply(spark, normalize.strip_accents("x"), ["Éa ñ"]) == ["Ea n"]
    assert apply(spark, normalize.normalize_quotes("x"), ["“a” ‘b’ «c» ‹d› „e‚"]) == ["“a” ‘b’ \"c\" 'd' \"e'"]
    assert apply(spark, normalize.normalize_quotes("x", curly=True), ["“a” ‘b’"]) == ["\"a\" 'b'"]
    assert apply(spark, normalize.normalize_dashes("x"), ["a–b—c−d"]) == ["a-b-c-d"]
    assert apply(spark, normalize.normalize_ellipsis("x"), ["a… b..... c.."]) == ["a... b... c.."]
    assert apply(spark, normalize.normalize_punctuation("x"), ["ａ！，（１）"]) == ["ａ!,(１)"]
    assert apply(spark, normalize.expand_contractions("x"), ["I'm CAN'T Won't she'd I’m i'd can'tx"]) == ["I am Cannot Will not she would I’m I would can'tx"]
    assert apply(spark, normalize.numbers_to_words("x"), ["5 apples, 55 pears, a5"]) == ["five apples, 55 pears, a5"]
    assert apply(spark, normalize.TextNormalizer(lowercase=True, uppercase=True, custom_replacements={"a": "b", "b": "c"}).process("x"), ["AB"]) == ["cc"]
    assert len(normalize.CONTRACTIONS) == 55 and len(normalize.FULLWIDTH) == 32


def test_metadata(spark):
    cases = {"# Head #1\nx": "Head #1", "short\nA longer line here": "A longer line here", "Ends in colon, long:\nok ok ok ok ok": "ok ok ok ok ok", "x\ny": None, "z" * 150: "z" * 100, "y" * 250 + "\n## B": "B"}
    assert apply(spark, metadata.title("x"), list(cases)) == list(cases.values())
    docs = spark.createDataFrame([(1, "apple the pear apple plum pear fig of it"), (2, ""), (3, None)], "d int, x string")
    assert [(r.keyword, r["count"], r["rank"]) for r in metadata.keywords(docs, "d", "x", 3).orderBy("rank").collect()] == [("apple", 2, 1), ("pear", 2, 2), ("plum", 1, 3)]
    assert apply(spark, metadata.language("x", lambda t: t[:2]), ["en text", "", None]) == ["en", None, None]
    m = spark.sql("select struct('a' as title, 1 as n, map('k','1','j','2') as custom) as a, struct('' as title, 2 as n, map('k','3') as custom) as b").select(metadata.merge_metadata(F.col("a"), F.col("b"), fields=["title", "n"]).alias("m")).first().m
    assert (m.title, m.n, m.custom) == ("a", 2, {"k": "3", "j": "2"})


def test_scores(spark):
    import difflib
    import math
    from collections import Counter

    pairs = [("The quick brown fox", "The quick red fox"), ("Hello world", "Goodbye universe"), ("a b c d e f", "a b c d e f"), ("a a a b", "a a b b a"), ("one two three four five", "one two three four"), ("", "x"), ("x", ""), ("", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    wer = {r.i: r.w for r in df.select("i", metrics.word_error_rate("a", "b").alias("w")).collect()}
    assert [round(wer[i], 6) for i in range(8)] == [0.25, 1.0, 0, round(2 / 4, 6), 0.2, 1.0, 1.0, 0.0]
    seq = {r.i: r.w for r in df.select("i", metrics.sequence_similarity("a", "b").alias("w")).collect()}
    assert all(seq[i] == (difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0) for i, (a, b) in enumerate(pairs))

    def bleu(ref, cand):
        r, c = ref.lower().split(), cand.lower().split()
        if not r or not c:
            return 0.0
        total = 0.0
        for n in range(1, 5):
            x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (r, c))
            hit = sum(min(v, x[g]) for g, v in y.items())
            if not hit:
                return 0.0
            total += math.log(hit / sum(y.values())) / 4
        return (1 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) * math.exp(total)

    got = {r.i: r.bleu for r in metrics.bleu(df, "i", "a", "b").collect()}
    assert all(got[i] == pytest.approx(bleu(a, b)) for i, (a, b) in enumerate(pairs)) and got[2] == 1
    cos = {r.i: r.cosine for r in metrics.bag_cosine(df, "i", "a", "b").collect()}
    assert cos[2] == pytest.approx(1) and cos[1] == cos[5] == cos[7] == 0
    one = df.where("i = 0").select(*metrics.extraction_scores("b", "a")).first()
    assert (one.precision, one.recall, one.missing_words, one.extra_words) == (0.75, 0.75, ["brown"], ["red"])
    with pytest.raises(ValueError):
        metrics.similarity("a", "b", "other")


def test_vectors(spark):
    df = spark.sql("select array(1.0D, 0.0D) as a, array(0.0D, 2.0D) as b, array(0.0D, 0.0D) as z, array(1.0D, 2.0D, 4.0D) as c, array(2.0D, 4.0D, 8.0D) as d")
    r = df.select(vector.cosine_similarity("a", "b").alias("o"), vector.cosine_similarity("a", "a").alias("s"), vector.cosine_similarity("a", "z").alias("zero"), vector.euclidean_distance("a", "b").alias("e"), vector.pearson("c", "d").alias("p"), vector.pearson("z", "a").alias("n")).first()
    assert (r.o, r.s, r.zero, r.n) == (0, 1, 0, None) and r.e == pytest.approx(5**0.5) and r.p == pytest.approx(1)
    with pytest.raises(Exception, match="differ"):
        df.select(vector.cosine_similarity("a", "c")).collect()


def test_markdown(spark):
    src = "# Head\n**b** _i_ `x` [t](u) ![alt](p) ![](q)\n> quote\n---\nsnake_case_name\n"
    assert apply(spark, markup.strip_markdown("x"), [src]) == ["Head\nb i x t !alt \nquote\n\nsnakecasename"]
    assert apply(spark, markup.remove_code_blocks("x"), ["a\n```py\nb\n```\nc ~~~d~~~"]) == ["a\n\nc "]
    assert [tuple(x) for x in apply(spark, markup.markdown_links("x"), [src])[0]] == [("t", "u"), ("alt", "p")]
    front = apply(spark, markup.split_frontmatter("x"), ["---\ntitle: A\nauthor: 'B'\n---\n# C", "---", "no"])
    assert [(f.frontmatter, f.body) for f in front] == [("\ntitle: A\nauthor: 'B'\n", "# C"), (None, "---"), (None, "no")]
    assert apply(spark, markup.frontmatter_fields("x"), [front[0].frontmatter]) == [{"title": "A", "author": "B"}]
    assert apply(spark, markup.markdown_title("x"), ["x\n# T \n", "none"]) == ["T", None]


def test_html(spark):
    page = '<html><head><title>T</title><meta name="author" content="A"><meta property="og:url" content="U"><style>s</style></head><body><script>x()</script><h2>H <i>i</i></h2><p>one<p>two &amp; <a href="/l">li nk</a><ul><li><p>in</p></li></ul><img src="s" alt="a"><!-- c --></body></html>'
    got = apply(spark, markup.html("x", images=True), [page, "", None])
    assert got[0].content == "T\nH\ni\none\ntwo &\nli nk\nin" and (got[0].title, got[0].author) == ("T", "A")
    assert [tuple(x) for x in got[0].links] == [("li nk", "/l")] and [tuple(x) for x in got[0].images] == [("s", "a", "")]
    assert got[1].content == "" and got[2].content is None
    assert apply(spark, markup.html("x", structured=True), [page])[0].content == "## Hi\n\none\ntwo &li nk\n• in\nin"
    assert apply(spark, markup.html_title("x"), [page]) == ["T"] and apply(spark, markup.html_hrefs("x"), [page]) == [["/l"]]
