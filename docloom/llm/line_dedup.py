"""Line dedup with DataFrame functions only: fuzzy lines by MinHash.

A line's shingles of ``SHINGLE`` characters are hashed once; one-permutation MinHash keeps the minimum of each of ``BINS``
residue classes of the hash. Bands of ``BAND`` minima are the tokens under which lines meet; pairs are verified by the exact
Jaccard similarity of their shingle sets, and distributed union-find leaves one line per component.

Hashing and taking minima is one generated loop with map-side combine under the line's own 128-bit identity, so equal lines
merge before anything is shuffled, and texts are not shuffled for it. Lines that share a token are first verified against
their token's most connected line, which for near copies of one line is most often that line itself; only pairs that are then
still in different components are looked at again. No pair leaves a join but those that pass a filter or are links.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, connected_components

SHINGLE, SIDE = 8, 4
BINS = SIDE * SIDE
#: Bins whose minima make a token: the rows, columns and both diagonals of a square. Of the links of sf0.1 that have a similarity below
#: 0.82, 0.7 % have no token in common, and of all links 0.2 %.
_EVERY = range(SIDE)
BANDS = [
    *[[SIDE * i + j for j in _EVERY] for i in _EVERY], *[[SIDE * i + j for i in _EVERY] for j in _EVERY],
    *[[SIDE * i + (k + i) % SIDE for i in _EVERY] for k in _EVERY], *[[SIDE * i + (k - i) % SIDE for i in _EVERY] for k in _EVERY],
]
#: Of a long line only the smallest hashes, about so many, are looked at, and the first ``FIRST`` whatever they are: a line that
#: repeats few shingles over and over has them there. The cut is on the hash, so lines of any length agree on it.
KEPT, FIRST = 64, 24
#: Of the bins of two linked lines, so many agree at least (empty bins agree): four deviations below the mean.
LEAST_BINS = math.floor(BINS * 0.8 - 4 * math.sqrt(BINS * 0.8 * 0.2))
BLANK = " \t\r\x0b\x0c"
#: Bits of the sketches that lines are compared by before their texts are, the most shingles that all count for them, and the deviations allowed.
WIDE, SAMPLE, DEVIATIONS = 1024, 4096, 5
#: Stands for the minimum of an empty bin.
_NONE = (1 << 31) - 1
_ONES8 = sum(1 << (8 * i) for i in range(8))
#: Pairs in token groups of up to so many lines are joined in one piece; larger groups in blocks of about ``BLOCK_SHINGLES``.
LARGE, BLOCK_SHINGLES = 64, 100_000


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: a lambda variable is not substituted into the loops that use it."""
    return F.get(F.transform(F.array(value), use), 0)


def _shingle_hashes(line: Column) -> Column:
    """Distinct shingle hashes of a line; a shorter line is one shingle."""

    def of(units: Column) -> Column:
        last = F.greatest(F.length(units) - 2 * SHINGLE + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last, F.lit(2)), lambda i: F.xxhash64(F.substring(units, i, F.lit(2 * SHINGLE))))

    return F.array_distinct(_once(_units(line), of))  # not within the lambda, where nothing is compiled


def _enough(a: Column, b: Column, percent: int) -> Column:
    """Whether the Jaccard similarity of two arrays of distinct hashes is ``percent`` / 100 or more."""
    both = F.size(F.array_intersect(a, b))
    return (100 * F.least(F.size(a), F.size(b)) >= percent * F.greatest(F.size(a), F.size(b))) & ((100 + percent) * both >= percent * (F.size(a) + F.size(b)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, pos, line, k1, k2) of lines that are not blank; k1 and k2, two hashes of the trimmed line, are its identity."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    line = base.withColumn("line", F.trim("line", F.lit(BLANK))).where("line != ''")
    return line.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line"))


def _hashed(units: DataFrame, *columns: str) -> DataFrame:
    """A row for every position of the lines ``u`` (``n`` units): ``columns``, the position i, and h, the hash of its shingle."""
    one = units.select(*columns, "u", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - SHINGLE, F.lit(0)))).alias("i"))
    return one.select(*columns, "i", F.xxhash64(F.substring("u", F.col("i") * 2 + 1, F.lit(2 * SHINGLE))).alias("h"))


def _signed(lines: DataFrame) -> DataFrame:
    """(node, k1, k2, copies, lo, hi, tokens) of every distinct line: a number, the line's identity, how often it stands, eight bits of each bin's minimum, and a token for each band.

    Tokens of empty bands are null. The table is to be written at once, for the numbers to last.
    """
    units = lines.select("k1", "k2", _units(F.col("line")).alias("u")).withColumn("n", F.floor(F.length("u") / 2).cast("int"))
    share = F.lit(float(1 << 63)) * 2 * KEPT / F.col("n")
    cut = F.when(F.col("n") <= KEPT, F.lit((1 << 63) - 1)).otherwise((F.lit(float(-(1 << 63))) + share).cast("long"))
    kept = _hashed(units.withColumn("cut", cut), "k1", "k2", "cut").where((F.col("h") <= F.col("cut")) | (F.col("i") < FIRST))
    kept = kept.select("k1", "k2", "i", F.shiftright("h", 32).cast("int").alias("v"), F.pmod("h", F.lit(BINS)).cast("int").alias("bin"))
    low = kept.groupBy("k1", "k2").agg(F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("copies"), *[F.min(F.when(F.col("bin") == j, F.col("v")).otherwise(_NONE)).alias(f"m{j}") for j in range(BINS)])
    m = [F.col(f"m{j}") for j in range(BINS)]
    word = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftrightunsigned(m[8 * w + j], 5).bitwiseAND(F.lit(255)).cast("bigint"), 8 * j) for j in range(8)])
    some = lambda bins: reduce(lambda x, y: x.bitwiseAND(y), [m[j] for j in bins]) != _NONE
    tokens = F.array(*[F.when(some(bins), F.xxhash64(F.lit(n), *[m[j] for j in bins])) for n, bins in enumerate(BANDS)])
    return low.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "copies", word(0).alias("lo"), word(1).alias("hi"), tokens.alias("tokens"))


def _differ(a: Column, b: Column) -> Column:
    """Bins whose bits differ, of one word of eight."""
    x = a.bitwiseXOR(b)
    for s in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, s).bitwiseAND(F.lit(_ONES8 * ((1 << (8 - s)) - 1))))
    return F.bit_count(x.bitwiseAND(F.lit(_ONES8)))


def _may_link(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    return _differ(lo, lo2) + _differ(hi, hi2) <= BINS - LEAST_BINS


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x.cast("bigint"), by.cast("int"))


WORDS = WIDE // 64
WIDE_COLUMNS = ["rate", "shingles", *[f"w{w}" for w in range(WORDS)]]


def _wide(texts: DataFrame) -> DataFrame:
    """(node, rate, shingles, w0 ...): how many distinct shingles, and for each of WIDE bits whether an odd number of them has it.

    Of lines of very many shingles one in 2 ** rate of them counts for the bits, chosen by its hash. No set is empty; a plain ``explode``
    would put a test for that, and with it a second making of the sets, before the shuffle.
    """
    sets = texts.repartition("node").select("node", _shingle_hashes(F.col("line")).alias("s")).select("node", F.size("s").alias("shingles"), F.explode_outer("s").alias("h"))
    dealt = sets.withColumn("rate", F.when(F.col("shingles") <= SAMPLE, 0).otherwise(F.ceil(F.log2(F.col("shingles") / SAMPLE)).cast("int")))
    some = dealt.where(F.shiftrightunsigned("h", 40).bitwiseAND(_shift(F.lit(1), F.col("rate")) - 1) == 0)
    at, bit = F.col("h").bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(63))
    words = some.select("node", "rate", "shingles", at.alias("at"), _shift(F.lit(1), bit).alias("bit")).groupBy("node", "rate", "shingles", "at").agg(F.bit_xor("bit").alias("bits"))
    return words.groupBy("node").agg(F.max("rate").alias("rate"), F.max("shingles").alias("shingles"), *[F.coalesce(F.bit_or(F.when(F.col("at") == w, F.col("bits"))), F.lit(0).cast("bigint")).alias(f"w{w}") for w in range(WORDS)])


def _may_link_wide(percent: int) -> Column:
    """Whether the sizes and wide sketches of a pair (prefixes a_ and b_) allow a link; sketches of different rates, or none, do.

    Shingles that both lines have cancel out, so the bits that differ count those of one line only. Linked lines have at most the
    share (100 - percent) / (100 + percent) of their sizes, added up, of these. The bound is ``DEVIATIONS`` above the mean for
    so many; a sample of them varies more. The expression is kept short: a generated method of more than 8,000 bytes would never be compiled.
    """
    a, b, rate = F.col("a_shingles"), F.col("b_shingles"), F.col("a_rate")
    most = (a + b) * ((100 - percent) / (100 + percent)) / F.pow(F.lit(2.0), rate)
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_w{w}").bitwiseXOR(F.col(f"b_w{w}"))) for w in range(WORDS)])
    even = F.exp(most * (-2 / WIDE))
    variance = (1 - even * even) * (WIDE / 4) - F.when(rate == 0, most * even * even).otherwise(0.0)
    near = differ <= (1 - even) * (WIDE / 2) + F.sqrt(F.greatest(variance, F.lit(0.0))) * DEVIATIONS + 1
    return F.coalesce((100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((rate != F.col("b_rate")) | near), F.lit(True))


def _blocked(groups: DataFrame, texts: DataFrame, wide: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the lines outside a large group's main component with the group, compared in blocks; only links leave the join.

    ``groups``: (main, node, comp).
    """
    sets = scratch.save(texts.join(groups.select("node").distinct(), "node", "left_semi").select("node", _shingle_hashes(F.col("line")).alias("s")))
    full = scratch.save(groups.join(wide, "node", "left").join(sets.select("node", F.size("s").alias("size")), "node"))
    outside = F.col("comp") != F.col("main")
    number = lambda size: F.ceil(F.coalesce(F.sum(size), F.lit(0)) / BLOCK_SHINGLES).cast("int")
    blocks = full.groupBy("main").agg(number(F.when(outside, F.col("size"))).alias("bi"), number(F.col("size")).alias("bj")).where("bi > 0")
    dealt = full.join(scratch.save(blocks), "main").join(sets, "node")
    of = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, x, i, j: df.select("main", i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{x}_{c}") for c in ("node", "comp", "s", *WIDE_COLUMNS)])
    a, b = side(dealt.where(outside), "a", of("bi"), every("bj")), side(dealt, "b", every("bi"), of("bj"))
    once = (F.col("b_comp") == F.col("main")) | (F.col("a_node") < F.col("b_node"))
    # dealt by hand: blocks are even, and adaptive execution would cut both sides of a large group and join all cuts with all
    a, b = a.repartition("main", "i", "j"), b.repartition("main", "i", "j")
    linked = a.join(b, ["main", "i", "j"]).where((F.col("a_comp") != F.col("b_comp")) & once & _may_link_wide(percent) & _enough(F.col("a_s"), F.col("b_s"), percent))
    return linked.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _components(posts: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes that have a link. ``posts``: (token, node, w, lo, hi); ``texts``: (node, line)."""
    spark = posts.sparkSession
    side = lambda x: texts.select(F.col("node").alias(x), F.col("line").alias(f"l{x}"))

    wide = scratch.save(_wide(texts))
    bits = lambda x: wide.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in WIDE_COLUMNS])

    def verify(pairs: DataFrame, sketched: bool = False) -> DataFrame:
        if not sketched:
            pairs = pairs.join(bits("b"), "b", "left").join(bits("a"), "a", "left").where(_may_link_wide(percent)).select("a", "b")
        full = pairs.join(side("b"), "b").join(side("a"), "a")
        # the sets are made once: an exploded column is not substituted into the test, and unlike a lambda's it is compiled
        full = full.select("a", "b", F.explode_outer(F.array(F.struct(_shingle_hashes(F.col("la")).alias("a"), _shingle_hashes(F.col("lb")).alias("b")))).alias("s"))
        return full.where(_enough(F.col("s.a"), F.col("s.b"), percent)).select("a", "b")

    centre = posts.groupBy("token").agg(F.max(F.struct("w", "node", "lo", "hi")).alias("c")).select("token", "c.*").toDF("token", "_w", "centre", "_lo", "_hi")
    star = posts.join(centre, "token").where((F.col("node") != F.col("centre")) & _may_link(F.col("lo"), F.col("hi"), F.col("_lo"), F.col("_hi")))
    links = scratch.save(verify(star.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()))
    known = scratch.save(connected_components(spark, links, scratch))

    # lines of a token that have other minima in common, too, stand side by side when sorted by them
    mixed = scratch.save(_mixed(posts, known))
    few = mixed.where(F.col("rows") <= LARGE).join(wide, "node", "left")
    named = lambda x: few.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "comp", "main", "lo", "hi", *WIDE_COLUMNS)])
    once = (F.col("b_comp") == F.col("b_main")) | (F.col("a_node") < F.col("b_node"))
    met = named("a").where("a_comp != a_main").join(named("b"), "token").where(
        (F.col("a_comp") != F.col("b_comp")) & once & _may_link(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")) & _may_link_wide(percent))
    more = scratch.save(verify(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), True))
    many = scratch.save(mixed.where(F.col("rows") > LARGE).groupBy("main", "node").agg(F.min("comp").alias("comp")))
    if not many.isEmpty():
        more = more.unionByName(scratch.save(_blocked(many, texts, wide, percent, scratch)))
    return _merged(known, more, scratch)


def _mixed(posts: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of tokens of several components: token, node, lo, hi, comp, the token's rows and its largest component ``main``."""
    labelled = posts.select("token", "node", "lo", "hi").join(known, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    counts = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("rows")).where("comps > 1")
    return labelled.join(groups.select("token", "rows", F.col("top.comp").alias("main")), "token")


def _merged(first: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components of ``first`` (node, component) once ``links`` (a, b) are added."""
    part = lambda df, x: df.join(first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(x, F.coalesce(f"c{x}", x)).drop(f"c{x}")
    edges = part(part(links, "a"), "b").where("a != b")
    joined = scratch.save(connected_components(first.sparkSession, edges, scratch)).toDF("component", "now")
    old = first.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    new = joined.select(F.col("component").alias("node"), F.col("now").alias("component")).join(first, "node", "left_anti")
    return scratch.save(old.unionByName(new))


def repeated_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, gone): the positions of the lines to remove from each document; th is the hash of its text.

    Of each component of similar lines (equal ones included) the first by (doc_id, position) stays.
    """
    scratch = Scratch(docs.sparkSession)
    lines = _lines(docs, id_col, text_col)
    signed = scratch.save(_signed(lines))
    posted = signed.select("node", F.explode("tokens").alias("token")).where("token is not null")
    often = scratch.save(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.save(posted.join(often, "token"))
    nodes = scratch.save(shared.groupBy("node").agg(F.sum("n").alias("w")))
    known = scratch.save(signed.drop("tokens").join(nodes, "node", "left").where("copies > 1 or w is not null"))
    spots = scratch.save(lines.join(known.select("k1", "k2", "node", "w"), ["k1", "k2"]).select("doc_id", "th", "pos", "node", F.when(F.col("w").isNotNull(), F.col("line")).alias("line")))
    posts = scratch.save(shared.select("token", "node").join(known.select("node", "w", "lo", "hi"), "node"))
    scratch.drop(signed, often, shared, nodes, known)
    texts = scratch.save(spots.where("line is not null").groupBy("node").agg(F.first("line").alias("line")))
    component = _components(posts, texts, percent, scratch)

    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos", "th")
    several = spots.select("doc_id", "th", "pos", "node").join(component, "node", "left").select("doc_id", "th", "pos", F.coalesce("component", "node").alias("component"), rank.alias("rank"))
    first = several.groupBy("component").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = several.join(first, "component").where("rank != first")
    gone = scratch.save(gone.groupBy("doc_id", "th").agg(F.array_distinct(F.collect_list("pos")).alias("gone")))
    scratch.drop_all(gone)
    return gone


def _joined(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    gone = repeated_lines(docs, percent, id_col, text_col).select(F.col("doc_id").alias("_docloom_id"), F.col("th").alias("_docloom_th"), F.col("gone").alias("_docloom_gone"))
    same = docs[id_col].eqNullSafe(F.col("_docloom_id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("_docloom_th"))
    return docs.join(gone, same, "left")


def _kept(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions ``gone``. Positions are subtracted as a set: one pass, however many."""

    def left(parts: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(at, lambda i: F.get(parts, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(_once(F.split(text, "\n"), left))


def drop_repeated_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with repeated lines taken out of the text (see ``dedup_lines``)."""
    out = _joined(docs, percent, id_col, text_col)
    return out.select(*[(_kept(F.col(c), F.col("_docloom_gone")).alias(c) if c == text_col else F.col(c)) for c in docs.columns])


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (what is left, lines joined as before).

    Lines end at U+000A and are compared without blanks at either end. Lines whose sets of 8-character shingles (UTF-16 units)
    have a Jaccard similarity of ``percent`` / 100 or more are linked; of each component the line that comes first by
    (doc_id, position) stays, wherever else it stands it goes. Blank lines stay.

    Nulls: a null text stays null, without lines; a null id sorts last. Rows that repeat id and text are treated alike: the
    line that stays, stays in each of them. Columns besides the two named are not read. An empty table gives no rows.
    Equal lines are known by 128 bits of hashes, similar ones by their texts.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _joined(base, percent, "doc_id", "text")
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return out.select(
        "doc_id", F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_docloom_gone"), F.lit(0)).cast("long").alias("n_removed"),
        _kept(F.col("text"), F.col("_docloom_gone")).alias("text"))
