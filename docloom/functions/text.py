"""Text kernel: Unicode white space, line-mode regular expressions and counts, as Column expressions.

Java's ``\\s`` is ASCII and even ``(?U)\\s`` misses four blanks, so the class is spelt out; ``(?md)`` makes ``^`` and ``$``
break at U+000A only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NOT_WS = f"[{_SPACE}]", f"[^{_SPACE}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def words(c: str | Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(col(c), f"{WS}+"), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.size(words(c))


def char_count(c: str | Column) -> Column:
    """Code points."""
    return F.length(col(c))


def line_count(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit("\n")) + 1


def blank_line_parts(c: str | Column) -> Column:
    """Number of parts between blank lines, empty ones included."""
    return F.size(F.split(col(c), rf"\n{WS}*\n"))


def paragraph_count(c: str | Column) -> Column:
    """Number of parts between blank lines that hold something."""
    return F.size(F.filter(F.split(col(c), rf"\n{WS}*\n"), lambda p: p.rlike(NOT_WS)))


def sentence_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(col(c), rf"[.!?]+{WS}+"), lambda s: s.rlike(NOT_WS)))


def reading_minutes(c: str | Column, words_per_minute: int = 200) -> Column:
    return word_count(c) / F.lit(words_per_minute)
