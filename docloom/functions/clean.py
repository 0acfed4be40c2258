"""Text cleaning. The order of the steps is fixed; a step that is off adds no expression to the plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import NOT_WS, WS, col, strip

ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
_GAP = f"(?:[-.]|{WS})?"
URL = rf"(?U)https?://(?:(?:%[0-9a-fA-F]{{2}})|[.\w-])+{NOT_WS}*|www\.[.\w-]+{NOT_WS}*"
EMAIL = r"(?U)[+.\w-]+@[\w-]+\.[.\w-]+"
PHONE = rf"(?U)(?:\+?1{_GAP})?\(?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{4}}|0\d{{1,2}}{_GAP}\d{{3,4}}{_GAP}\d{{4}}"
#: (first, last) code points; the last range also takes most East Asian letters.
EMOJI = ((0x1F1E0, 0x1F1FF), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x2702, 0x27B0), (0x24C2, 0x1F251))
LINE_NUMBER = rf"(?md)^{WS}*\d+(?:{WS}|[.:|])"
PAGE_NUMBER = rf"(?mdiu)^{WS}*(?:[—-]{WS}*\d+{WS}*[—-]|page{WS}+\d+{WS}*(?:of{WS}+\d+)?|\d+){WS}*$"
PRESERVED = ""


def remove_html(c: str | Column) -> Column:
    """Tags go, then six entities are decoded one after the other, so doubly encoded ones are decoded twice."""
    out = F.regexp_replace(col(c), "<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def remove_urls(c: str | Column, replacement: str = "") -> Column:
    return F.regexp_replace(col(c), URL, _literal(replacement))


def remove_emails(c: str | Column, replacement: str = "") -> Column:
    """A dot that ends a sentence right after an address goes with it."""
    return F.regexp_replace(col(c), EMAIL, _literal(replacement))


def remove_phones(c: str | Column, replacement: str = "") -> Column:
    """North American and Korean shapes; any run of ten digits has the first."""
    return F.regexp_replace(col(c), PHONE, _literal(replacement))


def remove_emojis(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in EMOJI) + "]+", "")


def remove_line_numbers(c: str | Column) -> Column:
    return F.regexp_replace(col(c), LINE_NUMBER, "")


def remove_page_numbers(c: str | Column) -> Column:
    return F.regexp_replace(col(c), PAGE_NUMBER, "")


def remove_special_chars(c: str | Column, preserved: str = PRESERVED, only: str = "") -> Column:
    """``only``: exactly these go. Else everything but letters, digits, white space and ``preserved``."""
    if only:
        return F.translate(col(c), only, "")
    return F.regexp_replace(col(c), rf"[^\p{{L}}\p{{N}}{WS[1:-1]}{''.join(_escape(x) for x in preserved)}]", "")


def normalize_whitespace(c: str | Column, max_newlines: int = 2) -> Column:
    out = F.regexp_replace(F.translate(col(c), "\t", " "), r"\r\n|\r", "\n")
    out = F.regexp_replace(out, rf"(?:(?!\n){WS})+(?=\n|\z)", "")
    out = F.regexp_replace(out, " +", " ")
    return F.regexp_replace(out, f"\\n{{{max_newlines + 1},}}", "\n" * max_newlines) if max_newlines > 0 else out


def drop_short_lines(c: str | Column, least: int) -> Column:
    return F.array_join(F.filter(F.split(col(c), "\n"), lambda x: F.length(strip(x)) >= least), "\n")


def _literal(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def _escape(char: str) -> str:
    return "\\" + char if not char.isalnum() and not char.isspace() and char.isascii() else char


@dataclass(frozen=True)
class CleanOptions:
    remove_html_tags: bool = True
    remove_urls: bool = False
    remove_emails: bool = False
    remove_phone_numbers: bool = False
    remove_emojis: bool = False
    remove_line_numbers: bool = False
    remove_page_numbers: bool = False
    remove_special_chars: bool = False
    special_chars_to_remove: str = ""
    special_chars_to_preserve: str = PRESERVED
    custom_patterns: tuple[str, ...] = ()
    normalize_whitespace: bool = True
    max_consecutive_newlines: int = 2
    min_line_length: int = 0


class TextCleaner:
    """Column -> Column. Options given to ``process`` override those of the constructor. Null stays null.

    Custom patterns that are not regular expressions are left out.
    """

    name = "text_cleaner"

    def __init__(self, options: CleanOptions | None = None, **changes):
        self.options = replace(options or CleanOptions(), **changes)

    def process(self, c: str | Column, **changes) -> Column:
        o, out = replace(self.options, **changes), col(c)
        for on, step in (
            (o.remove_html_tags, remove_html), (o.remove_urls, remove_urls), (o.remove_emails, remove_emails),
            (o.remove_phone_numbers, remove_phones), (o.remove_emojis, remove_emojis),
            (o.remove_line_numbers, remove_line_numbers), (o.remove_page_numbers, remove_page_numbers),
        ):
            out = step(out) if on else out
        if o.remove_special_chars:
            out = remove_special_chars(out, o.special_chars_to_preserve, o.special_chars_to_remove)
        for pattern in o.custom_patterns:
            try:
                re.compile(pattern)
            except re.error:
                continue
            out = F.regexp_replace(out, pattern, "")
        if o.normalize_whitespace:
            out = normalize_whitespace(out, o.max_consecutive_newlines)
        if o.min_line_length > 0:
            out = drop_short_lines(out, o.min_line_length)
        return strip(out)

    __call__ = process
