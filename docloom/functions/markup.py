"""Markdown and HTML as Column expressions. Markdown and href rules are native; an HTML tree needs Python (Arrow-batched)."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrow import each
from docloom.functions.text import WS, col, strip

LINK, IMAGE = r"\[([^\]]+)\]\(([^)]+)\)", r"!\[([^\]]*)\]\(([^)]+)\)"
#: (pattern, replacement) in order. Links go before images, so the marks of an image with a caption stay.
MARKDOWN_RULES = (
    (rf"(?md)^#{{1,6}}{WS}+", ""), (r"(?d)\*\*(.+?)\*\*", "$1"), (r"(?d)\*(.+?)\*", "$1"), (r"(?d)__(.+?)__", "$1"), (r"(?d)_(.+?)_", "$1"),
    (LINK, "$1"), (IMAGE, ""), (r"`([^`]+)`", "$1"), (rf"(?md)^>{WS}+", ""), (rf"(?md)^[-*_]{{3,}}{WS}*$", ""),
)


def strip_markdown(c: str | Column) -> Column:
    out = col(c)
    for pattern, to in MARKDOWN_RULES:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def remove_code_blocks(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"(?s)```.*?```", ""), r"(?s)~~~.*?~~~", "")


def _pairs(c: Column, pattern: str, names: tuple[str, str]) -> Column:
    a, b = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1])))


def markdown_links(c: str | Column) -> Column:
    return _pairs(col(c), LINK, ("text", "url"))


def markdown_images(c: str | Column) -> Column:
    return _pairs(col(c), IMAGE, ("alt", "src"))


def split_frontmatter(c: str | Column) -> Column:
    """Struct (frontmatter, body): what stands between two leading ``---``, else null and the text."""
    text = col(c)
    parts = F.split(text, "---", 3)
    has = text.startswith("---") & (F.size(parts) == 3)
    return F.struct(F.when(has, F.get(parts, 1)).alias("frontmatter"), F.when(has, strip(F.get(parts, 2))).otherwise(text).alias("body"))


def frontmatter_fields(c: str | Column) -> Column:
    """Flat ``key: value`` lines as a map; quotes around values go."""
    pairs = F.transform(F.filter(F.split(col(c), "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:")), lambda x: F.struct(
        strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v")))
    return F.map_from_entries(pairs)


def markdown_title(c: str | Column, frontmatter: Column | None = None) -> Column:
    """The title of the front matter, else the first ``#`` heading, even inside code."""
    heading = F.nullif(strip(F.regexp_extract(col(c), rf"(?md)^#{WS}+(.+)$", 1)), F.lit(""))
    return heading if frontmatter is None else F.coalesce(F.nullif(frontmatter["title"], F.lit("")), heading)


def html_hrefs(c: str | Column) -> Column:
    """href values of links, in order, by a regular expression."""
    return F.regexp_extract_all(col(c), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def html_title(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(?is)<title[^>]*>([^<]*)</title>", 1), F.lit(""))


def html_meta(c: str | Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(col(c), rf'(?i)<meta [^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
#: Tags that end an open element of the key's name.
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"])}


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def texts(self):
        """All text, in order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    yield x
                else:
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [x for x in reversed(n.children) if not isinstance(x, str)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if self.open[-1].tag in CLOSED_BY and tag in CLOSED_BY[self.open[-1].tag]:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


HTML = "struct<content:string,title:string,author:string,meta:map<string,string>,links:array<struct<text:string,href:string>>,images:array<struct<src:string,alt:string,title:string>>>"


def parse_html(markup: str, structured: bool = False, links: bool = True, images: bool = False, scripts: bool = False, styles: bool = False) -> dict:
    """Text, metadata, links and images of one page. ``scripts``/``styles``: keep their text."""
    import re

    tree = _Tree()
    tree.feed(markup)
    tree.close()
    drop = {t for t, keep in (("script", scripts), ("style", styles)) if not keep}
    for n in tree.root.walk():
        n.children = [x for x in n.children if isinstance(x, str) or x.tag not in drop]
    nodes = list(tree.root.walk())
    meta: dict[str, str] = {}
    for n in nodes:
        key = n.attrs.get("name") or n.attrs.get("property") if n.tag == "meta" else None
        if key and n.attrs.get("content"):
            meta[key] = n.attrs["content"]
    head = next((n for n in nodes if n.tag == "title"), None)
    title = head.children[0] if head and len(head.children) == 1 and isinstance(head.children[0], str) else None
    if structured:
        lines = []
        for n in nodes:
            if n.tag in BLOCKS and (t := "".join(x.strip() for x in n.texts())):
                lines.append(f"\n{'#' * int(n.tag[1])} {t}\n" if n.tag[0] == "h" else f"• {t}" if n.tag == "li" else t)
        content = "\n".join(lines)
    else:
        content = "\n".join(t for t in (x.strip() for x in tree.root.texts()) if t)
    return {
        "content": re.sub(r"\n{3,}", "\n\n", content).strip(), "title": title or meta.get("og:title"), "author": meta.get("author"), "meta": meta,
        "links": [dict(text="".join(x.strip() for x in n.texts()), href=n.attrs["href"]) for n in nodes if n.tag == "a" and n.attrs.get("href")] if links else [],
        "images": [dict(src=n.attrs.get("src", ""), alt=n.attrs.get("alt", ""), title=n.attrs.get("title", "")) for n in nodes if n.tag == "img"] if images else [],
    }


def html(c: str | Column, **options) -> Column:
    """Struct of content, title, author, meta, links, images; see ``parse_html`` for the options. Null stays null."""
    def one(page: str | None) -> dict:
        if page is None:
            return dict.fromkeys(("content", "title", "author", "meta", "links", "images"))
        found = parse_html(page, **options)
        return found | {"meta": list(found["meta"].items())}

    return each(col(c), HTML, one)
