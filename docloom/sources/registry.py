"""Readers by format, and tables of documents from files.

A reader is a function of (bytes, **options) that returns a dict with content, metadata, tables and images. Files are read with
``binaryFile`` and parsed in ``mapInArrow``; a file that cannot be parsed is a row with ``success`` false and its error.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom import schema
from docloom.functions.arrow import parts
from docloom.functions.markup import parse_html
from docloom.functions.text import col
from docloom.sources import binary

Parser = Callable[..., dict]


class ParserRegistry:
    """Names to readers and extensions to names. A later registration of an extension overrides an earlier one."""

    def __init__(self):
        self._parsers: dict[str, Parser] = {}
        self._extensions: dict[str, str] = {}

    def register(self, name: str, parser: Parser, extensions: list[str] | tuple[str, ...]) -> None:
        self._parsers[name] = parser
        self._extensions |= {e.lower().lstrip("."): name for e in extensions}

    def unregister(self, name: str) -> None:
        self._parsers.pop(name, None)
        self._extensions = {e: n for e, n in self._extensions.items() if n != name}

    def get(self, name: str) -> Parser:
        return self._parsers[name]

    def for_extension(self, extension: str) -> Parser | None:
        return self._parsers.get(self._extensions.get(extension.lower().lstrip("."), ""))

    def for_file(self, path: str) -> Parser | None:
        name = path.rpartition("/")[2]
        return self.for_extension(name.rpartition(".")[2]) if "." in name else None

    def for_type(self, document_type: str) -> Parser | None:
        """By extension of the same name, or of the same document type, so images and texts are found too."""
        return self.for_extension(document_type) or next((self._parsers[n] for e, n in self._extensions.items() if schema.EXTENSION_TYPES.get(e) == document_type), None)

    def is_supported(self, path: str) -> bool:
        return self.for_file(path) is not None

    def names(self) -> list[str]:
        return sorted(self._parsers)

    def extensions(self) -> list[str]:
        return sorted(self._extensions)

    def clear(self) -> None:
        self._parsers.clear()
        self._extensions.clear()

    def copy(self) -> ParserRegistry:
        out = ParserRegistry()
        out._parsers, out._extensions = dict(self._parsers), dict(self._extensions)
        return out


def _decode(data: bytes, encoding: str | None = None) -> str:
    if encoding:
        return data.decode(encoding, "replace")
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(bom):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def _html(data: bytes, encoding: str | None = None, extract_links: bool = True, extract_images: bool = False, preserve_structure: bool = False) -> dict:
    p = parse_html(_decode(data, encoding), structured=preserve_structure, links=extract_links, images=extract_images)
    meta = {k: v for k, v in (("title", p["title"]), ("author", p["author"]), ("description", p["meta"].get("description") or p["meta"].get("og:description")), ("keywords", p["meta"].get("keywords"))) if v}
    return {"content": p["content"], "metadata": meta, "tables": [], "images": p["images"]}


def _markdown(data: bytes, preserve_structure: bool = True, extract_code_blocks: bool = True) -> dict:
    """Front matter as YAML where that is installed, else its flat fields."""
    import re

    from docloom.functions.markup import MARKDOWN_RULES

    text, front = _decode(data), {}
    parts = text.split("---", 2)
    if text.startswith("---") and len(parts) == 3:
        try:
            import yaml

            front = yaml.safe_load(parts[1]) or {}
            text = parts[2].strip()
        except ImportError:
            front = dict(x.split(":", 1) for x in parts[1].splitlines() if ":" in x)
            text = parts[2].strip()
        except Exception:
            front = {}
    front = front if isinstance(front, dict) else {}
    heading = re.search(r"^#\s+(.+)$", text, re.M)
    title = front.get("title") or (heading[1].strip() if heading else None)
    if not preserve_structure:
        for pattern, to in MARKDOWN_RULES:
            flags = (re.M if "m" in pattern[:5] and pattern.startswith("(?") else 0)
            text = re.sub(re.sub(r"^\(\?\w+\)", "", pattern), to.replace("$1", r"\1"), text, flags=flags)
        text = text.strip()
    if not extract_code_blocks:
        text = re.sub(r"~~~.*?~~~", "", re.sub(r"```.*?```", "", text, flags=re.S), flags=re.S)
    meta = {k: str(v).strip() for k, v in front.items() if isinstance(v, (str, int, float))} | ({"title": str(title).strip()} if title else {})
    return {"content": text, "metadata": meta, "tables": [], "images": []}


def _text(data: bytes, encoding: str | None = None) -> dict:
    return {"content": _decode(data, encoding), "metadata": {}, "tables": [], "images": []}


REGISTRY = ParserRegistry()
for _name, _parser, _ext in (
    ("pdf", binary.parse_pdf, ["pdf"]), ("docx", binary.parse_docx, ["docx", "doc"]), ("pptx", binary.parse_pptx, ["pptx", "ppt"]), ("xlsx", binary.parse_xlsx, ["xlsx", "xls"]),
    ("html", _html, ["html", "htm"]), ("markdown", _markdown, ["md", "markdown"]), ("hwpx", binary.parse_hwpx, ["hwpx"]), ("hwp", binary.parse_hwp, ["hwp"]),
    ("image", binary.parse_image, list(schema.IMAGE_EXTENSIONS)), ("text", _text, ["txt", "csv"]),
):
    REGISTRY.register(_name, _parser, _ext)


def register_parser(name: str, extensions: list[str], registry: ParserRegistry = REGISTRY):
    """Decorator that registers a reading function."""

    def wrap(parser: Parser) -> Parser:
        registry.register(name, parser, extensions)
        return parser

    return wrap


PARSED = (
    "id string, source_path string, doc_type string, success boolean, error string, content string, word_count long, char_count long, file_size long, "
    "metadata map<string,string>, tables array<struct<locator:string,table_index:int,data:array<array<string>>,row_count:int,col_count:int>>, images array<map<string,string>>"
)


def parse_files(files: DataFrame, options: dict[str, dict] | None = None, registry: ParserRegistry = REGISTRY) -> DataFrame:
    """Rows of ``binaryFile`` (path, content, and doc_type if it is known) -> parsed documents (``PARSED``)."""
    import hashlib

    known, per_type = registry.copy(), options or {}

    arrow = to_arrow_schema(T.StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in parts(batch)):
            rows = []
            for r in part.to_pylist():
                path, data = r["path"], r["content"] or b""
                ext = path.rpartition("/")[2].rpartition(".")[2].lower()
                kind = r.get("doc_type") or schema.EXTENSION_TYPES.get(ext, "unknown")
                row = dict(id=hashlib.sha256(path.encode()).hexdigest(), source_path=path, doc_type=kind, success=False, error=None, content=None, word_count=None, char_count=None, file_size=len(data), metadata=[], tables=[], images=[])
                try:
                    parser = known.for_file(path) or known.for_type(kind)
                    if parser is None:
                        raise ValueError(f"no parser for {path}")
                    got = parser(data, **per_type.get(kind, {}))
                    row |= dict(success=True, content=got["content"], word_count=len(got["content"].split()), char_count=len(got["content"]), metadata=[(k, str(v)) for k, v in got["metadata"].items()], tables=got["tables"], images=[list(x.items()) for x in got["images"]])
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    have = ["path", "content"] + (["doc_type"] if "doc_type" in files.columns else [])
    return files.select(*have).mapInArrow(run, PARSED)


def read_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """``binaryFile`` rows below a folder; extensions without a dot."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    out = reader.load(path)
    return out.where(schema.extension("path").isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else out


def read_archives(files: DataFrame) -> DataFrame:
    """(path, content) of the members of zip and tar archives, in memory: no member is written to disk, so none can leave a folder.

    Other files, and archives that cannot be read, give no rows.
    """

    def members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        low = path.lower()
        try:
            if low.endswith((".zip", ".hwpx")):
                z = zipfile.ZipFile(io.BytesIO(data))
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
            elif low.endswith((".tar", ".gz", ".tgz", ".bz2")):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        f = t.extractfile(m) if m.isfile() else None
                        if f:
                            yield m.name, f.read()
        except (zipfile.BadZipFile, tarfile.TarError, OSError):
            return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                for name, body in members(path, bytes(data)):
                    yield pd.DataFrame({"path": [f"{path}!/{name}"], "content": [body]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


MAGIC = (("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("504B0304", "zip"), ("D0CF11E0", "ole"))


def detect_magic(content: str | Column) -> Column:
    """Kind of a binary by its first bytes; null for any other."""
    head = F.hex(F.substring(col(content), 1, 4))
    out = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def detect_encoding(content: str | Column) -> Column:
    head = F.hex(F.substring(col(content), 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8-sig").when(head.startswith("FFFE") | head.startswith("FEFF"), "utf-16").when(F.is_valid_utf8(col(content).cast("string")), "utf-8").otherwise("cp1252")
