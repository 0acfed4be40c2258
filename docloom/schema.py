"""The data model: documents, chunks, tables, images; document types by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import col

DOCUMENT_TYPES = ("pdf", "docx", "pptx", "xlsx", "hwp", "hwpx", "html", "markdown", "image", "text", "unknown")
IMAGE_EXTENSIONS = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
EXTENSION_TYPES = {e: e for e in ("pdf", "docx", "pptx", "xlsx", "hwp", "hwpx", "html", "markdown")} | {
    "doc": "docx", "ppt": "pptx", "xls": "xlsx", "htm": "html", "md": "markdown", "txt": "text", "csv": "text"} | dict.fromkeys(IMAGE_EXTENSIONS, "image")
SUPPORTED_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "hwp", "hwpx", "html", "htm", "md", "txt", "png", "jpg", "jpeg", "gif", "bmp", "tiff")

_S, _L = T.StringType(), T.LongType()
METADATA = T.StructType([T.StructField(n, t) for n, t in (
    ("title", _S), ("author", _S), ("created_at", T.TimestampNTZType()), ("modified_at", T.TimestampNTZType()), ("page_count", _L), ("word_count", _L),
    ("char_count", _L), ("file_size", _L), ("language", _S), ("source_path", _S), ("mime_type", _S), ("encoding", _S), ("custom", T.MapType(_S, _S)))])
CHUNK = T.StructType([T.StructField(n, t) for n, t in (
    ("content", _S), ("index", T.IntegerType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()), ("metadata", T.MapType(_S, _S)),
    ("page_number", T.IntegerType()), ("section", _S), ("embedding", T.ArrayType(T.DoubleType())))])
TABLE = T.StructType([T.StructField(n, t) for n, t in (
    ("locator", _S), ("table_index", T.IntegerType()), ("data", T.ArrayType(T.ArrayType(_S))), ("row_count", T.IntegerType()), ("col_count", T.IntegerType()))])
IMAGE = T.MapType(_S, _S)
DOCUMENT = T.StructType([T.StructField(n, t) for n, t in (
    ("id", _S), ("content", _S), ("doc_type", _S), ("metadata", METADATA), ("chunks", T.ArrayType(CHUNK)), ("raw_content", T.BinaryType()),
    ("tables", T.ArrayType(TABLE)), ("images", T.ArrayType(IMAGE)))])


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def document_type(path_or_extension: str | Column) -> Column:
    """By extension, with or without leading dots; ``unknown`` for any other."""
    c = col(path_or_extension)
    ext = F.lower(F.regexp_replace(F.when(c.contains("."), F.regexp_extract(c, r"(\.[^./]+)$", 1)).otherwise(c), r"^\.+", ""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_TYPES.items() for x in kv]), ext), F.lit("unknown"))


def is_supported(path: str | Column, extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def document_id(path: str | Column) -> Column:
    """The same for the same path on every run."""
    return F.sha2(col(path), 256)


def format_size(size: str | Column) -> Column:
    n = col(size).cast("double")
    out = F.format_string("%.1f PB", F.bround(n / F.lit(1024.0**5), 1))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < F.lit(1024.0 ** (i + 1)), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**i), 1))).otherwise(out)
    return out


def document_json(document: str | Column = "document") -> Column:
    """JSON of a document struct; embeddings are left out, raw content is hexadecimal, null metadata fields are dropped."""
    d = col(document)
    chunks = F.transform(d["chunks"], lambda c: F.struct(
        *[c[n].alias(n) for n in ("content", "index", "start_char", "end_char", "metadata", "page_number", "section")], F.length(c["content"]).alias("length")))
    fields = [d[n].alias(n) for n in ("id", "content", "doc_type", "metadata")] + [chunks.alias("chunks"), d["tables"].alias("tables"), d["images"].alias("images")]
    return F.to_json(F.struct(*fields, F.when(F.length(d["raw_content"]) > 0, F.lower(F.hex(d["raw_content"]))).alias("raw_content")))


def parse_document_json(c: str | Column) -> Column:
    schema = T.StructType([f if f.name != "raw_content" else T.StructField("raw_content", _S) for f in DOCUMENT.fields])
    d = F.from_json(col(c), schema)
    return F.struct(*[(F.unhex(d["raw_content"]) if f.name == "raw_content" else d[f.name]).alias(f.name) for f in DOCUMENT.fields])
