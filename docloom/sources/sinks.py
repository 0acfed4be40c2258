"""Output shapes and writers: JSON, JSON lines, CSV, and the record shapes of two retrieval frameworks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("id", "title", "author", "doc_type", "word_count", "char_count", "chunk_count", "source_path")


def csv_table(docs: DataFrame, columns: Sequence[str] = CSV_COLUMNS, custom: str | None = None) -> DataFrame:
    """The columns as strings, empty where null or unknown; the keys of the map ``custom`` follow, each as a column (one distinct pass over keys)."""
    out = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c) for c in columns]
    if custom:
        keys = [r[0] for r in docs.select(F.explode(F.map_keys(custom)).alias("k")).distinct().orderBy("k").collect()]
        out += [F.coalesce(F.col(custom)[k], F.lit("")).alias(k) for k in keys if k not in columns]
    return docs.select(*out)


def langchain_rows(chunks: DataFrame, doc_id: str = "doc_id", source: str = "source", metadata: str | None = None) -> DataFrame:
    """(page_content, metadata): one row per chunk; the chunk's own metadata wins."""
    own = {"source": F.col(source), "doc_id": F.col(doc_id), "chunk_index": F.col("index"), "start_char": F.col("start_char"), "end_char": F.col("end_char")}
    if "page_number" in chunks.columns:
        own["page_number"] = F.col("page_number")
    base = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("string"))])
    if metadata:
        extra = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
        base = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    return chunks.select(F.col("content").alias("page_content"), base.alias("metadata"))


def langchain_documents(docs: DataFrame, chunks: str = "chunks", doc_id: str = "doc_id", source: str = "source", content: str = "content") -> DataFrame:
    """As ``langchain_rows``, from an array of chunks; a document without chunks is one row with its own content."""
    c = docs.select("*", F.explode_outer(chunks).alias("_c"))
    has = F.col("_c").isNotNull()
    fields = {"source": F.col(source), "doc_id": F.col(doc_id)} | {k: F.col("_c")[f] for k, f in (("chunk_index", "index"), ("start_char", "start_char"), ("end_char", "end_char"))}
    meta = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    return c.select(F.when(has, F.col("_c")["content"]).otherwise(F.col(content)).alias("page_content"), meta.alias("metadata"))


def llamaindex_rows(chunks: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(text, doc_id, extra_info): ids are the document's with the chunk's index."""
    info = {"source": F.col(source), "parent_doc_id": F.col(doc_id), "chunk_index": F.col("index"), "start_char": F.col("start_char"), "end_char": F.col("end_char")}
    return chunks.select(
        F.col("content").alias("text"), F.concat_ws("_", F.col(doc_id).cast("string"), F.col("index").cast("string")).alias("doc_id"),
        F.create_map(*[x for k, v in info.items() for x in (F.lit(k), v.cast("string"))]).alias("extra_info"))


def json_text(c: Column, pretty: bool = False) -> Column:
    return F.to_json(c, {"pretty": "true"} if pretty else {})


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("emptyValue", "").option("quoteAll", False).option("escape", '"').csv(path)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Successes and failures as JSON lines in one folder; failures carry source, error and success = false."""
    ok = results.where("success").select(F.to_json(F.struct(*[c for c in results.columns if c not in ("error",)])).alias("value"))
    bad = results.where("not success").select(F.to_json(F.struct(F.col("source_path").alias("source"), "error", "success")).alias("value"))
    ok.unionByName(bad).write.mode(mode).text(path)


def write_documents(docs: DataFrame, folder: str, id_col: str = "id", compact: bool = False) -> DataFrame:
    """One file ``<id>.json`` for each row, written by the tasks; (path) of each when the result is read. A task that is run again writes the same files.

    ``folder`` is a path or a URI that pyarrow knows, and that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(top, recursive=True)
        for batch in batches:
            paths = []
            for name, body in zip(batch.column("n").to_pylist(), batch.column("j").to_pylist(), strict=True):
                paths.append(f"{top}/{quote(name, safe='')}.json")
                with store.open_output_stream(paths[-1]) as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("n"), json_text(F.struct(*docs.columns), not compact).alias("j"))
    return named.mapInArrow(run, "path string")


def write_report(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """A report as one JSON object: a list of rows under each name. Reports have a row for a configuration or a pair of them."""
    report = {name: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()] for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode(mode).text(path)


def langchain_objects(rows: list) -> list:
    """Objects of the framework, if it is installed, for collected ``langchain_rows``."""
    from langchain_core.documents import Document  # optional

    return [Document(page_content=r["page_content"], metadata=dict(r["metadata"])) for r in rows]


def llamaindex_objects(rows: list) -> list:
    from llama_index.core import Document  # optional

    return [Document(text=r["text"], doc_id=r["doc_id"], extra_info=dict(r["extra_info"])) for r in rows]
