"""Readers on generated files, the registry, archives, the pipeline, configuration, sinks and streams."""

import io
import json
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import schema
from docloom.functions import metadata
from docloom.functions.clean import TextCleaner
from docloom.operators import evaluation
from docloom.plans import config
from docloom.plans.config import ChunkerSettings
from docloom.plans.pipeline import Pipeline, batch_summary, failed_files, notify, run_benchmark
from docloom.sources import binary, registry, samples, sinks

OFFICE = "http://schemas.openxmlformats.org"


def files(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    w = f'xmlns:w="{OFFICE}/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    core = '<c:coreProperties xmlns:c="x" xmlns:dc="y"><dc:title>T</dc:title><dc:creator>A</dc:creator></c:coreProperties>'
    body = f"<w:document {w}><w:body>{p('one')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>"
    return files({"word/document.xml": body, "word/header1.xml": f"<w:hdr {w}>{p('head')}</w:hdr>", "word/footer1.xml": f"<w:ftr {w}>{p('foot')}</w:ftr>", "docProps/core.xml": core})


def pptx():
    ns = f'xmlns:p="{OFFICE}/presentationml/2006/main" xmlns:a="{OFFICE}/drawingml/2006/main" xmlns:r="{OFFICE}/officeDocument/2006/relationships"'
    rel = lambda *t: f'<Relationships xmlns="{OFFICE}/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{x}"/>' for i, x in enumerate(t)) + "</Relationships>"
    slide = lambda t: f"<p:sld {ns}><p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"
    return files({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r0"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel("slides/slide1.xml", "slides/slide2.xml"),
        "ppt/slides/slide1.xml": slide("second"), "ppt/slides/slide2.xml": slide("first"), "ppt/slides/_rels/slide2.xml.rels": rel("../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": slide("note"),
    })


def xlsx():
    s, r = f'xmlns="{OFFICE}/spreadsheetml/2006/main"', f'xmlns:r="{OFFICE}/officeDocument/2006/relationships"'
    return files({
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S1" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{OFFICE}/package/2006/relationships"><Relationship Id="r0" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t> </t></is></c></row><row r="3"><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })


def hwpx():
    ns = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
    return files({f"Contents/section{n}.xml": f"<s {ns}><hp:p><hp:t>part {n}</hp:t></hp:p>" + ("<hp:tbl><hp:tr><hp:tc><hp:t>c</hp:t></hp:tc></hp:tr></hp:tbl>" if n == 0 else "") + "</s>" for n in (0, 1, 2, 10)} | {"Contents/content.hpf": "<x/>"})


def compound(streams):
    """A compound file with small streams in the mini stream: one storage level, entries chained to the right."""
    entries, mini, mini_fat = [], b"", []

    def entry(name, kind, left, right, child, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    none = 0xFFFFFFFF
    placed = []
    for _, body in streams:
        first = len(mini_fat)
        n = max(1, -(-len(body) // 64))
        mini_fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        mini += body.ljust(n * 64, b"\0")
        placed.append((first, len(body)))
    mini = mini.ljust(-(-len(mini) // 512) * 512, b"\0")
    k = len(mini) // 512
    # 1: FileHeader -> right 2: BodyText storage -> child 3: Section0
    entries = [entry("Root Entry", 5, none, none, 1, 3, len(mini)), entry("FileHeader", 2, none, 2, none, *placed[0]), entry("BodyText", 1, none, none, 3, 0, 0), entry("Section0", 2, none, none, none, *placed[1])]
    directory = b"".join(entries)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *range(4, 3 + k), 0xFFFFFFFE]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0, 0)
    head = head[:76] + struct.pack("<109I", 0, *[none] * 108)
    pad = lambda x: struct.pack(f"<{len(x)}I", *x).ljust(512, b"\xff")
    return head + pad(fat) + directory + pad(mini_fat) + mini


def hwp():
    text = "가나\nx".encode("utf-16-le")
    text = struct.pack("<H", 2) + b"\0" * 12 + text + struct.pack("<H", 13)
    raw = struct.pack("<I", 67 | len(text) << 20) + text + struct.pack("<I", 66 | 2 << 20) + b"zz"
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    return compound([("FileHeader", b"HWP".ljust(36, b"\0") + b"\x01"), ("Section0", packed.compress(raw) + packed.flush())])


def test_office():
    d = binary.parse_docx(docx())
    assert d["content"] == "head\n\none\n\ntwo\n\nfoot" and d["tables"][0]["data"] == [["a", "b"]] and d["metadata"] == {"title": "T", "author": "A"}
    p = binary.parse_pptx(pptx())
    assert p["content"] == "[Slide 1]\nfirst\n\n[Notes]\nnote\n\n---\n\n[Slide 2]\nsecond" and p["metadata"]["page_count"] == 2
    x = binary.parse_xlsx(xlsx())
    assert x["content"] == "[Sheet: S1]\nname |  | 2\n | True | " and x["tables"][0]["row_count"] == 2
    assert binary.parse_xlsx(xlsx(), preserve_structure=False, max_rows=1)["content"] == "[Sheet: S1]\nname 2"
    assert binary.parse_xlsx(xlsx(), include_formulas=True, sheets=["S1", "no"])["content"].startswith("[Sheet: S1]\nname |  | =1+1")
    for f in (binary.parse_docx, binary.parse_pptx, binary.parse_xlsx):
        with pytest.raises(ValueError):
            f(b"not a zip")


def test_hancom():
    h = binary.parse_hwpx(hwpx())
    assert h["content"] == "part 0\nc\n\npart 1\n\npart 10\n\npart 2" and h["metadata"] == {"page_count": 4} and h["tables"][0]["data"] == [["c"]]
    assert binary.parse_hwp(hwp())["content"] == "가나\nx"
    with pytest.raises(ValueError):
        binary.parse_hwp(b"x" * 600)


def test_registry():
    r = registry.REGISTRY.copy()
    assert r.is_supported("a/b.PDF") and r.for_file("noext") is None and r.for_file("a.xyz") is None and r.for_type("image") is binary.parse_image and r.for_type("text")

    @registry.register_parser("rows", ["csv"], r)
    def rows(data):
        return {"content": " | ".join(data.decode().split(",")), "metadata": {}, "tables": [], "images": []}

    assert r.for_extension(".CSV")(b"a,b")["content"] == "a | b" and "rows" in r.names()
    r.unregister("rows")
    assert r.for_extension("csv") is None
    with pytest.raises(KeyError):
        r.get("rows")
    r.clear()
    assert r.names() == [] and r.extensions() == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "sub").mkdir()
    for name, body in {"a.docx": docx(), "b.pptx": pptx(), "c.xlsx": xlsx(), "d.hwpx": hwpx(), "e.hwp": hwp(), "f.html": b"<title>T</title><p>x  y", "sub/g.md": b"---\ntitle: M\n---\n# H\n**b**", "h.txt": "é".encode("cp1252"), "i.docx": b"broken", "j.xyz": b"?"}.items():
        (d / name).write_bytes(body)
    return str(d)


def test_pipeline_over_files(spark, folder):
    p = Pipeline((TextCleaner(),), ChunkerSettings("sliding", 10, 2), parser_options={"markdown": {"preserve_structure": False}})
    out = p.process_directory(spark, folder)
    got = {r.source_path.rpartition("/")[2]: r for r in out.collect()}
    assert len(got) == 10 and {k for k, r in got.items() if not r.success} == {"i.docx", "j.xyz"} and "no parser" in got["j.xyz"].error
    assert got["f.html"].content == "T\nx y" and got["g.md"].content == "H\nb" and got["h.txt"].content == "é" and got["g.md"].metadata["title"] == "M"
    assert len(got["a.docx"].chunks) == 3 and got["a.docx"].word_count == 4 and got["i.docx"].chunks in (None, [])
    s = batch_summary(out).first()
    assert (s.total, s.successful, s.failed, s.success_rate) == (10, 8, 2, 0.8)
    assert {r.source_path.rpartition("/")[2] for r in failed_files(out).collect()} == {"i.docx", "j.xyz"}
    seen, bad, good = [], [], []
    assert notify(out, lambda n, total, path: seen.append((n, total)), lambda path, error: bad.append(error), lambda row: good.append(row.content)) == 10
    assert seen == [(i, 10) for i in range(1, 11)] and len(bad) == 2 and len(good) == 8 and notify(out.where("false")) == 0
    with pytest.raises(Exception, match="no parser"):
        p.set_error_strategy("raise").process_directory(spark, folder, extensions=["xyz"]).collect()
    assert p.process_directory(spark, folder, recursive=False, pattern="*.md").count() == 0


def test_archives(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(files({"../evil.txt": "1", "b.txt": "2"}))
    with tarfile.open(tmp_path / "y.tar", "w") as t:
        i = tarfile.TarInfo("c.txt")
        i.size = 1
        t.addfile(i, io.BytesIO(b"3"))
    (tmp_path / "z.zip").write_bytes(b"broken")
    got = {r.path.rpartition("!/")[2]: bytes(r.content) for r in registry.read_archives(registry.read_files(spark, str(tmp_path))).collect()}
    assert got == {"../evil.txt": b"1", "b.txt": b"2", "c.txt": b"3"}


def test_detection(spark):
    df = spark.createDataFrame([("a", bytearray(b"%PDF-1")), ("b", bytearray(b"\xef\xbb\xbfx")), ("c", bytearray(b"\xe9")), ("d", bytearray("é".encode()))], "k string, v binary")
    got = {r.k: (r.m, r.e) for r in df.select("k", registry.detect_magic("v").alias("m"), registry.detect_encoding("v").alias("e")).collect()}
    assert got == {"a": ("pdf", "utf-8"), "b": (None, "utf-8-sig"), "c": (None, "cp1252"), "d": (None, "utf-8")}
    paths = spark.createDataFrame([("x/t.HTM", 500), ("..md", 1536), ("csv", 9472), ("test.unknown", 5 << 40)], "p string, n long")
    assert [tuple(r) for r in paths.select(schema.document_type("p"), schema.format_size("n")).collect()] == [("html", "500.0 B"), ("markdown", "1.5 KB"), ("text", "9.2 KB"), ("unknown", "5.0 TB")]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SIZE_NAME", "sliding")
    (tmp_path / "c.json").write_text(json.dumps({"chunker": {"strategy": "${SIZE_NAME}", "chunk_size": 50, "chunk_overlap": 10}, "cleaner": {"remove_urls": True}, "error_strategy": "${NOPE:-log}"}))
    s = config.load(str(tmp_path / "c.json"))
    assert (s.chunker.strategy, s.cleaner.remove_urls, s.error_strategy) == ("sliding", True, "log")
    config.save(s, str(tmp_path / "d.json"))
    assert config.load(str(tmp_path / "d.json")) == s
    for bad in ({"chunkers": {}}, {"cleaner": {"x": 1}}, {"error_strategy": "x"}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.ini") if (tmp_path / "c.ini").write_text("") == 0 else "")
    assert len(config.config_hash({"b": 1, "a": 2})) == 8 and len(config.default_configs()) == 5
    with pytest.raises(ValueError):
        ChunkerSettings("other").column("x")


def test_sinks(spark, tmp_path):
    docs = spark.sql("select 'd' as doc_id, 's' as source, 'c' as content, array(struct('p' as content, 0 as index, 0 as start_char, 1 as end_char)) as chunks union all select 'e', 's', 'whole', array()")
    rows = {r.page_content: r.metadata for r in sinks.langchain_documents(docs).collect()}
    assert rows["whole"] == {"source": "s", "doc_id": "e"} and rows["p"]["chunk_index"] == "0"
    chunks = spark.sql("select 'd' as doc_id, 's' as source, 'p' as content, 0 as index, 0 as start_char, 1 as end_char, map('source', 'mine') as meta")
    assert sinks.langchain_rows(chunks, metadata="meta").first().metadata["source"] == "mine"
    assert sinks.llamaindex_rows(chunks).first().doc_id == "d_0"
    table = spark.sql("select 1 as id, cast(null as string) as title, map('k', 'v') as custom")
    assert sinks.csv_table(table, ("id", "title", "nope"), "custom").first().asDict() == {"id": "1", "title": "", "nope": "", "k": "v"}
    results = spark.sql("select 'a' as source_path, true as success, cast(null as string) as error union all select 'b', false, 'bad'")
    sinks.write_results(results, str(tmp_path / "r"))
    assert sorted(json.loads(r.value).get("error", "") for r in spark.read.text(str(tmp_path / "r")).collect()) == ["", "bad"]
    sinks.write_jsonl(chunks, str(tmp_path / "j"))
    sinks.write_csv(sinks.csv_table(table, ("id",)), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_document_json(spark):
    text = json.dumps({"id": "1", "content": "é", "doc_type": "text", "metadata": {"title": "T", "custom": {"a": "b"}}, "chunks": [{"content": "é", "index": 0, "embedding": [1.0]}], "raw_content": "00ff", "tables": [], "images": []})
    d = spark.createDataFrame([(text,)], "j string").select(schema.parse_document_json("j").alias("document"))
    back = json.loads(d.select(schema.document_json().alias("j")).first().j)
    assert back["raw_content"] == "00ff" and back["metadata"] == {"title": "T", "custom": {"a": "b"}} and "embedding" not in back["chunks"][0] and back["chunks"][0]["length"] == 1


def test_stream(spark, tmp_path):
    from docloom import streaming

    spark.createDataFrame([(1, "A b c. " * 20)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = streaming.stream_texts(spark, str(tmp_path / "in"), "doc_id long, text string")
    plan = streaming.process_stream(source, Pipeline((TextCleaner(),), ChunkerSettings("sentence", 30, 0)), "text").select("doc_id", F.explode("chunks").alias("c"))
    streaming.write_chunks(plan, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 1


@pytest.mark.parametrize("kind", list(samples.KINDS))
def test_samples_round_trip(spark, kind):
    """Files of every binary format, short, empty and long, with letters of several scripts and marks that XML escapes."""
    lines = ["a < b & c", "", "  \tindented", "가나 é 中文", *[f"line {i} " + "x" * (i % 90) for i in range(1500)]]
    docs = spark.createDataFrame([(1, "\n".join(lines), "T & <t>"), (2, "", ""), (3, None, None)], "doc_id long, text string, source string")
    got = {r.source_path: r for r in registry.parse_files(samples.sample_files(docs, kind)).collect()}
    whole = got[f"/samples/1.{kind}"]
    assert whole.success and whole.doc_type == kind and all(r.success for r in got.values())
    found = iter(whole.content.split("\n"))
    assert all(any(x.strip() in y for y in found) for x in lines if x.strip())
    assert kind == "hwpx" or whole.metadata["title"] == "T & <t>"


def test_summary_properties():
    data = samples.hwp(["x"], "Title")
    assert binary.parse_hwp(data)["metadata"] == {"title": "Title", "author": "docloom", "page_count": 1}
    assert binary.property_set(samples._properties({2: "é", 9: "3"})) == {2: "é", 9: "3"}


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "x", 1), ("c", None, 2)], "id string, content string, n int")
    paths = sorted(r.path for r in sinks.write_documents(docs, str(tmp_path / "out")).collect())
    assert [p.rpartition("/")[2] for p in paths] == ["a%2Fb.json", "c.json"] and json.loads(open(paths[0]).read()) == {"id": "a/b", "content": "x", "n": 1}
    chunks = spark.createDataFrame(
        [("p", "m1", "one", 0, [1.0, 0.0]), ("p", "m1", "three", 1, [0.0, 1.0]), ("q", "m2", "one", 0, [1.0, 1.0])], "config_name string, model string, text string, idx int, vector array<double>")
    report = evaluation.embedding_report(chunks)
    details = {r.config_name: tuple(r)[1:] for r in report["config_details"].collect()}
    assert details == {"p": ("m1", 2, 2, 4.0), "q": ("m2", 2, 1, 3.0)}
    sinks.write_report(report, str(tmp_path / "report"))
    whole = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect()))
    assert set(whole) == {"config_details", "comparisons"} and whole["comparisons"][0]["matching_chunks"] == 1 and (whole["comparisons"][0]["config_a"], whole["comparisons"][0]["config_b"]) == ("p", "q")


def test_update_metadata(spark):
    kinds = "d struct<title:string,language:string,word_count:long,char_count:long,custom:map<string,string>>, e struct<title:string,language:string,word_count:long,char_count:long,keywords:array<string>,sentence_count:int,paragraph_count:int,reading_time_minutes:double>"
    extracted = ("Found", None, 5, 20, ["k", "l"], 2, 1, 0.5)
    rows = [((None, "en", 0, 0, None), extracted), (("Own", None, 0, 0, {"a": "b", "keywords": "old"}), ("Found", "fr", *extracted[2:]))]
    got = [r.m for r in spark.createDataFrame(rows, kinds).select(metadata.update_document_metadata(F.col("d"), F.col("e")).alias("m")).collect()]
    added = {"keywords": "k, l", "sentence_count": "2", "paragraph_count": "1", "reading_time_minutes": "0.5"}
    assert tuple(got[0]) == ("Found", "en", 5, 20, added) and tuple(got[1]) == ("Own", "fr", 5, 20, {"a": "b"} | added)


@pytest.mark.parametrize(("metric", "block"), [("cosine", 1000), ("cosine", 2), ("euclidean", 1000)])
def test_nearest_vectors(spark, metric, block):
    g = np.random.Generator(np.random.PCG64(3))
    items = [(i, g.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)] + [(300, [0.0] * 4), (301, None)]
    queries = [(f"q{i}", items[i * 7][1]) for i in range(6)]
    corpus = spark.createDataFrame(items, "item_id long, vector array<double>").repartition(5)
    got = evaluation.top_k(spark.createDataFrame(queries, "query_id string, query_vector array<double>"), corpus, 7, metric, max_queries=block).collect()
    for name, q in queries:
        x = np.array([v for _, v in items[:301]])
        norm = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        score = np.where(norm > 0, x @ q / np.where(norm > 0, norm, 1), 0.0) if metric == "cosine" else np.linalg.norm(x - q, axis=1)
        want = sorted(range(301), key=lambda i: (round(-score[i] if metric == "cosine" else score[i], 9), i))[:7]
        own = sorted((r for r in got if r.query_id == name), key=lambda r: r["rank"])
        assert [round(r.score, 9) for r in own] == [round(score[i], 9) for i in want] and len({r.item_id for r in own}) == 7
    texts = spark.createDataFrame([("t", "2")], "query_id string, query_vector string")
    found = evaluation.top_k(texts, corpus, 1, embed=lambda ts: [items[int(t)][1] for t in ts]).first()
    assert found.item_id == 2 or found.score > 0.999999
    with pytest.raises(Exception, match="differ in length"):
        evaluation.top_k(spark.createDataFrame([("t", [1.0])], "query_id string, query_vector array<double>"), corpus).collect()


def test_benchmark_hooks(spark):
    """Parse and embed functions around the benchmark's cleaning and chunking."""
    raw = spark.createDataFrame([(1, b"ab cd"), (2, b"ef")], "doc_id long, content binary")
    out = run_benchmark(
        raw, {"s": ChunkerSettings("sliding", 2, 0)}, F.upper, parse=lambda df: df.select("doc_id", F.col("content").cast("string").alias("text")), embed=lambda c: F.array(F.length(c).cast("double")))
    assert sorted((r.document, r.content, r.vector) for r in out.collect()) == [(1, "AB", [2.0]), (1, "C", [1.0]), (1, "D", [1.0]), (2, "EF", [2.0])]
