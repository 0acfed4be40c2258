"""Small files of the binary formats from paragraphs of text, to try the readers on: ``make(kind, lines, title)`` gives bytes.

They hold what the readers look for and no more; XML characters are escaped, control characters that XML forbids are dropped.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import parts

_OFFICE = "http://schemas.openxmlformats.org"
_RELATIONS = f"{_OFFICE}/officeDocument/2006/relationships"
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _xml(text: str) -> str:
    return escape(_FORBIDDEN.sub("", text), {"\r": "&#13;"})


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _core(title: str) -> str:
    return f'<c:coreProperties xmlns:c="x" xmlns:dc="y"><dc:title>{_xml(title)}</dc:title></c:coreProperties>'


def _rels(*targets: str) -> str:
    rows = "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets))
    return f'<Relationships xmlns="{_OFFICE}/package/2006/relationships">{rows}</Relationships>'


def docx(lines: list[str], title: str) -> bytes:
    """A paragraph for each line, and a table of one row with the title."""
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{_xml(t)}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('title')}</w:tc><w:tc>{p(title)}</w:tc></w:tr></w:tbl>"
    body = "".join(map(p, lines)) + table
    return _zip({"word/document.xml": f'<w:document xmlns:w="{_OFFICE}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>', "docProps/core.xml": _core(title)})


def pptx(lines: list[str], title: str) -> bytes:
    """A slide with the title, and one with a paragraph for each line and the title as notes."""
    ns = f'xmlns:p="{_OFFICE}/presentationml/2006/main" xmlns:a="{_OFFICE}/drawingml/2006/main" xmlns:r="{_RELATIONS}"'
    frame = lambda ts: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{_xml(t)}</a:t></a:r></a:p>" for t in ts) + "</p:txBody></p:sp>"
    slide = lambda ts: f"<p:sld {ns}>{frame(ts)}</p:sld>"
    return _zip({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r0"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels("slides/slide1.xml", "slides/slide2.xml"), "ppt/slides/slide1.xml": slide([title]), "ppt/slides/slide2.xml": slide(lines),
        "ppt/slides/_rels/slide2.xml.rels": _rels("../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": slide([title]), "docProps/core.xml": _core(title),
    })


def xlsx(lines: list[str], title: str) -> bytes:
    """A sheet with a row for each line: its number, and the line."""
    s = f'xmlns="{_OFFICE}/spreadsheetml/2006/main"'
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t xml:space="preserve">{_xml(t)}</t></is></c></row>' for i, t in enumerate(lines, 1))
    return _zip({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="{_RELATIONS}"><sheets><sheet name="lines" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _rels("worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>", "docProps/core.xml": _core(title),
    })


def hwpx(lines: list[str], title: str) -> bytes:
    """A section with the title, and one with a paragraph for each line."""
    ns = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
    section = lambda ts: f"<s {ns}>" + "".join(f"<hp:p><hp:t>{_xml(t)}</hp:t></hp:p>" for t in ts) + "</s>"
    return _zip({"Contents/section0.xml": section([title]), "Contents/section1.xml": section(lines), "Contents/content.hpf": "<x/>"})


_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file; a name may have one folder. Streams of 4,096 bytes or more have sectors of their own, others share the mini stream."""
    sectors: list[bytes] = []
    chain: list[int] = []

    def place(body: bytes) -> int:
        n = -(-len(body) // 512)
        if not n:
            return _END
        first = len(sectors)
        sectors.extend(body[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n))
        chain.extend([*range(first + 1, first + n), _END])
        return first

    mini, mini_chain, placed = b"", [], {}
    for name, body in streams.items():
        if len(body) >= 4096:
            placed[name] = place(body)
        else:
            n, first = max(1, -(-len(body) // 64)), len(mini_chain)
            mini_chain += [*range(first + 1, first + n), _END]
            mini += body.ljust(n * 64, b"\0")
            placed[name] = first
    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    top = [n for n in streams if "/" not in n] + folders
    nodes = ["", *top, *[n for n in streams if "/" in n]]

    def entry(i: int) -> bytes:
        name = nodes[i]
        short = (name.split("/")[-1] if name else "Root Entry").encode("utf-16-le") + b"\0\0"
        inside = [k for k, n in enumerate(nodes) if n.startswith(f"{name}/")] if name in folders else range(1, len(top) + 1) if not name else []
        siblings = range(1, len(top) + 1) if "/" not in name else [k for k, n in enumerate(nodes) if n.startswith(name.split("/")[0] + "/")]
        right = next((k for k in siblings if k > i), _FREE) if name else _FREE
        kind = 5 if not name else 1 if name in folders else 2
        start, size = (place(mini), len(mini)) if not name else (0, 0) if name in folders else (placed[name], len(streams[name]))
        return short.ljust(64, b"\0") + struct.pack("<HBBIII", len(short), kind, 1, _FREE, right, next(iter(inside), _FREE)) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = place(b"".join(entry(i) for i in range(len(nodes))))
    mini_fat = place(struct.pack(f"<{len(mini_chain)}I", *mini_chain).ljust(-(-len(mini_chain) // 128) * 512, b"\xff"))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    at = [len(sectors) + i for i in range(n_fat)]
    fat = struct.pack(f"<{len(chain) + n_fat}I", *chain, *[0xFFFFFFFD] * n_fat).ljust(n_fat * 512, b"\xff")
    if n_fat > 109:
        raise ValueError("too large for a sample")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", n_fat, directory, 0, 4096, mini_fat, -(-len(mini_chain) // 128), _END, 0, 0)
    return head[:76] + struct.pack("<109I", *at, *[_FREE] * (109 - n_fat)) + b"".join(sectors) + fat


def _properties(values: dict[int, str]) -> bytes:
    """A property set of one section, strings only."""
    body, offsets = b"", []
    for key, value in values.items():
        offsets.append((key, 8 + 8 * len(values) + len(body)))
        text = value.encode("utf-16-le") + b"\0\0"
        body += (struct.pack("<II", 31, len(text) // 2) + text).ljust(-(-(8 + len(text)) // 4) * 4, b"\0")
    table = b"".join(struct.pack("<II", *x) for x in offsets)
    return struct.pack("<HHI16sI16sI", 0xFFFE, 0, 2, b"", 1, b"", 48) + struct.pack("<II", 8 + len(table) + len(body), len(values)) + table + body


def hwp(lines: list[str], title: str) -> bytes:
    """One section with a paragraph for each line, and the title among the summary's properties."""
    records = b""
    for line in lines:
        text = "".join(c for c in line if c >= " " and c <= "￿").encode("utf-16-le") + struct.pack("<H", 13)
        head = struct.pack("<I", 67 | min(len(text), 0xFFF) << 20) + (struct.pack("<I", len(text)) if len(text) >= 0xFFF else b"")
        records += head + text
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    return compound({
        "FileHeader": b"HWP".ljust(36, b"\0") + b"\x01" + b"\0" * 3, "\x05HwpSummaryInformation": _properties({2: title, 4: "docloom"}),
        "BodyText/Section0": packed.compress(records) + packed.flush()})


KINDS: dict[str, Callable[[list[str], str], bytes]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "hwpx": hwpx, "hwp": hwp}


def make(kind: str, lines: list[str], title: str) -> bytes:
    return KINDS[kind](lines, title)


def sample_files(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text", title_col: str = "source") -> DataFrame:
    """(path, content) as ``binaryFile`` rows have them: one file per document, named by its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                some = part.to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"/samples/{r['i']}.{kind}" for r in some]), pa.array([make(kind, (r["t"] or "").split("\n"), r["n"] or "") for r in some], pa.binary())], ["path", "content"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(title_col).alias("n")).mapInArrow(run, "path string, content binary")
