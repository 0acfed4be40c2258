"""Binary document formats, read in memory from ``binaryFile`` rows. Office formats need the standard library only.

Every reader takes bytes and options and returns a dict with content, metadata, tables and images. Optional libraries are
imported when a reader runs; where one is missing the row gets an error, not the job.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_OFFICE = "http://schemas.openxmlformats.org/"
W, A, P, S = (f"{{{_OFFICE}{x}}}" for x in ("wordprocessingml/2006/main", "drawingml/2006/main", "presentationml/2006/main", "spreadsheetml/2006/main"))
R, RELS = f"{{{_OFFICE}officeDocument/2006/relationships}}", f"{{{_OFFICE}package/2006/relationships}}"
HANCOM = ("{http://www.hancom.co.kr/hwpml/2011/paragraph}", "{http://www.hancom.co.kr/hwpml/2016/paragraph}")


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a valid package") from e


def _core(z: zipfile.ZipFile) -> dict:
    """Title, author and times of an office package."""
    if "docProps/core.xml" not in z.namelist():
        return {}
    found = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in ET.fromstring(z.read("docProps/core.xml"))}
    names = {"title": "title", "creator": "author", "created": "created_at", "modified": "modified_at", "subject": "subject", "keywords": "keywords"}
    return {v: found[k] for k, v in names.items() if found.get(k)}


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> path inside the package."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for x in ET.fromstring(z.read(path)).iter(f"{RELS}Relationship"):
        target = x.get("Target", "")
        parts: list[str] = [] if target.startswith("/") else folder.split("/")
        for p in target.strip("/").split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p != ".":
                parts.append(p)
        out[x.get("Id", "")] = "/".join(p for p in parts if p)
    return out


def _table(rows: list[list[str]], index: int, locator: str | None = None) -> dict:
    return {"locator": locator, "table_index": index, "data": rows, "row_count": len(rows), "col_count": len(rows[0]) if rows else 0}


def _paragraphs(root: ET.Element, ns: str, inside: tuple[str, ...] = ()) -> Iterator[str]:
    """Texts of paragraphs, not those below ``inside`` elements."""
    stack = [root]
    while stack:
        x = stack.pop()
        if x.tag == f"{ns}p":
            yield "".join(t.text or "" if t.tag == f"{ns}t" else "\t" if t.tag == f"{ns}tab" else "\n" for t in x.iter() if t.tag in (f"{ns}t", f"{ns}tab", f"{ns}br"))
        else:
            stack += [c for c in reversed(x) if c.tag not in inside]


def parse_docx(data: bytes, extract_tables: bool = True, extract_images: bool = False) -> dict:
    """Headers, body paragraphs, footers, blank ones left out; table text is not part of the content."""
    z = _open(data)
    names = z.namelist()
    if "word/document.xml" not in names:
        raise ValueError("not a word-processor document")
    body = ET.fromstring(z.read("word/document.xml"))
    parts = [(kind, ET.fromstring(z.read(n))) for kind in ("header", "footer") for n in sorted(names) if re.fullmatch(rf"word/{kind}\d*\.xml", n)]
    texts = [t for k, r in parts if k == "header" for t in _paragraphs(r, W)] + list(_paragraphs(body, W, (f"{W}tbl",))) + [t for k, r in parts if k == "footer" for t in _paragraphs(r, W)]
    tables, images = [], []
    if extract_tables:
        for i, t in enumerate(body.iter(f"{W}tbl")):
            tables.append(_table([["\n".join(_paragraphs(c, W)) for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")], i))
    if extract_images:
        for rel, path in _relations(z, "word/document.xml").items():
            if path.startswith("word/media/") and path in names:
                images.append({"rel_id": rel, "content_type": f"image/{path.rpartition('.')[2].lower()}", "blob_size": str(z.getinfo(path).file_size)})
    return {"content": "\n\n".join(t for t in texts if t.strip()), "metadata": _core(z), "tables": tables, "images": images}


def parse_pptx(data: bytes, extract_notes: bool = True, extract_tables: bool = True, extract_images: bool = False) -> dict:
    """Slides in order, each with its number, paragraphs of text frames and notes."""
    z = _open(data)
    if "ppt/presentation.xml" not in z.namelist():
        raise ValueError("not a presentation")
    rel = _relations(z, "ppt/presentation.xml")
    order = [rel[x.get(f"{R}id", "")] for x in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId") if x.get(f"{R}id", "") in rel]
    slides, tables, images = [], [], []
    for n, path in enumerate(order, 1):
        root = ET.fromstring(z.read(path))
        lines = [f"[Slide {n}]"]
        for frame in root.iter(f"{P}txBody"):
            lines += [t.strip() for t in _paragraphs(frame, A) if t.strip()]
        found = list(root.iter(f"{A}tbl")) if extract_tables else []
        for t in found:
            tables.append(_table([["\n".join(_paragraphs(c, A)) for c in r.findall(f"{A}tc")] for r in t.findall(f"{A}tr")], len(tables), str(n)))
        if extract_images:
            images += [{"slide": str(n), "name": x.get("name", "")} for pic in root.iter(f"{P}pic") for x in pic.iter(f"{P}cNvPr")]
        notes = next((v for v in _relations(z, path).values() if "notesSlide" in v), None)
        if extract_notes and notes in z.namelist():
            body = [t.strip() for s in ET.fromstring(z.read(notes)).iter(f"{P}sp") if not any(h.get("type") in ("sldNum", "sldImg", "dt", "ftr") for h in s.iter(f"{P}ph")) for f in s.iter(f"{P}txBody") for t in _paragraphs(f, A)]
            if any(body):
                lines.append("\n[Notes]\n" + "\n".join(t for t in body if t))
        slides.append("\n".join(lines))
    return {"content": "\n\n---\n\n".join(slides), "metadata": _core(z) | {"page_count": len(order)}, "tables": tables, "images": images}


def _cell(c: ET.Element, shared: list[str], formulas: bool) -> str:
    kind, f, v = c.get("t"), c.find(f"{S}f"), c.find(f"{S}v")
    if formulas and f is not None:
        return "=" + (f.text or "")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{S}t"))
    if v is None or v.text is None:
        return ""
    return shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_rows(data: bytes, sheets: list[str] | None = None, all_sheets: bool = True, max_rows: int | None = None, max_cols: int | None = None, include_formulas: bool = False) -> Iterator[tuple[str, list[list[str]]]]:
    z = _open(data)
    if "xl/workbook.xml" not in z.namelist():
        raise ValueError("not a workbook")
    shared = ["".join(t.text or "" for t in x.iter(f"{S}t")) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    rel, book = _relations(z, "xl/workbook.xml"), ET.fromstring(z.read("xl/workbook.xml"))
    known = {x.get("name", ""): rel.get(x.get(f"{R}id", ""), "") for x in book.iter(f"{S}sheet")}
    view = book.find(f".//{S}workbookView")
    active = int(view.get("activeTab", "0")) if view is not None else 0
    chosen = [s for s in sheets if s in known] if sheets else list(known) if all_sheets else list(known)[active : active + 1]
    for name in chosen:
        rows = []
        for r in ET.fromstring(z.read(known[name])).iter(f"{S}row"):
            at = int(r.get("r", len(rows) + 1)) - 1
            if max_rows is not None and at >= max_rows:
                break
            values: list[str] = []
            for c in r.findall(f"{S}c"):
                k = _column(c.get("r", "")) if c.get("r") else len(values)
                if max_cols is not None and k >= max_cols:
                    break
                values += [""] * (k - len(values)) + [_cell(c, shared, include_formulas)]
            rows.append(values)
        width = max(map(len, rows), default=0)
        yield name, [r + [""] * (width - len(r)) for r in rows]


def parse_xlsx(data: bytes, preserve_structure: bool = True, extract_tables: bool = True, **options) -> dict:
    """Per sheet its name and rows; rows of blank cells are left out."""
    texts, tables = [], []
    for name, rows in sheet_rows(data, **options):
        full = [r for r in rows if any(v.strip() for v in r)]
        lines = [" | ".join(r) if preserve_structure else " ".join(v for v in r if v.strip()) for r in full]
        texts.append("\n".join([f"[Sheet: {name}]", *lines]))
        if extract_tables and full:
            tables.append(_table(full, len(tables), name))
    return {"content": "\n\n".join(texts), "metadata": _core(_open(data)) | {"page_count": len(texts)}, "tables": tables, "images": []}


def parse_hwpx(data: bytes, extract_tables: bool = True, extract_images: bool = False) -> dict:
    """Section files in the order of their names as text, so section10 precedes section2."""
    z = _open(data)
    names = sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section.*\.xml", n))
    sections, tables, valid = [], [], True
    for n in names:
        raw = z.read(n)
        texts: list[str] = []
        try:
            root = ET.fromstring(raw)
            for ns in HANCOM:
                texts = texts or [t for x in root.iter(f"{ns}t") if (t := "".join(x.itertext()).strip())]
            texts = texts or [t for x in root.iter() if (t := (x.text or "").strip())]
            if extract_tables:
                for t in root.iter(f"{HANCOM[0]}tbl"):
                    tables.append(_table([["".join(c.itertext()).strip() for c in r.findall(f"{HANCOM[0]}tc")] for r in t.findall(f"{HANCOM[0]}tr")], len(tables)))
        except ET.ParseError:
            valid = False
        if not texts:
            texts = [t for x in re.split(r"<[^>]*>", raw.decode("utf-8", "replace")) if (t := x.strip())]
        if texts:
            sections.append("\n".join(texts))
    meta = {"page_count": len(names)} if "Contents/content.hpf" in z.namelist() and valid else {}
    kinds = ("png", "jpg", "jpeg", "gif", "bmp")
    images = [{"path": i.filename, "size": str(i.file_size), "format": k} for i in z.infolist() if i.filename.startswith("BinData/") and (k := i.filename.rpartition(".")[2].lower()) in kinds] if extract_images else []
    return {"content": "\n\n".join(sections), "metadata": meta, "tables": tables, "images": images}


class CompoundFile:
    """Streams of an OLE compound file (version 3 or 4), read without libraries. Chains that loop or leave the file end."""

    FREE = 0xFFFFFFF0

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIII", data, 48)
        fat_at = [x for x in struct.unpack_from("<109I", data, 76) if x < self.FREE]
        for _ in range(n_difat):
            if first_difat >= self.FREE:
                break
            more = self._sector(first_difat)
            ids = struct.unpack(f"<{len(more) // 4}I", more)
            fat_at += [x for x in ids[:-1] if x < self.FREE]
            first_difat = ids[-1]
        self.fat = [x for s in fat_at for x in struct.unpack(f"<{self.size // 4}I", self._sector(s).ljust(self.size, b"\xff"))]
        mini = self._chain(first_mini)
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        raw = self._chain(first_dir)
        self.entries = [raw[i : i + 128] for i in range(0, len(raw) - 127, 128)]
        self.mini = self._chain(struct.unpack_from("<I", self.entries[0], 116)[0]) if self.entries else b""
        self.paths: dict[str, int] = {}
        if self.entries:
            self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "", set())

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, n: int) -> bytes:
        out, seen = [], 0
        while n < len(self.fat) and seen <= len(self.fat):
            out.append(self._sector(n))
            n, seen = self.fat[n], seen + 1
        return b"".join(out)

    def _walk(self, root: int, prefix: str, seen: set[int]) -> None:
        stack = [(root, prefix)]
        while stack:
            i, at = stack.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            if e[66] == 2:
                self.paths[at + name] = i
            stack += [(left, at), (right, at)] + ([(child, at + name + "/")] if e[66] == 1 else [])

    def read(self, path: str) -> bytes:
        e = self.entries[self.paths[path]]
        start, size = struct.unpack_from("<II", e, 116)
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], 0
        while start < len(self.mini_fat) and seen <= len(self.mini_fat):
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start, seen = self.mini_fat[start], seen + 1
        return b"".join(out)[:size]


#: Control characters followed by 12 bytes of their own.
_LONG_CONTROLS = frozenset([1, 2, 3, 11, 12, *range(14, 19), 21, 22, 23])


def hwp_paragraph(data: bytes) -> str:
    out, at = [], 0
    while at + 1 < len(data):
        code = data[at] | data[at + 1] << 8
        at += 2
        if code == 0:
            break
        if code == 10:
            out.append("\n")
        elif code in _LONG_CONTROLS:
            at += 12
        elif code >= 32:
            out.append(chr(code) if not 0xD800 <= code < 0xE000 else "�")
    return "".join(out)


def hwp_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        tag, size = head & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        yield tag, data[at : at + size]
        at += size


#: Numbers of the summary's properties.
_SUMMARY = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 8: "last_author", 9: "revision"}


def property_set(data: bytes) -> dict[int, str | int]:
    """Strings and whole numbers of the first section of a property set; other kinds of values are passed over."""
    (start,) = struct.unpack_from("<I", data, 44)
    (n,) = struct.unpack_from("<I", data, start + 4)
    out: dict[int, str | int] = {}
    for i in range(min(n, len(data) // 8)):
        key, at = struct.unpack_from("<II", data, start + 8 + 8 * i)
        kind, size = struct.unpack_from("<II", data, start + at)
        body = data[start + at + 8 :]
        if kind == 31:
            out[key] = body[: 2 * size].decode("utf-16-le", "replace").rstrip("\0")
        elif kind == 30:
            out[key] = body[:size].decode("utf-8", "replace").rstrip("\0")
        elif kind in (2, 3, 22, 23):
            out[key] = size
    return out


def _summary(f: CompoundFile) -> dict:
    try:
        found = property_set(f.read("\x05HwpSummaryInformation"))
    except (KeyError, struct.error):
        return {}
    return {name: found[key] for key, name in _SUMMARY.items() if found.get(key)}


def parse_hwp(data: bytes, extract_images: bool = False) -> dict:
    f = CompoundFile(data)
    if "FileHeader" not in f.paths:
        raise ValueError("not a HWP document")
    packed = bool(f.read("FileHeader")[36] & 1)
    sections, n = [], 0
    while f"BodyText/Section{n}" in f.paths:
        raw = f.read(f"BodyText/Section{n}")
        raw = zlib.decompress(raw, -15) if packed else raw
        texts = [t for tag, body in hwp_records(raw) if tag == 67 and (t := hwp_paragraph(body)).strip()]
        if texts:
            sections.append("\n".join(texts))
        n += 1
    images = []
    if extract_images:
        magic = {b"\x89PNG": "png", b"\xff\xd8": "jpeg", b"GIF8": "gif", b"BM": "bmp"}
        for path in sorted(p for p in f.paths if p.startswith("BinData/")):
            raw = f.read(path)
            kind = next((k for m, k in magic.items() if raw.startswith(m)), "unknown")
            images.append({"path": path, "size": str(len(raw)), "format": kind})
    return {"content": "\n\n".join(sections), "metadata": _summary(f) | {"page_count": n}, "tables": [], "images": images}


def parse_pdf(data: bytes, password: str | None = None, extract_tables: bool = True, extract_images: bool = False, ocr: bool = False, ocr_language: str = "eng") -> dict:
    import fitz  # PyMuPDF, optional

    doc = fitz.open(stream=data, filetype="pdf")
    if doc.is_encrypted and not (password and doc.authenticate(password)):
        raise ValueError("the document is encrypted")
    pages = []
    for page in doc:
        text = page.get_text()
        if ocr and not text.strip():
            pix = page.get_pixmap(matrix=fitz.Matrix(2, 2))
            text = parse_image(pix.tobytes("png"), language=ocr_language)["content"]
        pages.append(text)
    images = [dict(page=str(p.number + 1), image_index=str(i), width=str(x[2]), height=str(x[3]), xref=str(x[0])) for p in doc for i, x in enumerate(p.get_images())] if extract_images else []
    tables = []
    if extract_tables:
        try:
            import pdfplumber  # optional

            with pdfplumber.open(io.BytesIO(data)) as pdf:
                for p in pdf.pages:
                    tables += [_table([[v or "" for v in r] for r in t], i, str(p.page_number)) for i, t in enumerate(p.extract_tables())]
        except Exception:
            pass
    meta = {k: v for k, v in (doc.metadata or {}).items() if v and k in ("title", "author", "producer", "creator", "subject", "keywords")}
    return {"content": "\n\n".join(pages), "metadata": meta | {"page_count": len(pages)}, "tables": tables, "images": images}


def parse_image(data: bytes, language: str = "eng", confidence: float = 0.0) -> dict:
    import pytesseract  # optional
    from PIL import Image, ImageEnhance, ImageFilter  # optional

    image = Image.open(io.BytesIO(data))
    clean = ImageEnhance.Contrast(image.convert("RGB").convert("L")).enhance(1.5).filter(ImageFilter.SHARPEN).point(lambda x: 255 if x > 128 else 0)
    found = pytesseract.image_to_data(clean, lang=language, output_type=pytesseract.Output.DICT)
    words = [(w, float(c)) for w, c in zip(found["text"], found["conf"], strict=True) if w.strip() and float(c) >= confidence]
    meta = {"width": image.width, "height": image.height, "word_count": len(words), "avg_confidence": sum(c for _, c in words) / len(words) if words else 0.0}
    return {"content": " ".join(w for w, _ in words), "metadata": meta, "tables": [], "images": []}
