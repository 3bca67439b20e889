"""Bytes of a file to text, format by format, with the standard library only (PDF needs the optional pypdf)."""

from __future__ import annotations

import csv
import io
import json
import mimetypes
import re
import zipfile
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from xml.etree import ElementTree

from lodestone.functions.text import cleaned
from lodestone.sources.ocr import OCRProvider
from lodestone.sources.registry import LEGACY, SUPPORTED, family_of

ENCODINGS = ("utf-8", "gbk", "latin-1")
Cells = Iterable[str | None]


def decode(content: bytes) -> str:
    """The first of ENCODINGS that fits; line ends become newlines."""
    for name in ENCODINGS:
        try:
            return content.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            pass
    raise ValueError("unknown encoding")  # latin-1 decodes all bytes


def _stripped(parts: Iterable[str | None]) -> list[str]:
    return [p.strip() for p in parts if p and p.strip()]


def _table(rows: Iterable[Cells]) -> str:
    return "\n".join(" | ".join(cells) for cells in map(_stripped, rows) if cells)


class _TextOfHtml(HTMLParser):
    SILENT = ("script", "style")

    def __init__(self, drop_script: bool):
        super().__init__()
        self.drop, self.inside, self.found = drop_script, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag in self.SILENT

    def handle_endtag(self, tag):
        if tag in self.SILENT and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if not (self.drop and self.inside):
            self.found.append(data)


def html_text(source: str, drop_script: bool = False) -> str:
    """Text between tags, one line for each piece. Scripts and styles count as text unless drop_script is set."""
    parser = _TextOfHtml(drop_script)
    parser.feed(source)
    return "\n".join(_stripped(parser.found))


def csv_text(source: str) -> str:
    """Cells of a row joined by ` | `; the dialect is guessed from the first 4096 characters."""
    try:
        dialect = csv.Sniffer().sniff(source[:4096])
    except csv.Error:
        dialect = csv.excel
    return _table(csv.reader(source.splitlines(), dialect))


def json_text(source: str) -> str:
    """A document is indented; lines of documents are written compactly; anything else stays as it is."""
    try:
        return json.dumps(json.loads(source), ensure_ascii=False, indent=2)
    except json.JSONDecodeError:
        pass
    try:
        return "\n".join(json.dumps(json.loads(x), ensure_ascii=False) for x in _stripped(source.splitlines()))
    except json.JSONDecodeError:
        return source


def xml_text(source: str | bytes) -> str:
    """Text nodes, one a line; of malformed XML the tags become blanks."""
    try:
        return "\n".join(_stripped(ElementTree.fromstring(source).itertext()))
    except ElementTree.ParseError:
        return re.sub("<[^>]+>", " ", source if isinstance(source, str) else decode(source))


#: Escaped bytes, control words and braces, each replaced by a blank, in order.
RTF_MARKS = (r"\\'[0-9a-fA-F]{2}", r"\\[a-zA-Z]+\d* ?", r"[{}]")


def rtf_text(source: str) -> str:
    for mark in RTF_MARKS:
        source = re.sub(mark, " ", source)
    return source


def _member_text(raw: bytes) -> str:
    try:
        return "\n".join(_stripped(ElementTree.fromstring(raw).itertext()))
    except ElementTree.ParseError:
        return html_text(raw.decode("utf-8", errors="ignore"))


def zipped_text(content: bytes, wanted: Callable[[str], bool], in_order: bool = False) -> str:
    """Text of the members that are wanted, in the archive's order or sorted by name."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if wanted(n)]
        texts = [_member_text(archive.read(n)) for n in (sorted(names) if in_order else names)]
    return "\n".join(t for t in texts if t)


def pptx_text(content: bytes) -> str:
    """Slides in the order of their names, as text (slide10 before slide2)."""
    return zipped_text(content, lambda n: n.startswith("ppt/slides/slide") and n.endswith(".xml"), in_order=True)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xlsx_text(content: bytes) -> str:
    """Sheets in the order of their names, a blank line between them. Blank shared strings keep their numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(item.itertext()).strip() for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
        sheets = [ElementTree.fromstring(archive.read(n)) for n in sorted(names) if re.fullmatch(r"xl/worksheets/.*\.xml", n)]

    def cell(node) -> str:
        parts = {_local(child.tag): child for child in reversed(node)}
        if "v" in parts and parts["v"].text:
            value = parts["v"].text
        elif "is" in parts:
            value = "".join(parts["is"].itertext()).strip()
        else:
            value = ""
        is_shared = node.get("t") == "s" and value.isdigit() and int(value) < len(shared)
        return shared[int(value)] if is_shared else value

    def sheet(root) -> str:
        rows = ([cell(c) for c in row if _local(c.tag) == "c"] for row in root.iter() if _local(row.tag) == "row")
        return "\n".join(" | ".join(v for v in row if v) for row in rows if any(row))

    return "\n\n".join(t for t in map(sheet, sheets) if t)


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then its tables, a row a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next((n for n in ElementTree.fromstring(archive.read("word/document.xml")) if _local(n.tag) == "body"), None)

    def words(node) -> str:
        marks = {"t": lambda n: n.text or "", "tab": lambda n: "\t", "br": lambda n: "\n", "cr": lambda n: "\n"}
        return "".join(marks[_local(n.tag)](n) for n in node.iter() if _local(n.tag) in marks)

    blocks = list(body) if body is not None else []
    paragraphs = [t for t in (words(p) for p in blocks if _local(p.tag) == "p") if t.strip()]
    rows = [[words(c) for c in row if _local(c.tag) == "tc"] for t in blocks if _local(t.tag) == "tbl" for row in t if _local(row.tag) == "tr"]
    return "\n".join([*paragraphs, *filter(None, (_table([row]) for row in rows))])


def pdf_text(content: bytes) -> str:
    """Pages joined by newlines; a page that cannot be read counts as empty."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF needs the pypdf package") from e

    def page_text(page) -> str:
        try:
            return page.extract_text() or ""
        except Exception:  # noqa: BLE001  a broken page must not lose the others
            return ""

    return "\n".join(map(page_text, PdfReader(io.BytesIO(content)).pages))


def pdf_ocr_text(content: bytes, provider: OCRProvider, pages: int, dpi: int) -> str:
    """The first pages, rendered and read by the provider."""
    try:
        import fitz
    except ImportError as e:
        raise ValueError("OCR of PDF needs the PyMuPDF package") from e
    with fitz.open(stream=content, filetype="pdf") as document:
        zoom = fitz.Matrix(dpi / 72, dpi / 72)
        images = (document.load_page(i).get_pixmap(matrix=zoom, alpha=False).tobytes("png") for i in range(min(len(document), pages)))
        return page_blocks(provider.extract_image_bytes(image, "image/png") for image in images)


def page_blocks(texts: Iterable[str]) -> str:
    """Non-empty page texts under their page numbers."""
    return "\n\n".join(f"[第 {n} 页]\n{text}" for n, text in enumerate(texts, 1) if text)


_PLAIN = {".csv": csv_text, ".json": json_text, ".jsonl": json_text, ".xml": xml_text, ".html": html_text, ".htm": html_text, ".rtf": rtf_text}
_BINARY = {
    ".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text,
    **dict.fromkeys((".odt", ".ods", ".odp"), lambda b: zipped_text(b, lambda n: n == "content.xml")),
    ".epub": lambda b: zipped_text(b, lambda n: n.lower().endswith((".xhtml", ".html", ".htm", ".xml"))),
}


def parse(name: str, content: bytes, provider: OCRProvider | None = None, ocr_pages: int = 20, ocr_dpi: int = 180, ocr_least: int = 30) -> str:
    """Text of a file, by the extension of its name. provider: given where OCR is on."""
    base = name.rpartition("/")[2]
    ext = "." + base.rpartition(".")[2].lower() if "." in base.lstrip(".") else ""
    family = family_of(ext)
    if ext in LEGACY:
        raise ValueError(f"{ext} needs the vendor's own program; save the file as {ext}x")
    if family == "image_ocr":
        if provider is None:
            raise ValueError("images need OCR, which is off: set enable_ocr and a provider")
        return provider.extract_image_bytes(content, mimetypes.guess_type(base)[0] or "image/png")
    if family == "pdf":
        text = pdf_text(content)
        short = len(cleaned(text)) < ocr_least
        return pdf_ocr_text(content, provider, ocr_pages, ocr_dpi) if short and provider else text
    if ext in _BINARY:
        return _BINARY[ext](content)
    return _PLAIN.get(ext, str)(decode(content))


assert {*_PLAIN, *_BINARY} <= {e for own in SUPPORTED.values() for e in own}
