"""From the bytes of a file to chunks, with the standard library alone; PDF and OCR only where a library for them is there."""

from __future__ import annotations

import csv
import hashlib
import importlib.util
import io
import json
import re
import zipfile
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate, pairwise
from typing import Any
from xml.etree import ElementTree

#: Sizes of chunks, and the confidence in what formats give.
TEXT_CHARS, TABLE_ROWS, PARAGRAPHS, JSON_CHARS = 1500, 200, 12, 200_000

Chunk = dict[str, Any]


def decode(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def plain_text(content: bytes, markdown: bool = False) -> Iterator[Chunk]:
    """Blocks that end at a blank line after TEXT_CHARS characters, and, in Markdown, before each heading."""
    lines = decode(content).splitlines()
    until = list(accumulate(map(len, lines), initial=0))
    heads = [k for k, line in enumerate(lines) if markdown and line[:1] == "#"]
    blank = [k for k, line in enumerate(lines) if not line or line.isspace()]
    title = None
    for first, last in pairwise(sorted({0, *heads, len(lines)})):
        title = (lines[first].lstrip("# ").strip() if markdown and lines[first][:1] == "#" else "") or title
        cuts = [first]
        for k in blank[bisect_left(blank, first) : bisect_left(blank, last)]:
            if until[k + 1] - until[cuts[-1]] >= TEXT_CHARS:
                cuts.append(k + 1)
        for a, b in pairwise([*cuts, last]):
            if text := "\n".join(lines[a:b]).strip():
                yield {"chunk_kind": "paragraph", "text": text, "section_heading": title}


def table_text(content: bytes, delimiter: str, most: int = TABLE_ROWS) -> Iterator[Chunk]:
    """Blocks of ``most`` rows, each under the header; the rows are counted as in the file."""
    rows = list(csv.reader(io.StringIO(decode(content), newline=""), delimiter=delimiter))
    if not rows:
        return
    head, body = rows[0], rows[1:]
    if not body:
        yield {"chunk_kind": "table", "text": delimiter.join(head)}
    for k in range(0, len(body), most):
        block = body[k : k + most]
        yield {"chunk_kind": "table", "text": "\n".join(delimiter.join(r) for r in (head, *block)), "cell_range": f"rows {k + 2}-{k + 1 + len(block)}"}


def json_text(content: bytes) -> Iterator[Chunk]:
    raw = decode(content)
    try:
        raw = json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    except ValueError:
        pass
    if raw.strip():
        yield {"chunk_kind": "paragraph", "text": raw[:JSON_CHARS]}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style", "noscript") and self.skip > 0

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def _unclosed(found: re.Match) -> str:
    return found[0] if found[1] and (found[1][0] == "#" or found[1] in html5) else f"&amp;{found[0][1:]}"


def html_to_text(html: str, closed: bool = False) -> str:
    """The text outside scripts and styles, each piece on a line. HTML also decodes some references without a semicolon (``&amp`` at the end
    of a title that was cut); with ``closed`` these stay as they are written."""
    parser = _Text()
    parser.feed(re.sub(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", _unclosed, html) if closed else html)
    parser.close()
    return "\n".join(parser.parts)


def html_text(content: bytes) -> Iterator[Chunk]:
    if text := html_to_text(decode(content)):
        yield {"chunk_kind": "paragraph", "text": text}


# ---- Office files are zipped XML


def _local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _all(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x) == name)


def _text(node: ElementTree.Element) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in node.iter())


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _cells(node: ElementTree.Element) -> list[list[str]]:
    return [[_text(c).strip() for c in _all(r, "tc")] for r in _all(node, "tr")]


def _table(rows: list[list[str]], sure: float) -> Chunk:
    return {"chunk_kind": "table", "text": "\n".join(map("\t".join, rows)), "rows": rows, "confidence": sure}


def docx_text(content: bytes) -> Iterator[Chunk]:
    """Blocks of PARAGRAPHS paragraphs, cut before each heading; tables as blocks of their own."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(_all(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    block: list[str] = []
    heading: str | None = None
    tables = []
    for node in body:
        if _local(node) == "tbl":
            tables.append(_cells(node))
        if _local(node) != "p" or not (text := _text(node).strip()):
            continue
        style = next((_attribute(s, "val") or "" for s in _all(node, "pStyle")), "")
        if style.lower().startswith(("heading", "title")):
            if block:
                yield {"chunk_kind": "section", "text": "\n".join(block), "section_heading": heading}
            block, heading = [], text
        block.append(text)
        if len(block) >= PARAGRAPHS:
            yield {"chunk_kind": "section", "text": "\n".join(block), "section_heading": heading}
            block = []
    if block:
        yield {"chunk_kind": "section", "text": "\n".join(block), "section_heading": heading}
    for rows in tables:
        if any(map(any, rows)):
            yield _table(rows, 0.95)


def column_name(number: int) -> str:
    """1 is A, 27 is AA."""
    return "" if number < 1 else column_name((number - 1) // 26) + chr(65 + (number - 1) % 26)


def _column_number(reference: str) -> int:
    number = 0
    for c in re.match(r"[A-Z]*", reference)[0]:  # type: ignore[index]
        number = 26 * number + ord(c) - 64
    return number


def xlsx_text(content: bytes) -> Iterator[Chunk]:
    """A chunk for each sheet: its rows with anything in them, cells joined by tabs; the range from column A on."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda name: ElementTree.fromstring(z.read(name))
        shared = [_text(s) for s in _all(read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in _all(read("xl/workbook.xml"), "sheet"):
            target = (targets.get(sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")) or "").lstrip("/")
            file = target if target.startswith("xl/") else f"xl/{target}"
            if file not in names:
                continue
            rows, last = {}, 0
            for turn, row in enumerate(_all(read(file), "row"), 1):
                cells: dict[int, str] = {}
                for cell in _all(row, "c"):
                    value = next((v.text or "" for v in _all(cell, "v")), None)
                    kind = cell.get("t")
                    text = _text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else {"1": "True", "0": "False"}.get(value or "", "") if kind == "b" else value or ""
                    cells[_column_number(cell.get("r", "")) or len(cells) + 1] = text
                full = [k for k, v in cells.items() if v.strip()]
                if full:
                    rows[int(row.get("r", turn))] = [cells.get(k, "") for k in range(1, max(cells) + 1)]
                    last = max(last, *full)
            if rows:
                area = f"A{min(rows)}:{column_name(last)}{max(rows)}"
                yield {"chunk_kind": "sheet", "text": "\n".join("\t".join(r) for r in rows.values()), "sheet_name": sheet.get("name"), "cell_range": area, "rows": list(rows.values())}


def pptx_text(content: bytes) -> Iterator[Chunk]:
    """A chunk for each slide: title, other paragraphs, notes; behind them the tables, each as a chunk."""
    tables = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for place, (number, name) in enumerate(slides, 1):
            title, parts, slide = None, [], ElementTree.fromstring(z.read(name))
            tables += [_table(rows, 0.85) | {"slide_number": place} for t in _all(slide, "tbl") if any(map(any, rows := _cells(t)))]
            for shape in _all(slide, "sp"):
                is_title = any((_attribute(p, "type") or "") in ("title", "ctrTitle") for p in _all(shape, "ph"))
                said = [t for p in _all(shape, "p") if (t := _text(p).strip())]
                if is_title and said and title is None:
                    title = "\n".join(said)
                else:
                    parts += said
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in names and (said := [t for p in _all(ElementTree.fromstring(z.read(notes)), "p") if (t := _text(p).strip())]):
                parts.append("[notes]\n" + "\n".join(said))
            if text := "\n".join(t for t in (title, *(p for p in parts if p != title)) if t):
                yield {"chunk_kind": "slide", "text": text, "slide_number": place, "section_heading": title}
    yield from tables


def tables(kind: str, content: bytes) -> Iterator[dict[str, Any]]:
    """The tables of an office file: headers (the first row), rows, where they are, and how sure that is (of sheets 0.9)."""
    for c in EXTRACTORS[kind][0](content):
        if "rows" in c:
            place = {k: c[k] for k in ("sheet_name", "cell_range", "slide_number") if k in c}
            yield {"headers": c["rows"][0], "rows": c["rows"][1:], "confidence": c.get("confidence", 0.9)} | place


def pdf_text(content: bytes) -> Iterator[Chunk]:
    """A chunk for each page with text, by the first PDF library that is there."""
    if importlib.util.find_spec("pypdfium2"):
        import pypdfium2

        pages = [p.get_textpage().get_text_range() for p in pypdfium2.PdfDocument(content)]
    elif importlib.util.find_spec("pdfplumber"):
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as f:
            pages = [p.extract_text() or "" for p in f.pages]
    elif importlib.util.find_spec("fitz"):
        import fitz

        pages = [p.get_text() for p in fitz.open(stream=content, filetype="pdf")]
    else:
        raise RuntimeError("no PDF library is installed")
    for number, text in enumerate(pages, 1):
        if text.strip():
            yield {"chunk_kind": "page", "text": text.strip(), "page_number": number}


def image_text(content: bytes) -> Iterator[Chunk]:
    if not (importlib.util.find_spec("pytesseract") and importlib.util.find_spec("PIL")):
        raise RuntimeError("no OCR library is installed")
    import pytesseract
    from PIL import Image

    if text := pytesseract.image_to_string(Image.open(io.BytesIO(content)), lang="jpn+eng").strip():
        yield {"chunk_kind": "page", "text": text, "confidence": 0.7}


def scanned_text(content: bytes) -> Iterator[Chunk]:
    """The pages of a PDF without text, as pictures of 200 dots an inch that OCR reads."""
    if not all(map(importlib.util.find_spec, ("pypdfium2", "pytesseract", "PIL"))):
        raise RuntimeError("no OCR library for PDF pages is installed")
    import pypdfium2
    import pytesseract

    for number, page in enumerate(pypdfium2.PdfDocument(content), 1):
        if text := pytesseract.image_to_string(page.render(scale=200 / 72).to_pil(), lang="jpn+eng").strip():
            yield {"chunk_kind": "page", "text": text, "page_number": number, "confidence": 0.65}


#: Extractor and method by kind; a kind that isn't here has none.
EXTRACTORS: dict[str, tuple[Callable[[bytes], Iterator[Chunk]], str]] = {
    "txt": (plain_text, "native_text"),
    "markdown": (lambda c: plain_text(c, True), "native_text"),
    "csv": (lambda c: table_text(c, ","), "csv_parse"),
    "tsv": (lambda c: table_text(c, "\t"), "csv_parse"),
    "json": (json_text, "native_text"),
    "html": (html_text, "html_parse"),
    "docx": (docx_text, "docx_parse"),
    "xlsx": (xlsx_text, "xlsx_parse"),
    "pptx": (pptx_text, "pptx_parse"),
    "pdf": (pdf_text, "pdf_text"),
}

#: What each capability needs, for the report on what is missing.
CAPABILITIES = {
    "discovery": (), "text": (), "office": (), "pdf": ("pypdfium2", "pdfplumber", "fitz"), "ocr": ("pytesseract",), "embedding": (),
}


def capabilities() -> list[tuple[str, bool, str]]:
    """(capability, available, what serves it or is missing)."""
    out = []
    for name, needs in CAPABILITIES.items():
        have = next((n for n in needs if importlib.util.find_spec(n)), None)
        out.append((name, not needs or have is not None, have or ("built in" if not needs else "missing: " + " or ".join(needs))))
    return out


def extract_file(workspace_id: str, path: str, kind: str, content: bytes, options: dict) -> list[tuple]:
    """Rows of a file's chunks, or one row that says why there are none."""
    digest = hashlib.sha256(content).hexdigest()
    chosen = (image_text, "ocr") if kind == "image" and options.get("enable_ocr") else EXTRACTORS.get(kind)
    chunks, error = [], None
    try:
        if chosen is None:
            raise RuntimeError(f"no extractor for {kind}")
        chunks = list(chosen[0](content))
        if not chunks and kind == "pdf" and options.get("enable_ocr"):
            chosen = (scanned_text, "ocr")
            chunks = list(scanned_text(content))
    except Exception as e:  # noqa: BLE001  one bad file must not end the job
        error = f"{type(e).__name__}: {e}"
    method = chosen[1] if chosen else None
    if not chunks:
        return [(workspace_id, path, digest, error, method, *[None] * 9, 0)]
    keys = ("chunk_kind", "page_number", "sheet_name", "cell_range", "slide_number", "section_heading", "text")
    return [(workspace_id, path, digest, error, method, k, *(c.get(x) for x in keys), c.get("confidence", 1.0), len(chunks)) for k, c in enumerate(chunks)]
