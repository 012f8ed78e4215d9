"""Office documents, text, tables and archives as rows of blocks, by the standard library only.

Each document is one binary value; limits on size, blocks and members bound what a task reads of hostile files. What cannot be read
gives a status, not an exception: ok, error, too_big, protected, no_text, unsupported. Files without a byte give no row: the file
source leaves them out.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.sources.msgfiles import rtf_text
from gistmill.sources.pdffiles import page_blocks, pdf_pages
from gistmill.sources.tables import ship

BLOCK = "struct<block_type:string,text:string,block_level:int,n_rows:int>"
SCHEMA = f"name string, member string, kind string, status string, note string, title string, chars bigint, blocks array<{BLOCK}>"
MOST_BYTES, MOST_CHARS, MOST_ROWS, MOST_MEMBERS, MOST_XML = 40_000_000, 400_000, 5_000, 40, 60_000_000


def sniffed(content: Column, name: Column) -> Column:
    """The kind of a file by its first bytes, else by its extension."""
    head = F.hex(F.substring(content, 1, 8))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("7B5C727466"), "rtf")
        .when(head.startswith("504B0304"), F.when(extension.isin("docx", "docm"), "word").when(extension.isin("xlsx", "xlsm"), "excel").when(extension.isin("pptx", "pptm"), "powerpoint").otherwise("zip"))
        .when(extension == "csv", "csv").when(extension.isin("txt", "md", "log"), "text").otherwise("other")
    )


class _Blocks:
    """Collects blocks within the limits."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.chars = 0
        self.left_out: list[str] = []

    def add(self, kind: str, text: str, level: int = 0, n_rows: int | None = None) -> None:
        text = re.sub(r"[ \t\xa0]+", " ", text).strip()
        if self.chars + len(text) > MOST_CHARS:
            self.missing(f"text beyond {MOST_CHARS} characters")
        if (text or kind == "sheet") and self.chars < MOST_CHARS:
            text = text[: MOST_CHARS - self.chars]
            self.rows.append({"block_type": kind, "text": text, "block_level": level, "n_rows": n_rows})
            self.chars += len(text)


    def missing(self, what: str) -> None:
        """Notes what a limit leaves out."""
        if what not in self.left_out:
            self.left_out.append(what)


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> part, of the relations of ``part``."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    targets = {x.attrib.get("Id", ""): x.attrib.get("Target", "") for x in _xml(archive, rels) if x.attrib.get("TargetMode") != "External"}
    return {k: posixpath.normpath(t.lstrip("/") if t.startswith("/") else f"{folder}/{t}") for k, t in targets.items()}


def _relation(x: ElementTree.Element) -> str:
    return next((v for k, v in x.attrib.items() if k.endswith("}id")), "")


def excel_date(serial: float, date1904: bool = False) -> str:
    """A serial number of a sheet as a date, with its time if it has one; the year 1900 has a 29th of February there."""
    if not 0 <= serial < 2_958_466:
        return str(serial)
    if not date1904 and int(serial) == 60:
        return "1900-02-29"
    start = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    at = start + timedelta(seconds=round(serial * 86_400))
    if serial < 1:
        return at.strftime("%H:%M")
    return at.strftime("%Y-%m-%d" if at.hour == at.minute == 0 else "%Y-%m-%d %H:%M")


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """The cell styles that show dates or times."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    top = _xml(archive, "xl/styles.xml")
    own = {int(x.attrib.get("numFmtId", 0)): x.attrib.get("formatCode", "") for x in top.iter() if _name(x) == "numFmt"}
    dates = {n for n, code in own.items() if re.search(r"(?i)[ymdhs]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"|\\\\.", "", code))} | {*range(14, 23), *range(45, 48)}
    formats = next((x for x in top if _name(x) == "cellXfs"), [])
    return {k for k, x in enumerate(formats) if int(x.attrib.get("numFmtId", 0)) in dates}


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST_XML:
        raise ValueError("part too big")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data:
        raise ValueError("entities are not allowed")
    return ElementTree.fromstring(data)


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _words(element: ElementTree.Element) -> str:
    """The text of a paragraph; deleted text is left out, tabs and breaks are blanks."""
    out = []
    for x in element.iter():
        if _name(x) == "t":
            out.append(x.text or "")
        elif _name(x) in ("tab", "br", "cr"):
            out.append(" ")
    return "".join(out)


def _flat(element: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables in order, also those inside content controls."""
    for x in element:
        if _name(x) in ("sdt", "sdtContent", "customXml", "ins", "smartTag"):
            yield from _flat(x)
        elif _name(x) in ("p", "tbl"):
            yield x


def word_blocks(archive: zipfile.ZipFile, out: _Blocks) -> None:
    names = set(archive.namelist())
    body = next(x for x in _xml(archive, "word/document.xml") if _name(x) == "body")
    for x in _flat(body):
        if _name(x) == "p":
            style = next((s.attrib.get(k, "") for s in x.iter() if _name(s) == "pStyle" for k in s.attrib), "")
            listed = any(_name(s) == "numPr" for s in x.iter())
            level = re.search(r"(?i)heading\s?(\d)|title", style)
            out.add("heading" if level else "item" if listed else "para", _words(x), int(level[1] or 1) if level else 0)
        else:
            for row in (r for r in x if _name(r) == "tr"):
                out.add("row", " | ".join(_words(c).strip() for c in row if _name(c) in ("tc", "sdt")))
    for part, kind in (("footnotes", "footnote"), ("endnotes", "endnote"), ("comments", "comment")):
        if f"word/{part}.xml" in names:
            for note in (n for n in _xml(archive, f"word/{part}.xml").iter() if _name(n) == kind and not any(k.endswith("}type") for k in n.attrib)):
                out.add("note", " ".join(_words(p) for p in note.iter() if _name(p) == "p"))


def _column(reference: str, k: int) -> int:
    """The column of a cell by its reference (``C7``), else its place in the row."""
    letters = re.match(r"[A-Z]{1,3}", reference)
    return reduce(lambda n, c: n * 26 + ord(c) - 64, letters[0], 0) - 1 if letters else k


def render_rows(rows: list[dict[int, str]]) -> list[str]:
    """Rows as cells between bars: empty columns go; of a wide sheet, rows with few cells come as ``header: value``."""
    used = sorted({k for r in rows for k, v in r.items() if v.strip()})
    head = rows[0] if rows else {}
    named = len(used) >= 8 and sum(bool(head.get(k, "").strip()) for k in used) >= len(used) * 0.7
    out = []
    for n, r in enumerate(rows):
        filled = [k for k in used if r.get(k, "").strip()]
        if named and n and len(filled) <= len(used) / 3:
            out.append("; ".join(f"{head.get(k, '').strip() or '?'}: {r[k].strip()}" for k in filled))
        else:
            out.append(" | ".join(r.get(k, "").strip() for k in used))
    return out


def excel_blocks(archive: zipfile.ZipFile, out: _Blocks) -> None:
    names = set(archive.namelist())
    shared = [_words(x) for x in _xml(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    book, parts, dates = _xml(archive, "xl/workbook.xml"), _related(archive, "xl/workbook.xml"), _date_styles(archive)
    from_1904 = any(_name(x) == "workbookPr" and x.attrib.get("date1904") in ("1", "true") for x in book.iter())
    numbered = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    for k, sheet in enumerate(x for x in book.iter() if _name(x) == "sheet"):
        # only a file without relations leaves nothing but the order
        part = parts.get(_relation(sheet), "") if parts else (numbered[k] if k < len(numbered) else "")
        if sheet.attrib.get("state", "visible") != "visible" or part not in names:
            continue
        top, rows = _xml(archive, part), []
        hidden = {k for x in top.iter() if _name(x) == "col" and x.attrib.get("hidden") in ("1", "true") for k in range(int(x.attrib["min"]) - 1, min(int(x.attrib["max"]), 16_384))}
        for row in (x for x in top.iter() if _name(x) == "row" and x.attrib.get("hidden") not in ("1", "true")):
            cells: dict[int, str] = {}
            for k, c in enumerate(row):
                value = next((v.text or "" for v in c if _name(v) == "v"), "")
                kind = c.attrib.get("t", "n")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = _words(c)
                elif kind == "b":
                    value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                elif kind == "n" and int(c.attrib.get("s", 0) or 0) in dates and re.fullmatch(r"\d+(?:\.\d+)?", value):
                    value = excel_date(float(value), from_1904)
                elif kind == "n" and re.fullmatch(r"-?\d+\.\d{10,}(?:E-?\d+)?", value):
                    value = f"{float(value):.10g}"
                place = _column(c.attrib.get("r", ""), k)
                if place not in hidden and value.strip():
                    cells[place] = value
            if cells:
                rows.append(cells)
        out.add("sheet", sheet.attrib.get("name", ""), 0, len(rows))
        if len(rows) > MOST_ROWS:
            out.missing(f"rows beyond {MOST_ROWS} of sheet {sheet.attrib.get('name', '')}")
        for text in render_rows(rows[:MOST_ROWS]):
            out.add("row", text)
        for part in _related(archive, part).values():
            if re.search(r"comments\d*\.xml$", part) and part in names:
                for note in (x for x in _xml(archive, part).iter() if _name(x) == "comment"):
                    out.add("note", f"{note.attrib.get('ref', '')}: {_words(note)}")


def powerpoint_blocks(archive: zipfile.ZipFile, out: _Blocks) -> None:
    names, parts = set(archive.namelist()), _related(archive, "ppt/presentation.xml")
    if parts:
        order = [parts.get(_relation(x), "") for x in _xml(archive, "ppt/presentation.xml").iter() if _name(x) == "sldId"]
    else:
        order = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    for k, part in enumerate((p for p in order if p in names), 1):
        top = _xml(archive, part)
        if top.attrib.get("show") == "0":
            continue
        out.add("slide", str(k))
        for shape in (x for x in top.iter() if _name(x) in ("sp", "tbl")):
            if _name(shape) == "tbl":
                for row in (r for r in shape if _name(r) == "tr"):
                    out.add("row", " | ".join(" ".join(_words(p) for p in c.iter() if _name(p) == "p").strip() for c in row if _name(c) == "tc"))
                continue
            title = any(_name(x) == "ph" and x.attrib.get("type", "") in ("title", "ctrTitle") for x in shape.iter())
            for p in (x for x in shape.iter() if _name(x) == "p"):
                out.add("heading" if title else "para", _words(p), 1 if title else 0)
        for note in (n for n in _related(archive, part).values() if "notesSlide" in n and n in names):
            for shape in (x for x in _xml(archive, note).iter() if _name(x) == "sp" and any(_name(y) == "ph" and y.attrib.get("type") == "body" for y in x.iter())):
                out.add("note", " ".join(_words(p) for p in shape.iter() if _name(p) == "p"))


def text_blocks(text: str, out: _Blocks, markdown: bool = False) -> None:
    """Paragraphs, list items, headings with number signs, and lines of pipe tables."""
    for paragraph in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        plain: list[str] = []
        for line in [*paragraph.split("\n"), ""]:
            head = re.match(r"^(#{1,6}) +(.+)$", line) if markdown else None
            item = re.match(r"^\s*(?:[-*•·]|\d{1,3}[.)])\s+(.+)$", line)
            row = line.count("|") > 1
            if head or item or row or not line:
                if plain:
                    out.add("para", " ".join(plain))
                    plain = []
                if head:
                    out.add("heading", head[2], len(head[1]))
                elif item:
                    out.add("item", item[1])
                elif row and not re.fullmatch(r"[\s|:-]+", line):
                    out.add("row", " | ".join(c.strip() for c in line.strip().strip("|").split("|")))
            else:
                plain.append(line.strip())


def delimiter(text: str) -> str:
    """The sign that parts the cells: of those outside quotes the one whose count is above zero and the same on most of the first lines."""
    counts: dict[str, list[int]] = {d: [] for d in ",;\t|"}
    for line in [x for x in text.split("\n")[:50] if x.strip()]:
        bare = re.sub(r'"(?:[^"]|"")*"', "", line)
        for d, n in counts.items():
            n.append(bare.count(d))
    best = {d: max(((sum(1 for x in n if x == k), k) for k in set(n) if k), default=(0, 0)) for d, n in counts.items()}
    return max(best, key=lambda d: best[d])


def csv_blocks(text: str, out: _Blocks) -> None:
    filled = [cells for cells in csv.reader(io.StringIO(text), delimiter=delimiter(text)) if "".join(cells).strip()]
    out.add("sheet", "", 0, len(filled))
    if len(filled) > MOST_ROWS:
        out.missing(f"rows beyond {MOST_ROWS}")
    for text in render_rows([dict(enumerate(cells)) for cells in filled[:MOST_ROWS]]):
        out.add("row", text)


def pdf_blocks(data: bytes, out: _Blocks) -> None:
    pages, note = pdf_pages(data)
    empty = sum(1 for lines in pages if not lines)
    for kind, text, level in page_blocks(pages):
        out.add(kind, text, level)
    if note:
        out.missing(note)
    if empty and empty < len(pages):
        out.missing(f"{empty} of {len(pages)} pages have no text (scans)")


READERS = {"word": word_blocks, "excel": excel_blocks, "powerpoint": powerpoint_blocks}


def extract(name: str, kind: str, data: bytes, depth: int = 0) -> Iterator[dict]:
    """The document, and the documents inside it if it is an archive (one level)."""
    out, status, note = _Blocks(), "ok", ""
    members: list[dict] = []
    try:
        if len(data) > MOST_BYTES:
            status = "too_big"
        elif kind in READERS:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                READERS[kind](archive, out)
        elif kind in ("text", "csv"):
            try:
                text = data.decode("utf-8-sig")
            except UnicodeDecodeError:
                text = data.decode("cp1252", "replace")
            csv_blocks(text, out) if kind == "csv" else text_blocks(text, out, name.lower().endswith(".md"))
        elif kind == "rtf":
            text_blocks(rtf_text(data), out)
        elif kind == "pdf":
            pdf_blocks(data, out)
        elif kind == "zip" and depth == 0:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                listed = [x for x in archive.infolist() if not x.is_dir()]
                if len(listed) > MOST_MEMBERS:
                    out.missing(f"{len(listed) - MOST_MEMBERS} further members")
                for info in listed[:MOST_MEMBERS]:
                    out.add("member", info.filename)
                    extension = info.filename.rpartition(".")[2].lower()
                    inner = {"docx": "word", "xlsx": "excel", "pptx": "powerpoint", "txt": "text", "md": "text", "csv": "csv", "rtf": "rtf", "pdf": "pdf"}.get(extension)
                    if inner and info.file_size <= MOST_BYTES and not info.flag_bits & 1 and info.file_size <= 200 * max(info.compress_size, 1):
                        members += [m | {"name": name, "member": info.filename} for m in extract(info.filename, inner, archive.read(info), 1)]
        elif kind == "ole":
            status, note = "protected", "encrypted or an old format"
        else:
            status = "unsupported"
        if status == "ok" and not any(b["text"] for b in out.rows if b["block_type"] not in ("page", "slide")):
            status = "no_text"
        if out.left_out:
            note = "; ".join(x if x.startswith("partly") else f"partly read: {x}" for x in out.left_out)
    except PermissionError as error:
        status, note, out = "protected", str(error), _Blocks()
    except (RuntimeError, zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError, StopIteration, RecursionError, zlib.error, struct.error, IndexError, TypeError) as error:
        status, note, out = "error", str(error)[:200], _Blocks()
    title = next((b["text"] for b in out.rows if b["block_type"] == "heading"), None)
    yield {"name": name, "member": None, "kind": kind, "status": status, "note": note, "title": title, "chars": out.chars, "blocks": out.rows}
    yield from members


# Endings and beginnings of files that are no documents.
NO_DOCUMENT = r"(?i)(?:^~\$|^\.|^thumbs\.db$|\.(?:tmp|temp|bak|lnk|url|lock|ini|crdownload|part)$|~$)"


def scan_documents(spark: SparkSession, folder: str, recursive: bool = True, skip_folder: str | None = None, made: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content, is_mail`` of loose files below a folder, without temporary, lock, backup and hidden ones, those
    below ``skip_folder``, and digests of an earlier run (names that ``made``, a pattern, fits)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    base = F.regexp_extract("path", r"([^/\\]+)$", 1)
    files = files.where(~base.rlike(NO_DOCUMENT))
    if skip_folder:
        files = files.where(~F.col("path").contains(f"/{skip_folder.strip('/')}/"))
    if made:
        files = files.where(~base.rlike(made))
    return files.withColumn("is_mail", F.lower(base).rlike(r"\.(?:eml|msg)$"))


def read_documents(files: DataFrame) -> DataFrame:
    """Documents of ``path, content``, one row per document and per readable member of an archive."""
    ship(files.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, kind, data in zip(frame.path, frame.kind, frame.content) for r in extract(path.rpartition("/")[2], kind, bytes(data))]
            yield pd.DataFrame(rows, columns=["name", "member", "kind", "status", "note", "title", "chars", "blocks"])

    return files.select("path", sniffed(F.col("content"), F.col("path")).alias("kind"), "content").mapInPandas(work, SCHEMA)


def read_once(files: DataFrame) -> DataFrame:
    """As :func:`read_documents`, each content once: ``sha1`` and the documents of the first path (by name) that holds it.

    Contents are told apart by hashes before anything is parsed; only the chosen ones travel.
    """
    marked = files.select("path", F.sha1("content").alias("sha1"))
    first = marked.groupBy("sha1").agg(F.min("path").alias("path"))
    chosen = files.join(first, "path", "left_semi")
    return read_documents(chosen)
