"""Folders of mail files as rows: scanning, reading MIME messages, HTML as text, incremental reading.

A file that cannot be read gives a row with ``read_error`` and empty fields; nothing raises. Content is read by the task that parses it
and never leaves it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.sources.msgfiles import msg_record
from gistmill.sources.tables import ship

PERSON = "struct<display:string,email:string>"
INNER = "struct<sender_name:string,sender_email:string,date_iso:string,subject:string,body:string>"
ATTACHMENT = f"struct<file_name:string,size:bigint,inline:boolean,link:boolean,sha1:string,doc_size:bigint,email:{INNER}>"
SCHEMA = (
    "path string, date_iso string, sender_name string, sender_email string, "
    f"to_list array<{PERSON}>, cc_list array<{PERSON}>, subject string, body string, attachments array<{ATTACHMENT}>, "
    "message_id string, in_reply_to string, conversation_topic string, item_class string, auto_reply boolean, reader string, meeting struct<start_iso:string,end_iso:string,place:string>, read_error string"
)
INNER_LIMIT = 30_000


def is_mail_file(name: Column) -> Column:
    """Mail by its extension in any case; lock files of office programs are none."""
    base = F.regexp_extract(name, r"([^/\\]+)$", 1)
    return F.lower(base).rlike(r"\.(?:eml|msg)$") & ~base.startswith("~$")


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of the mail files below a folder; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(is_mail_file(F.col("path")))


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


class _Text(HTMLParser):
    """HTML as plain text: block tags break lines, cells are joined by bars, list items get marks or numbers in their style, links keep their target.

    Tables that only lay out a page (nested ones, or cells with blocks of their own) come as lines, not as rows of cells.
    """

    BLOCKS = {"p", "div", "br", "tr", "table", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "hr", "section", "article", "pre"}
    SKIPPED = {"script", "style", "head", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.lists, self.link, self.tables = 0, [], "", []

    def _row(self) -> str:
        """The finished row: cells between bars, or one below the other if one of them has lines of its own."""
        cells = ["".join(c).strip() for c in self.tables[-1]["cells"]]
        if any("\n" in c for c in cells):
            return "\n".join(c for c in cells if c) + "\n"
        while cells and not cells[-1]:
            cells.pop()
        return " | ".join(cells) + "\n"

    def _put(self, text: str) -> None:
        for table in reversed(self.tables):
            if table["cells"]:
                table["cells"][-1].append(text)
                return
        self.out.append(text)

    def _end_row(self) -> None:
        if self.tables and self.tables[-1]["cells"]:
            row = self._row()
            self.tables[-1]["cells"] = []
            outer, self.tables = self.tables[-1], self.tables[:-1]
            self._put(row)
            self.tables.append(outer)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "table":
            self._put("\n")
            self.tables.append({"cells": []})
        elif tag == "tr" and self.tables:
            self._end_row()
        elif tag in ("td", "th") and self.tables:
            self.tables[-1]["cells"].append([])
        elif tag in self.BLOCKS:
            self._put("\n")
        if tag in ("ul", "ol"):
            start = known.get("start") or "1"
            self.lists.append([tag, int(start) - 1 if start.isdigit() else 0, known.get("type") or "1"])
        elif tag == "li":
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                _, n, style = self.lists[-1]
                letter = chr(96 + min(n, 26))
                self._put({"a": letter, "A": letter.upper(), "i": _roman(n), "I": _roman(n).upper()}.get(style, str(n)) + ". ")
            else:
                self._put("• ")
        elif tag == "a":
            self.link = known.get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("tr", "table") and self.tables:
            self._end_row()
            if tag == "table":
                self.tables.pop()
                self._put("\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n")
        elif tag == "a" and self.link:
            if self.link.startswith(("http:", "https:")):
                self._put(f" <{self.link}>")
            self.link = ""
        elif tag in self.BLOCKS - {"br", "hr", "li"}:
            self._put("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip and data:
            self._put(re.sub(r"\s+", " ", data))

    def close(self) -> None:
        super().close()
        while self.tables:
            self._end_row()
            self.tables.pop()


def html_to_text(html: str) -> str:
    """Readable text of an HTML body; damaged HTML gives what could be read."""
    reader = _Text()
    try:
        reader.feed(html)
    except Exception:  # what stands before the damage counts
        pass
    reader.close()
    lines = [re.sub(r" {2,}", " ", x).strip() for x in "".join(reader.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _clean(text: object) -> str:
    return str(text or "").encode("utf-8", "replace").decode("utf-8").replace("\x00", "")


def _people(message: EmailMessage, field: str) -> list[dict]:
    seen, out = set(), []
    for display, address in getaddresses([_clean(x) for x in message.get_all(field, [])]):
        key = (display.lower(), address.lower())
        if (display or address) and key not in seen:
            seen.add(key)
            out.append({"display": display, "email": address})
    return out


def _date(message: EmailMessage) -> str:
    """The date of the message, else the one on which it was first received."""
    received = [str(x).rpartition(";")[2] for x in reversed(message.get_all("Received", []))]
    for text in [str(message["Date"] or ""), *received]:
        try:
            return parsedate_to_datetime(_clean(text)).isoformat()
        except Exception:  # the next one may do
            continue
    return ""


def _body(message: EmailMessage) -> str:
    part = message.get_body(preferencelist=("plain", "html"))
    if part is None:
        return ""
    try:
        text = part.get_content()
    except Exception:
        text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    return _clean(html_to_text(text) if part.get_content_subtype() == "html" else text)


def _meeting(message: EmailMessage) -> dict | None:
    """Start, end and place of the calendar part."""
    part = next((p for p in message.walk() if p.get_content_type() == "text/calendar"), None)
    text = re.sub(r"\r?\n[ \t]", "", (part.get_payload(decode=True) or b"").decode("utf-8", "replace")) if part else ""
    event = text[text.find("BEGIN:VEVENT") :]

    def value(name: str) -> str:
        m = re.search(rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", event)
        return m[1].strip() if m else ""

    def when(name: str) -> str:
        return re.sub(r"^(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d))?(Z?)$", lambda m: f"{m[1]}-{m[2]}-{m[3]}" + (f"T{m[4]}:{m[5]}:{m[6]}{m[7]}" if m[4] else ""), value(name))

    return {"start_iso": when("DTSTART"), "end_iso": when("DTEND"), "place": value("LOCATION").replace("\\,", ",")} if event else None


def record(content: bytes) -> dict:
    """The record of one MIME message."""
    message = BytesParser(policy=policy.default).parsebytes(content)
    sender = (_people(message, "From") or [{"display": "", "email": ""}])[0]
    attachments, item_class = [], "IPM.Note"
    for part in message.walk():
        if part.get_content_type() == "text/calendar":
            method = str(part.get_param("method") or "").upper()
            item_class = {"REQUEST": "IPM.Schedule.Meeting.Request", "CANCEL": "IPM.Schedule.Meeting.Canceled", "REPLY": "IPM.Schedule.Meeting.Resp.Pos"}.get(method, item_class)
        if part.get_content_type() == "multipart/report":
            kind = str(part.get_param("report-type") or "").lower()
            item_class = "REPORT.IPM.Note.IPNRN" if kind == "disposition-notification" else "REPORT.IPM.Note.NDR"
    html_part = message.get_body(preferencelist=("html",))
    html = str(html_part.get_payload(decode=True) or b"") if html_part is not None and not html_part.is_multipart() else ""
    for part in message.iter_attachments():
        name = _clean(part.get_filename())
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload(0)
            who = (_people(inner, "From") or [{"display": "", "email": ""}])[0]
            nested = {"sender_name": who["display"], "sender_email": who["email"], "date_iso": _date(inner), "subject": _clean(inner["Subject"]), "body": _body(inner)[:INNER_LIMIT]}
            attachments.append({"file_name": name or "message.eml", "size": len(inner.as_bytes()), "inline": False, "link": False, "sha1": None, "doc_size": None, "email": nested})
            continue
        data = part.get_payload(decode=True) or b""
        shown = _clean(part["Content-ID"]).strip("<> ")
        inline = bool(shown) and f"cid:{shown}" in html or part.get_content_disposition() == "inline" or bool(shown) and part.get_content_maintype() == "image"
        document = bool(re.search(r"(?i)\.(?:docx?|xlsx?|pptx?|pdf|txt|csv|md|rtf|zip)$", name))
        attachments.append({"file_name": name, "size": len(data), "inline": inline, "link": False, "sha1": hashlib.sha1(data).hexdigest() if document else None, "doc_size": len(data) if document else None, "email": None})
    auto = _clean(message["Auto-Submitted"]).lower() not in ("", "no") or _clean(message["X-Auto-Response-Suppress"]) != "" and item_class == "IPM.Note" and _clean(message["Subject"]).lower().startswith(("automatic", "auto"))
    return {
        "date_iso": _date(message), "sender_name": sender["display"], "sender_email": sender["email"], "to_list": _people(message, "To"), "cc_list": _people(message, "Cc"),
        "subject": _clean(message["Subject"]), "body": _body(message), "attachments": attachments, "message_id": _clean(message["Message-ID"]), "in_reply_to": _clean(message["In-Reply-To"]),
        "conversation_topic": _clean(message["Thread-Topic"]), "item_class": item_class, "auto_reply": auto, "reader": "eml", "read_error": "", "meeting": _meeting(message) if item_class.startswith("IPM.Schedule.Meeting") else None,
    }


EMPTY = {"date_iso": "", "sender_name": "", "sender_email": "", "to_list": [], "cc_list": [], "subject": "", "body": "", "attachments": [], "message_id": "", "in_reply_to": "", "conversation_topic": "", "item_class": "", "auto_reply": False, "reader": "", "meeting": None}


def read_mail(files: DataFrame) -> DataFrame:
    """The records of mail files (``path, content``), one row a file."""
    ship(files.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                try:
                    if path.lower().endswith(".msg"):
                        row = msg_record(bytes(content), html_to_text, record)
                    else:
                        row = record(bytes(content))
                except Exception as error:
                    row = EMPTY | {"read_error": str(error)[:200] or type(error).__name__}
                rows.append({"path": path} | row)
            yield pd.DataFrame(rows, columns=["path", *EMPTY, "read_error"])

    return files.select("path", "content").mapInPandas(work, SCHEMA)


def to_read(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files that ``known`` (``path, modificationTime, length``) does not hold as they are now; only names are compared."""
    return files.join(known.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")


def merged(known: DataFrame, fresh: DataFrame, files: DataFrame, complete: bool) -> DataFrame:
    """Known rows and fresh ones; fresh ones win, and rows of vanished files go only if the scan was complete."""
    kept = known.join(fresh.select("path"), "path", "left_anti")
    if complete:
        kept = kept.join(files.select("path"), "path", "left_semi")
    return kept.unionByName(fresh)
