"""Outlook message files: compound files, message properties, compressed RTF, and their record.

Written after the published formats (compound file binary, message file, RTF compression). Chains of sectors are followed no further than
the file is long, so that damaged and hostile files end with an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """Storages and streams of a compound file, by path."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError("no compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        if self.size not in (512, 4096):
            raise ValueError("unknown sector size")
        n_fat, first_dir, _, self.cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<I I I I I I I I", data, 44)
        places = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while first_difat < END and first_difat not in seen:
            seen.add(first_difat)
            block = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            places += block[:-1]
            first_difat = block[-1]
        fat = b"".join(self._sector(p) for p in places[: n_fat + 1] if p < END)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        directory = self._chain(first_dir)
        self.entries = [self._entry(directory[k : k + 128]) for k in range(0, len(directory), 128)]
        mini = self._chain(first_mini) if first_mini < END else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        root = self.entries[0]
        self.mini_data = self._chain(root["start"])[: root["size"]] if root["start"] < END else b""
        self.paths: dict[tuple[str, ...], dict] = {}
        self._list(root["child"], ())

    def _sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        if at >= len(self.data):
            raise ValueError("sector outside the file")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, first: int) -> bytes:
        out, seen = [], set()
        while first < END:
            if first in seen or first >= len(self.fat):
                raise ValueError("damaged chain of sectors")
            seen.add(first)
            out.append(self._sector(first))
            first = self.fat[first]
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes) -> dict:
        length = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<3I", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        return {"name": raw[: max(0, length - 2)].decode("utf-16-le", "replace"), "kind": raw[66], "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF}

    def _list(self, first: int, above: tuple[str, ...]) -> None:
        todo, seen = [(first, above)], set()
        while todo:
            k, path = todo.pop()
            if k >= len(self.entries) or (k, path) in seen:
                continue
            seen.add((k, path))
            entry = self.entries[k]
            here = (*path, entry["name"])
            if here in self.paths or len(here) > 12:
                continue
            self.paths[here] = entry
            todo += [(entry["left"], path), (entry["right"], path)]
            if entry["kind"] == 1:
                todo.append((entry["child"], here))

    def stream(self, *path: str) -> bytes | None:
        entry = self.paths.get(path)
        if entry is None or entry["kind"] != 2:
            return None
        if entry["size"] >= self.cutoff:
            return self._chain(entry["start"])[: entry["size"]]
        out, k, seen = [], entry["start"], set()
        while k < END and len(out) * 64 < entry["size"]:
            if k in seen or k >= len(self.mini_fat):
                raise ValueError("damaged chain of sectors")
            seen.add(k)
            out.append(self.mini_data[k * 64 : k * 64 + 64])
            k = self.mini_fat[k]
        return b"".join(out)[: entry["size"]]

    def storages(self, above: tuple[str, ...], prefix: str) -> list[tuple[str, ...]]:
        return sorted(p for p, e in self.paths.items() if e["kind"] == 1 and p[:-1] == above and p[-1].startswith(prefix))


# Numbers of message properties.
SUBJECT, CLASS, BODY, HTML, RTF, HEADERS, TOPIC, MESSAGE_ID, REPLY_TO = 0x0037, 0x001A, 0x1000, 0x1013, 0x1009, 0x007D, 0x0070, 0x1035, 0x1042
SENT_NAME, SENT_EMAIL, SENT_SMTP, SENDER_NAME, SENDER_EMAIL, SENDER_SMTP = 0x0042, 0x0065, 0x5D02, 0x0C1A, 0x0C1F, 0x5D01
SUBMITTED, DELIVERED, CREATED, RECIPIENT_KIND, DISPLAY, EMAIL, SMTP = 0x0039, 0x0E06, 0x3007, 0x0C15, 0x3001, 0x3003, 0x39FE
FILE_LONG, FILE_SHORT, DATA, METHOD, CONTENT_ID, HIDDEN, FLAGS, CODEPAGE = 0x3707, 0x3704, 0x3701, 0x3705, 0x3712, 0x7FFE, 0x3714, 0x3FFD
START, STOP, PLACE = 0x8205, 0x820E, 0x8208


class Properties:
    """The properties of a storage: fixed ones from the property stream, others from streams of their own."""

    def __init__(self, file: CompoundFile, path: tuple[str, ...], header: int, codepage: str = "cp1252", named: dict[int, int] | None = None):
        self.file, self.path, self.codepage, self.named = file, path, codepage, named or {}
        raw = file.stream(*path, "__properties_version1.0") or b""
        self.fixed = {struct.unpack_from("<I", raw, k)[0] >> 16: (struct.unpack_from("<I", raw, k)[0] & 0xFFFF, raw[k + 8 : k + 16]) for k in range(header, len(raw) - 15, 16)}
        if CODEPAGE in self.fixed:
            page = struct.unpack("<I", self.fixed[CODEPAGE][1][:4])[0]
            self.codepage = "utf-8" if page == 65001 else f"cp{page}"

    def text(self, number: int) -> str:
        number = self.named.get(number, number)
        for kind, codec in (("001F", "utf-16-le"), ("001E", self.codepage)):
            raw = self.file.stream(*self.path, f"__substg1.0_{number:04X}{kind}")
            if raw is not None:
                try:
                    return raw.decode(codec, "replace").rstrip("\0")
                except LookupError:
                    return raw.decode("cp1252", "replace").rstrip("\0")
        return ""

    def binary(self, number: int) -> bytes | None:
        return self.file.stream(*self.path, f"__substg1.0_{number:04X}0102")

    def number(self, number: int) -> int | None:
        kind, raw = self.fixed.get(self.named.get(number, number), (0, b""))
        return struct.unpack("<i", raw[:4])[0] if kind in (0x0003, 0x000B) else None

    def time(self, number: int) -> str:
        """A file time (tenths of microseconds since 1601) as ISO text."""
        kind, raw = self.fixed.get(self.named.get(number, number), (0, b""))
        ticks = struct.unpack("<Q", raw)[0] if kind == 0x0040 else 0
        if not 0 < ticks < 3 * 10**18:
            return ""
        return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).isoformat(timespec="seconds")


def decompress_rtf(data: bytes) -> bytes:
    """Compressed RTF: a flag byte for eight items, each a byte or a copy from a ring of 4,096 bytes that begins with common words."""
    if len(data) < 16:
        return b""
    size, mark = struct.unpack_from("<I", data, 4)[0], data[8:12]
    if mark == b"MELA":
        return data[16 : 16 + size]
    if mark != b"LZFu":
        raise ValueError("unknown compression")
    # Fixed value: the start of the ring, from the published format.
    ring = bytearray(b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx")
    write = len(ring)
    ring = ring.ljust(4096, b"\0")
    out, at = bytearray(), 16
    while at < len(data) and len(out) < size:
        flags, at = data[at], at + 1
        for bit in range(8):
            if at >= len(data) or len(out) >= size:
                break
            if not flags >> bit & 1:
                items, at = data[at : at + 1], at + 1
            else:
                word = int.from_bytes(data[at : at + 2].ljust(2, b"\0"), "big")
                at += 2
                start, length = word >> 4, (word & 15) + 2
                if start == write % 4096:
                    return bytes(out)
                items = None
            for k in range(1 if items is not None else length):
                byte = items[0] if items is not None else ring[(start + k) % 4096]
                out.append(byte)
                ring[write % 4096] = byte
                write += 1
    return bytes(out)


CONTROL = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
# Groups whose text is none, and control words that stand for characters.
NO_TEXT = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"object", b"header", b"footer", b"generator", b"themedata", b"listtable", b"listoverridetable", b"rsidtbl", b"xmlnstbl", b"fldinst", b"datastore", b"latentstyles"}
CHARACTERS = {b"par": "\n", b"line": "\n", b"sect": "\n", b"page": "\n", b"row": "\n", b"tab": "\t", b"cell": " | ", b"emdash": "\u2014", b"endash": "\u2013", b"bullet": "\u2022", b"lquote": "\u2018", b"rquote": "\u2019", b"ldblquote": "\u201c", b"rdblquote": "\u201d"}


def rtf_text(data: bytes) -> str:
    """The text of an RTF document; of one that wraps HTML, the text outside and inside its tags."""
    if not data.lstrip()[:5] == b"{\\rtf":
        raise ValueError("no RTF")
    codec, out, stack = "cp1252", [], []
    skip, after_unicode, unicode_width, pending = False, 0, 1, bytearray()

    def flush() -> None:
        if pending:
            out.append(pending.decode(codec, "replace"))
            pending.clear()

    for m in CONTROL.finditer(data):
        word, value, hexa, symbol, brace, plain = m.groups()
        if brace:
            flush()
            if brace == b"{":
                stack.append((skip, unicode_width))
            elif stack:
                skip, unicode_width = stack.pop()
            continue
        if word in NO_TEXT or symbol == b"*":
            skip = True
        if word == b"htmltag" or word == b"mhtmltag":
            skip = True
        if skip:
            continue
        if hexa:
            if after_unicode:
                after_unicode -= 1
            else:
                pending.append(int(hexa, 16))
            continue
        flush()
        if word == b"ansicpg" and value:
            codec = "utf-8" if value == b"65001" else f"cp{int(value)}"
            try:
                b"".decode(codec)
            except LookupError:
                codec = "cp1252"
        elif word == b"u" and value:
            out.append(chr(int(value) % 65536))
            after_unicode = unicode_width
        elif word == b"uc" and value:
            unicode_width = int(value)
        elif word == b"bin" and value:
            raise ValueError("binary data in RTF")
        elif word in CHARACTERS:
            out.append(CHARACTERS[word])
        elif symbol in (b"~", b"_", b"\\", b"{", b"}"):
            out.append({b"~": "\xa0", b"_": "-"}.get(symbol, symbol.decode()))
        elif plain:
            text = plain.decode(codec, "replace")
            out.append(text[after_unicode:])
            after_unicode = 0
    flush()
    text = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return re.sub(r" \| *\n", "\n", text).strip()


def _named(file: CompoundFile) -> dict[int, int]:
    """Numbers of named properties (by their fixed ids) -> the numbers that this file gave them."""
    raw = file.stream("__nameid_version1.0", "__substg1.0_00030102") or b""
    return {struct.unpack_from("<I", raw, k)[0]: 0x8000 + (struct.unpack_from("<I", raw, k + 4)[0] >> 16) for k in range(0, len(raw) - 7, 8) if not struct.unpack_from("<I", raw, k + 4)[0] & 1}


def _person(name: str, *emails: str) -> dict[str, str]:
    email = next((e for e in emails if "@" in e), "").strip().lower()
    return {"display": re.sub(r"^['\"]|['\"]$", "", name.strip()), "email": email}


def _message(file: CompoundFile, path: tuple[str, ...], header: int, codepage: str, html_to_text: Callable[[str], str], depth: int = 0) -> dict:
    p = Properties(file, path, header, codepage, _named(file))
    headers = p.text(HEADERS)
    # on behalf of: who the message is from comes before who sent it
    sender = _person(p.text(SENT_NAME) or p.text(SENDER_NAME), p.text(SENT_SMTP), p.text(SENT_EMAIL), p.text(SENDER_SMTP), p.text(SENDER_EMAIL))
    if not sender["email"] and (m := re.search(r"(?im)^from:.*?([\w.+-]+@[\w.-]+)", headers)):
        sender["email"] = m[1].lower()
    people: dict[int, list[dict]] = {1: [], 2: []}
    for place in file.storages(path, "__recip_version1.0_#"):
        r = Properties(file, place, 8, p.codepage)
        one = _person(r.text(DISPLAY), r.text(SMTP), r.text(EMAIL))
        kind = r.number(RECIPIENT_KIND) or 1
        if kind in people and one not in people[kind]:
            people[kind].append(one)
    body = p.text(BODY)
    if not body.strip() and (html := p.binary(HTML)):
        body = html_to_text(html.decode("utf-8" if p.codepage == "utf-8" else p.codepage, "replace"))
    if not body.strip() and (packed := p.binary(RTF)):
        body = rtf_text(decompress_rtf(packed))
    header_date = re.search(r"(?im)^date:\s*(.+)$", headers)
    date = p.time(SUBMITTED) or p.time(DELIVERED) or (header_date[1].strip() if header_date else "") or p.time(CREATED)
    attachments = []
    for place in file.storages(path, "__attach_version1.0_#"):
        a = Properties(file, place, 8, p.codepage)
        inner = (*place, f"__substg1.0_{DATA:04X}000D")
        name = a.text(FILE_LONG) or a.text(FILE_SHORT) or a.text(DISPLAY)
        if inner in file.paths and a.number(METHOD) == 5 and depth == 0:
            m = _message(file, inner, 24, p.codepage, html_to_text, 1)
            nested = {k: m[k] for k in ("sender_name", "sender_email", "date_iso", "subject")} | {"body": m["body"][:30_000]}
            attachments.append({"file_name": name or "message.msg", "size": len(m["body"]), "inline": False, "link": False, "sha1": None, "doc_size": None, "email": nested})
            continue
        data = a.binary(DATA) or b""
        document = bool(re.search(r"(?i)\.(?:docx?|xlsx?|pptx?|pdf|txt|csv|md|rtf|zip)$", name))
        inline = bool(a.number(HIDDEN)) or bool(a.text(CONTENT_ID)) and bool((a.number(FLAGS) or 0) & 4)
        attachments.append({"file_name": name, "size": len(data), "inline": inline, "link": a.number(METHOD) == 7, "sha1": hashlib.sha1(data).hexdigest() if document and data else None, "doc_size": len(data) if document else None, "email": None})
    item_class = p.text(CLASS) or "IPM.Note"
    meeting = {"start_iso": p.time(START), "end_iso": p.time(STOP), "place": p.text(PLACE)} if item_class.startswith("IPM.Schedule.Meeting") else None
    return {
        "date_iso": date, "sender_name": sender["display"], "sender_email": sender["email"], "to_list": people[1], "cc_list": people[2], "subject": p.text(SUBJECT), "body": body.replace("\r\n", "\n"),
        "attachments": attachments, "message_id": p.text(MESSAGE_ID), "in_reply_to": p.text(REPLY_TO), "conversation_topic": p.text(TOPIC), "item_class": item_class,
        "auto_reply": item_class.startswith("IPM.Note.Rules.OofTemplate") or "auto-submitted: auto-replied" in headers.lower(), "reader": "msg", "read_error": "", "meeting": meeting,
    }


def msg_record(content: bytes, html_to_text: Callable[[str], str], mime_record: Callable[[bytes], dict] | None = None) -> dict:
    """The record of a message file; a clear-signed one is its signed part."""
    file = CompoundFile(content)
    found = _message(file, (), 32, "cp1252", html_to_text)
    if found["item_class"].startswith("IPM.Note.SMIME") and mime_record:
        for place in file.storages((), "__attach_version1.0_#"):
            data = Properties(file, place, 8).binary(DATA) or b""
            if data[:200].lower().find(b"multipart/signed") >= 0:
                inner = mime_record(data)
                found |= {k: inner[k] for k in ("body", "attachments") if inner[k]}
                found["attachments"] = [a for a in found["attachments"] if a["file_name"] != "smime.p7s"]
    return found
