"""Text of PDF files by the standard library: objects, object streams, page order, fonts' character maps, text operators.

Lines come from the places where text is shown, headings from lines in a clearly larger size. Budgets bound objects, bytes and pages; what is
beyond them gives a note. Encrypted files are told, and pages without text are counted, as scans have none.
"""

from __future__ import annotations

import re
import time
import zlib

MOST_OBJECTS, MOST_STREAM, MOST_ALL = 300_000, 60_000_000, 200_000_000
OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
TOKEN = re.compile(rb"\s+|%[^\r\n]*|(\()|(<<|>>|[\[\]])|<([0-9A-Fa-f\s]*)>|(/[^\s()<>\[\]{}/%]*)|([+-]?(?:\d+\.?\d*|\.\d+))|([A-Za-z'\"*]+[0-9*]*)|.", re.S)


class Ref(int):
    """A reference to an object."""


class Pdf:
    """The objects of a file, found by scanning, so that damaged tables of contents don't matter."""

    def __init__(self, data: bytes):
        self.data, self.spent = data, 0
        self.places: dict[int, int] = {}
        for m in OBJECT.finditer(data):
            self.places[int(m[1])] = m.end()  # the last one of a number counts
            if len(self.places) > MOST_OBJECTS:
                break
        self.cache: dict[int, object] = {}
        self.inner: dict[int, object] = {}
        self.encrypted = bool(re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data))
        for number in list(self.places):
            if data[self.places[number] : self.places[number] + 400].find(b"/ObjStm") >= 0:
                self._unpack(number)

    def _unpack(self, number: int) -> None:
        top, raw = self.stream(number)
        if not isinstance(top, dict) or top.get("Type") != "/ObjStm" or raw is None:
            return
        n, first = int(self.get(top.get("N")) or 0), int(self.get(top.get("First")) or 0)
        head = [int(x) for x in raw[:first].split()[: 2 * n]]
        for k in range(0, len(head) - 1, 2):
            if head[k] not in self.places:
                self.inner[head[k]] = self.parse(raw, first + head[k + 1])[0]

    def parse(self, data: bytes, at: int) -> tuple[object, int]:
        """(value, place behind it)."""
        stack: list = []
        kinds: list[bytes] = []
        tops: list[list] = [[]]
        while m := TOKEN.match(data, at):
            at = m.end()
            text, mark, hexa, name, number, word = m.groups()
            value: object
            if text:
                value, at = self._string(data, at)
            elif mark in (b"<<", b"["):
                kinds.append(mark)
                tops.append([])
                if len(tops) > 60:
                    raise ValueError("nested too deeply")
                continue
            elif mark:
                if not kinds:
                    break
                kind, items = kinds.pop(), tops.pop()
                value = dict(zip((str(k)[1:] for k in items[::2]), items[1::2])) if kind == b"<<" else items
            elif hexa is not None:
                plain = re.sub(rb"\s", b"", hexa)
                value = bytes.fromhex((plain + b"0" * (len(plain) % 2)).decode())
            elif name:
                value = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name).decode("latin-1")
            elif number:
                value = float(number) if b"." in number else int(number)
            elif word:
                if word == b"R" and len(tops[-1]) > 1 and isinstance(tops[-1][-2], int):
                    tops[-1].pop()
                    value = Ref(tops[-1].pop())
                elif word in (b"true", b"false", b"null"):
                    value = {b"true": True, b"false": False, b"null": None}[word]
                else:  # endobj, stream and the like
                    at = m.start()
                    break
            else:
                continue
            tops[-1].append(value)
            if len(tops) == 1 and not (isinstance(value, int) and re.match(rb"\s+\d{1,5}\s+R\b", data[at : at + 12])) and not (len(tops[0]) > 1):
                break
        stack = tops[0]
        return (stack[-1] if stack else None), at

    @staticmethod
    def _string(data: bytes, at: int) -> tuple[bytes, int]:
        out, depth = bytearray(), 1
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        while at < len(data):
            c = data[at : at + 1]
            at += 1
            if c == b"\\":
                e = data[at : at + 1]
                if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                    out.append(int(octal[0], 8) & 255)
                    at += len(octal[0])
                else:
                    at += 2 if e == b"\r" and data[at + 1 : at + 2] == b"\n" else 1
                    out += b"" if e in b"\r\n" else escapes.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out), at

    def get(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            if value not in self.cache:
                self.cache[value] = self.parse(self.data, self.places[value])[0] if value in self.places else self.inner.get(value)
            value = self.cache[value]
        return None

    def stream(self, number: int) -> tuple[object, bytes | None]:
        """(dictionary, decoded bytes) of an object with a stream."""
        if number not in self.places:
            return None, None
        top, at = self.parse(self.data, self.places[number])
        m = re.compile(rb"\s*stream\r?\n?").match(self.data, at)
        if not isinstance(top, dict) or not m:
            return top, None
        length = self.get(top.get("Length"))
        end = m.end() + length if isinstance(length, int) and self.data[m.end() + length : m.end() + length + 20].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", m.end())
        raw = self.data[m.end() : end if end >= 0 else len(self.data)]
        filters = self.get(top.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if self.get(name) == "/FlateDecode":
                d = zlib.decompressobj()
                try:
                    raw = d.decompress(raw, MOST_STREAM)
                except zlib.error:
                    return top, None
                if d.unconsumed_tail:
                    raise ValueError("a stream is too large")
            elif self.get(name) == "/ASCIIHexDecode":
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode())
            else:
                return top, None
        self.spent += len(raw)
        if self.spent > MOST_ALL:
            raise ValueError("too much data")
        return top, raw

    def pages(self, most: int) -> list[dict]:
        """The pages in order, with what they inherit."""
        root = next((v for n in [*self.places, *self.inner] if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "/Catalog"), None)
        found: list[dict] = []
        todo, seen = [(root.get("Pages"), {})] if root else [], set()
        while todo and len(found) < most:
            ref, above = todo.pop(0)
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref if isinstance(ref, Ref) else id(ref))
            here = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo = [(k, here) for k in kids] + todo
            else:
                found.append(here | node)
        if not found:
            found = [v for n in sorted(self.places) if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "/Page"][:most]
        return found


def _unicode_map(raw: bytes) -> tuple[dict[int, str], int]:
    """(code -> text, bytes of a code) of a character map."""
    table: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode().ljust(4 * -(-len(h) // 4), "0") if len(h) > 2 else h.decode().zfill(4)).decode("utf-16-be", "replace")
    width = 1
    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", raw)
    if space:
        width = len(space[1]) // 2
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        for low, high, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 65_535) + 1)
            if listed:
                table |= dict(zip(codes, map(text, re.findall(rb"<([0-9A-Fa-f]+)>", listed))))
            else:
                first = text(to)
                table |= {c: first[:-1] + chr(min(ord(first[-1]) + k, 0x10FFFF)) for k, c in enumerate(codes) if first}
    return table, width


def _fonts(pdf: Pdf, page: dict) -> dict[str, tuple[dict[int, str], int]]:
    resources = pdf.get(page.get("Resources"))
    fonts = pdf.get(resources.get("Font")) if isinstance(resources, dict) else None
    out = {}
    for name, ref in (fonts or {}).items() if isinstance(fonts, dict) else ():
        font = pdf.get(ref)
        out[f"/{name}"] = ({}, 1)
        if isinstance(font, dict):
            to = font.get("ToUnicode")
            raw = pdf.stream(to)[1] if isinstance(to, Ref) else None
            if raw:
                out[f"/{name}"] = _unicode_map(raw)
            elif font.get("Subtype") == "/Type0":
                out[f"/{name}"] = ({}, 2)
    return out


def _page_lines(pdf: Pdf, page: dict) -> list[tuple[float, str]]:
    """(size, text) of each line of a page, as shown."""
    contents = pdf.get(page.get("Contents"))
    refs = contents if isinstance(contents, list) else [page.get("Contents")]
    raw = b"\n".join(pdf.stream(r)[1] or b"" for r in refs if isinstance(r, Ref))
    fonts = _fonts(pdf, page)
    table, width, size, scale, y, last_y, last_x_end, x = {}, 1, 10.0, 1.0, 0.0, None, None, 0.0
    lines: list[list] = []

    def show(data: bytes) -> None:
        nonlocal last_y, x, last_x_end
        codes = [int.from_bytes(data[k : k + width], "big") for k in range(0, len(data), width)]
        text = "".join(table.get(c, "" if width > 1 else bytes([c]).decode("cp1252", "replace")) for c in codes)
        big = size * scale
        if last_y is None or abs(y - last_y) > big * 0.4 or not lines:
            lines.append([big, ""])
        elif last_x_end is not None and x - last_x_end > big * 0.2 and not lines[-1][1].endswith(" "):
            lines[-1][1] += " | " if x - last_x_end > big * 2.5 else " "
        lines[-1][1] += text
        lines[-1][0] = max(lines[-1][0], big)
        last_y = y
        x += len(text) * big * 0.5
        last_x_end = x

    args: list = []
    at, line_x = 0, 0.0
    while m := TOKEN.match(raw, at):
        at = m.end()
        text, mark, hexa, name, number, word = m.groups()
        if text:
            value, at = Pdf._string(raw, at)
            args.append(value)
        elif mark == b"[":
            args.append("[")
        elif hexa is not None:
            plain = re.sub(rb"\s", b"", hexa)
            args.append(bytes.fromhex((plain + b"0" * (len(plain) % 2)).decode()))
        elif name:
            args.append(name.decode("latin-1"))
        elif number:
            args.append(float(number))
        elif word:
            numbers = [a for a in args if isinstance(a, float)]
            if word == b"Tf" and len(args) > 1:
                table, width = fonts.get(args[-2], ({}, 1)) if isinstance(args[-2], str) else ({}, 1)
                size = numbers[-1] if numbers else size
            elif word == b"Tm" and len(numbers) > 5:
                scale, x, y = abs(numbers[-3]) or 1.0, numbers[-2], numbers[-1]
                line_x = x
            elif word in (b"Td", b"TD") and len(numbers) > 1:
                x, y = line_x + numbers[-2] * scale, y + numbers[-1] * scale
                line_x = x
            elif word in (b"T*", b"'", b'"'):
                y -= size * scale * 1.2
                x = line_x
            elif word == b"BT":
                scale, x, y, line_x = 1.0, 0.0, 0.0, 0.0
            if word in (b"Tj", b"'", b'"', b"TJ"):
                for a in args:
                    if isinstance(a, bytes):
                        show(a)
                    elif isinstance(a, float) and word == b"TJ" and a < -180 and lines and not lines[-1][1].endswith(" "):
                        lines[-1][1] += " "
            args = []
        if len(args) > 5_000:
            args = []
    return [(big, " ".join(t.split())) for big, t in lines if t.strip()]


def pdf_pages(data: bytes, most: int = 2_000, seconds: float = 20.0) -> tuple[list[list[tuple[float, str]]], str]:
    """(lines of each page, what was not read)."""
    pdf = Pdf(data)
    if pdf.encrypted:
        raise PermissionError("encrypted")
    began, out, note = time.monotonic(), [], ""
    pages = pdf.pages(most + 1)
    for page in pages[:most]:
        if time.monotonic() - began > seconds:
            note = f"partly read: {len(out)} of {len(pages)} pages in the time there is"
            break
        try:
            out.append(_page_lines(pdf, page))
        except (ValueError, IndexError, KeyError, TypeError, zlib.error):
            out.append([])
            note = "partly read: a page is damaged"
    if len(pages) > most:
        note = f"partly read: the first {most} pages"
    return out, note


def page_blocks(pages: list[list[tuple[float, str]]]) -> list[tuple[str, str, int]]:
    """(kind, text, level) of pages of lines: headings by size, items by their marks, rows by their bars, other lines joined to paragraphs."""
    sizes = sorted(big for lines in pages for big, text in lines for _ in range(len(text)))
    usual = sizes[len(sizes) // 2] if sizes else 10.0
    out: list[tuple[str, str, int]] = []
    for number, lines in enumerate(pages, 1):
        out.append(("page", str(number), 0))
        open_one = False
        for big, text in lines:
            heading = big > usual * 1.15 and len(text) < 150
            item = re.match(r"^(?:[•●▪*-]|\(?[0-9a-z]{1,3}[.)])\s+\S", text)
            kind = "heading" if heading else "row" if " | " in text else "item" if item else "para"
            if kind == "para" and open_one and out[-1][0] in ("para", "item") and not re.search(r"[.!?:]$", out[-1][1]):
                joined = out[-1][1]
                joined = joined[:-1] + text if re.search(r"[a-z]-$", joined) and text[:1].islower() else f"{joined} {text}"
                out[-1] = (out[-1][0], joined, 0)
            else:
                out.append((kind, text, 1 if heading and big > usual * 1.5 else 2 if heading else 0))
            open_one = kind in ("para", "item")
    return out
