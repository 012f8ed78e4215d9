import io
import struct
import zipfile
import zlib

from gistmill.sources import docfiles, mailfiles, msgfiles
from gistmill.sources.pdffiles import pdf_pages


def compound(streams):
    """A compound file of ``path -> bytes``; all streams in whole sectors (its cutoff is 0)."""
    tree = {"kids": {}}
    for path, data in streams.items():
        at = tree
        for name in path[:-1]:
            at = at["kids"].setdefault(name, {"kids": {}})
        at["kids"][path[-1]] = {"data": data}
    entries, sectors, fat = [], [], []

    def chain(data):
        if not data:
            return msgfiles.END
        first, n = len(sectors), -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[k * 512 : k * 512 + 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else msgfiles.END)
        return first

    def add(name, kind, node):
        k = len(entries)
        entries.append([name, kind, msgfiles.FREE, msgfiles.FREE, chain(node.get("data", b"")), len(node.get("data", b""))])
        before = None
        for kid, inner in node.get("kids", {}).items():
            at = add(kid, 1 if "kids" in inner else 2, inner)
            entries[k if before is None else before][3 if before is None else 2] = at
            before = at
        return k

    add("Root Entry", 5, tree)
    raw = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I16x4x16xIQ", len(n) * 2 + 2, kind, 1, msgfiles.FREE, right, child, start, size) for n, kind, right, child, start, size in entries)
    directory = chain(raw)
    while True:
        need = -(-(len(fat) + 1) * 4 // 512)
        if need * 128 >= len(fat) + need:
            break
    places = list(range(len(sectors), len(sectors) + need))
    fat += [0xFFFFFFFD] * need
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(need * 512, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1").ljust(24, b"\0") + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, need, directory, 0, 0, msgfiles.END, 0, msgfiles.END, 0)
    return head + struct.pack("<109I", *places, *[msgfiles.FREE] * (109 - need)) + b"".join(sectors) + table


def fixed(header, *values):
    return b"\0" * header + b"".join(struct.pack("<II8s", number << 16 | kind, 0, raw) for number, kind, raw in values)


def text(*path, **values):
    return {(*path, f"__substg1.0_{number}001F"): value.encode("utf-16-le") for number, value in values.items()}


def message(body="Hello Bob,\r\nthe pump is here.", **extra):
    streams = {("__properties_version1.0",): fixed(32, (0x39, 0x40, struct.pack("<Q", 133_500_000_000_000_000)))}
    values = {"0037": "RE: Pump", "001A": "IPM.Note", "0042": "Ann Lee", "5D02": "ann@x.example", "0C1A": "Desk", "1035": "<1@x>", "0070": "Pump", "1000": body} | extra
    streams |= {("__substg1.0_" + k + "001F",): v.encode("utf-16-le") for k, v in values.items() if v}
    for k, (kind, name, email) in enumerate([(1, "Bob", "bob@y.example"), (2, "Cy", "cy@y.example"), (1, "Bob", "bob@y.example")]):
        place = f"__recip_version1.0_#{k:08X}"
        streams |= {(place, "__properties_version1.0"): fixed(8, (0x0C15, 3, struct.pack("<q", kind)))} | {(place, f"__substg1.0_{n}001F"): v.encode("utf-16-le") for n, v in (("3001", name), ("39FE", email))}
    place = "__attach_version1.0_#00000000"
    streams |= {(place, "__properties_version1.0"): fixed(8, (0x3705, 3, struct.pack("<q", 1))), (place, "__substg1.0_3707001F"): "plan.pdf".encode("utf-16-le"), (place, "__substg1.0_37010102"): b"x" * 700}
    place = "__attach_version1.0_#00000001"
    inner = (place, "__substg1.0_3701000D")
    streams |= {(place, "__properties_version1.0"): fixed(8, (0x3705, 3, struct.pack("<q", 5))), (*inner, "__properties_version1.0"): fixed(24), (*inner, "__substg1.0_0037001F"): "Inner".encode("utf-16-le"), (*inner, "__substg1.0_1000001F"): "Inner text".encode("utf-16-le")}
    return compound(streams)


def test_outlook_message():
    r = msgfiles.msg_record(message(), mailfiles.html_to_text)
    assert (r["subject"], r["sender_name"], r["sender_email"], r["body"]) == ("RE: Pump", "Ann Lee", "ann@x.example", "Hello Bob,\nthe pump is here.")
    assert r["date_iso"] == "2024-01-17T21:20:00+00:00" and [p["email"] for p in r["to_list"]] == ["bob@y.example"] and [p["email"] for p in r["cc_list"]] == ["cy@y.example"]
    plan, nested = r["attachments"]
    assert plan["size"] == 700 and plan["sha1"] and nested["email"]["subject"] == "Inner" and nested["email"]["body"] == "Inner text"
    for cut in (100, 600, 2_000):
        try:
            msgfiles.msg_record(message()[:cut], mailfiles.html_to_text)
        except (ValueError, struct.error, IndexError):
            pass


def test_mail_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.msg").write_bytes(message())
    (tmp_path / "b.msg").write_bytes(b"damaged")
    (tmp_path / "c.eml").write_bytes(b"From: A <a@x.example>\r\nReceived: by x; Mon, 4 Mar 2024 10:12:00 +0100\r\nSubject: s\r\nContent-Type: text/calendar; method=REQUEST\r\n\r\nBEGIN:VEVENT\r\nDTSTART:20240305T090000Z\r\nDTEND:20240305T100000Z\r\nLOCATION:Room 1\r\nEND:VEVENT\r\n")
    out = {r.path[-5:]: r for r in mailfiles.read_mail(mailfiles.scan(spark, str(tmp_path))).collect()}
    assert out["a.msg"].reader == "msg" and out["a.msg"].read_error == "" and out["b.msg"].read_error
    assert out["c.eml"].date_iso.startswith("2024-03-04T10:12") and out["c.eml"].meeting.start_iso == "2024-03-05T09:00:00Z" and out["c.eml"].meeting.place == "Room 1"


def test_rtf():
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}\pard Gr\'f6\'dfe \u1047?\par Next\tab x\cell y\row{\*\generator z}}"
    assert msgfiles.rtf_text(rtf) == "Größe З\nNext\tx | y"
    stored = struct.pack("<II4sI", len(rtf) + 12, len(rtf), b"MELA", 0) + rtf
    assert msgfiles.decompress_rtf(stored) == rtf
    # one literal run and one copy of the ring's start
    packed = bytes([0b10000000]) + b"abcdefg" + (0 << 4 | 4).to_bytes(2, "big")
    assert msgfiles.decompress_rtf(struct.pack("<II4sI", len(packed) + 12, 13, b"LZFu", 0) + packed) == b"abcdefg{\\rtf1"


def pdf(*pages):
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))), len(pages)), b"<</Type/Font/Subtype/Type1>>"]
    for k, content in enumerate(pages):
        raw = zlib.compress(content)
        objects += [b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (5 + 2 * k), b"<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(raw), raw)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s endobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>"


def test_pdf():
    one = rb"BT /F1 20 Tf 50 700 Td (Scope \(part\)) Tj /F1 10 Tf 0 -40 Td (The wall is 3 m high and) Tj 0 -12 Td [(must be che)-20(cked.)] TJ 0 -12 Td (1. First item) Tj ET"
    pages, note = pdf_pages(pdf(one, b""))
    assert [t for _, t in pages[0]] == ["Scope (part)", "The wall is 3 m high and", "must be checked.", "1. First item"] and note == ""
    (document,) = docfiles.extract("a.pdf", "pdf", pdf(one, b""))
    assert document["status"] == "ok" and document["title"] == "Scope (part)" and "1 of 2 pages have no text" in document["note"]
    assert [(b["block_type"], b["text"]) for b in document["blocks"]][1:4] == [("heading", "Scope (part)"), ("para", "The wall is 3 m high and must be checked."), ("item", "1. First item")]
    assert next(docfiles.extract("b.pdf", "pdf", pdf(b"")))["status"] == "no_text"
    assert next(docfiles.extract("c.pdf", "pdf", pdf(one) + b"/Encrypt 9 0 R"))["status"] == "protected"
    assert next(docfiles.extract("d.pdf", "pdf", b"%PDF-1.4 broken"))["status"] in ("no_text", "error")


def test_office_by_relations():
    def archive(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, part in parts.items():
                z.writestr(name, part)
        return out.getvalue()

    rel = '<Relationships>{}</Relationships>'.format
    ids = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2, 3))
    sheet = '<worksheet><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row><c r="A1" t="inlineStr"><is><t>{}</t></is></c><c r="B1" s="1"><v>45000</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>'.format
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="Moved" r:id="r3"/><sheet name="Hidden" state="hidden" r:id="r1"/><sheet name="Last" r:id="r2"/></sheets></workbook>'
    styles = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    data = archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rel(ids), "xl/styles.xml": styles, **{f"xl/worksheets/sheet{k}.xml": sheet(f"s{k}") for k in (1, 2, 3)}})
    (document,) = docfiles.extract("a.xlsx", "excel", data)
    assert [(b["block_type"], b["text"]) for b in document["blocks"]] == [("sheet", "Moved"), ("row", "s3 | 2023-03-15"), ("sheet", "Last"), ("row", "s2 | 2023-03-15")]
    assert [docfiles.excel_date(x) for x in (1, 59, 60, 61, 0.25, 45000.5)] == ["1900-01-01", "1900-02-28", "1900-02-29", "1900-03-01", "06:00", "2023-03-15 12:00"]
    assert docfiles.delimiter('a;"x,y";c\n1;2,5;3') == ";" and docfiles.delimiter("a,b\n1,2") == ","
    wide = [{k: f"h{k}" for k in range(9)}, {k: str(k) for k in range(9)}, {2: "x"}]
    assert docfiles.render_rows(wide)[2] == "h2: x"
    many = archive({f"{k:03d}.txt": "words" for k in range(docfiles.MOST_MEMBERS + 3)})
    assert "3 further members" in next(docfiles.extract("a.zip", "zip", many))["note"]


def test_loose_documents_are_read_once(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "~$c.txt", "d.tmp", ".e.txt", "out/f.txt", "g.eml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"same words")
    files = docfiles.scan_documents(spark, str(tmp_path), skip_folder="out")
    assert sorted((r.path.rpartition("/")[2], r.is_mail) for r in files.select("path", "is_mail").collect()) == [("a.txt", False), ("b.txt", False), ("g.eml", True)]
    assert [r.name for r in docfiles.read_once(files.where("not is_mail")).collect()] == ["a.txt"]


def test_html():
    text = mailfiles.html_to_text
    assert text("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>") == "a | b\nc"
    layout = "<table><tr><td><p>Hello</p><table><tr><td>1</td><td>2</td></tr></table></td><td>side</td></tr></table>"
    assert [x for x in text(layout).split("\n") if x] == ["Hello", "1 | 2", "side"]
    assert text('<ol type="a" start="2"><li>x<li>y</ol><ol type="I"><li>z</ol><ul><li>u</ul>').split("\n")[0] == "b. x" and "I. z" in text('<ol type="I"><li>z</ol>')
    assert text("<p>see <a href='https://x.org/a'>plan</a></p><script>no</script><td>loose") == "see plan <https://x.org/a>\nloose"
    assert text("<table><tr><td>open") == "open" and text("") == ""
