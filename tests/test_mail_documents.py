import io
import random
import zipfile

import pytest

from gistmill.operators.cleaning import ack
from gistmill.operators import documents as D
from gistmill.operators import mail as M
from gistmill.operators.quotes import never_filed, parse_quoted
from gistmill.plans.packing import pack
from gistmill.sources.docfiles import extract, read_documents
from gistmill.sources.mailfiles import html_to_text, merged, read_mail, scan, to_read
from gistmill.sources.parts import part_names, write_parts


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_threads_split_after_three_weeks_of_silence(spark):
    day = 86_400
    frame = rows(spark, "idx long, thread string, s long", (1, "a", 0), (2, "a", 21 * day), (3, "a", 42 * day + 1), (4, "b", 0), (5, "a", None))
    got = {r.idx: r.part_no for r in M.with_gaps(frame, "thread", "s", "idx").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}


def test_numbers_follow_the_order_over_days(spark):
    data = [(k, random.Random(k).randrange(5)) for k in range(50)]
    from pyspark.sql import functions as F

    frame = rows(spark, "idx long, day long", *data, (99, None))
    got = {r.idx: r.number for r in M.numbered(frame, F.col("day"), [F.col("idx")]).collect()}
    want = sorted(data, key=lambda x: (x[1], x[0])) + [(99, None)]
    assert got == {i: k for k, (i, _) in enumerate(want, 1)}


def test_near_copies_keep_the_slots_first_time(spark):
    schema = "key string, idx long, utc_s long, people string, message_key string"
    frame = rows(spark, schema, ("k", 1, 0, "a", None), ("k", 2, 100, "a", None), ("k", 3, 200, "a", None), ("k", 4, 210, "", None), ("k", 5, 50, "b", None), ("k", 6, 60, "a", "x"), ("k", 7, 70, "a", "y"), ("z", 8, None, None, None))
    got = {r.idx: r.slot for r in M.near_copies(frame).collect()}
    assert got[2] == 1 and got[3] == 3 and got[4] == 3 and got[5] == 5 and got[8] == 8


def test_nearest_in_time(spark):
    schema = "id long, who string, at timestamp_ntz"
    from datetime import datetime

    left = rows(spark, schema, (1, "a", datetime(2024, 1, 1, 0, 1)), (2, "a", datetime(2024, 1, 3)), (3, "b", datetime(2024, 1, 1)), (4, None, None))
    right = rows(spark, schema, (10, "a", datetime(2024, 1, 1, 0, 2)), (11, "a", datetime(2024, 1, 1)), (12, "c", datetime(2024, 1, 1)))
    got = {r.id: (r.near_id, r.gap_s) for r in M.nearest(left, right, "who", "at", "id", 120).collect()}
    assert got == {1: (10, 60), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_nearest_events_of_another_type(spark, tmp_path):
    """All events, odd and even, against all pairs."""
    from datetime import datetime, timedelta

    from gistmill.plans.digest_queries import QUERIES

    random.seed(3)
    data = [(k, random.choice([1, 1, 2, 3, None]), datetime(2024, 1, 1) + timedelta(seconds=random.randrange(9 * 86_400)), random.choice(["view", "click", "view", None])) for k in range(90)]
    data += [(90, 7, datetime(2024, 1, 1), "view"), (91, 7, datetime(2024, 1, 1), "view"), (92, 7, datetime(2024, 1, 2), "click"), (94, 7, datetime(2024, 1, 2), "error")]
    rows(spark, "event_id long, user_id long, ts timestamp_ntz, event_type string", *data).write.parquet(str(tmp_path / "events.parquet"))
    want = set()
    for i, user, at, kind in data:
        gaps = [(abs(int((at - t).total_seconds())), j) for j, u, t, k in data if user is not None and u == user and None not in (kind, k) and k != kind and abs((at - t).total_seconds()) <= 86_400]
        gap, near = min(gaps, default=(None, None))
        want.add((i, user, near, gap))
    assert {tuple(r) for r in QUERIES["nearest_events"](spark, str(tmp_path)).collect()} == want
    assert (90, 7, 92, 86_400) in want and (92, 7, 94, 0) in want


def test_acknowledgements_and_noise(spark):
    from pyspark.sql import functions as F

    frame = rows(spark, "t string", ("Thanks, noted.",), ("ok Bob",), ("Thanks, see 5",), ("Really?",), ("The wall is cracked badly",), ("",), (None,))
    assert [r[0] for r in frame.select(ack(F.col("t"))).collect()] == [True, False, False, False, False, False, False]  # "ok Bob" is an answer
    kinds = rows(spark, "c string, a boolean, s string, e string", ("IPM.Schedule.Meeting.Resp.Pos", False, "x", "a@x"), ("REPORT.IPM", None, None, None), ("IPM.Note", None, "Automatic reply: x", None), ("IPM.Note", False, "x", "no-reply@x"), ("IPM.Note", False, "x", "a@x"))
    assert [r[0] for r in kinds.select(M.noise_kind(F.col("c"), F.col("a"), F.col("s"), F.col("e"))).collect()] == ["meeting_response", "receipt", "auto_reply", "notification", None]


def blocks(spark, *texts):
    return rows(spark, "doc_no long, block_no long, block_type string, text string, level int, n_rows int", *[(1, k, kind, t, 1, None) for k, (kind, t) in enumerate(texts)])


def test_tables_sections_and_contents(spark):
    frame = blocks(spark, ("heading", "1 Scope"), ("para", "Scope .... 3"), ("para", "Walls .... 5"), ("para", "Gates .... 9"), ("row", "Title"), ("row", "a | b"), ("row", "a | c"), ("para", "x"), ("row", "p | q"))
    headers = {r.block_no: r.is_header for r in D.tables(frame).collect()}
    assert headers == {4: True, 5: True, 6: False, 8: True}
    assert {r.block_no for r in D.contents_lists(frame).collect()} == {1, 2, 3}
    assert {r.section for r in D.sections(frame).collect()} == {1}
    rarity = {r.block_no: r.rarity for r in D.row_rarity(frame).collect()}
    assert rarity[6] == 1.5 and rarity[8] == 2.0


def test_versions_and_their_differences(spark):
    body = [f"Sentence number {k} stays as it is." for k in range(8)]
    schema = "doc_no long, file_name string, kind string, status string, added_at timestamp, blocks array<struct<block_type:string,text:string,block_level:int,n_rows:int>>"
    make = lambda extra: [("para", t, 0, None) for t in [*body, extra]]
    frame = rows(spark, schema, (1, "Plan rev A.docx", "word", "ok", None, make("Old end.")), (2, "Plan rev B.docx", "word", "ok", None, make("New end.")), (3, "Other.docx", "word", "ok", None, None), (4, None, "word", "error", None, None))
    order = {r.doc_no: (r.version_no, r.previous) for r in D.versions(frame).collect()}
    assert order[1] == (1, None) and order[2] == (2, 1)
    change = D.version_changes(frame).collect()
    assert len(change) == 1 and change[0].changes == ["- Old end.", "+ New end."] and change[0].similarity > 0.9


def test_capped_texts_keep_their_limit_and_order():
    random.seed(3)
    words = "the wall was measured RFI 123 £45.00 on 4 May by crew and agreed ? . , ;".split()
    for _ in range(150):
        text = " ".join(random.choice(words) for _ in range(random.randint(1, 400)))
        for limit in (250, 550):
            out = D.cap_text(text, limit)
            assert len(out) <= limit + 2
            at = 0
            for piece in out.split(" …"):
                at = text.find(piece.strip()[:40], at)
                assert at >= 0


def test_packing_keeps_order_and_whole_threads():
    sizes = [("a", [40, 40]), ("b", [60]), ("c", [500, 30, 30]), ("d", [10])]
    got = [(t, k if k is not None else j, p) for (t, k, p), e in ((x, next(e for t, e in sizes if t == x[0])) for x in pack(((t, sum(e), e) for t, e in sizes), 200, 20)) for j in range(len(e) if k is None else 1)]
    assert [(t, k) for t, k, _ in got] == [(t, k) for t, e in sizes for k in range(len(e))]
    parts = [p for _, _, p in got]
    assert parts == sorted(parts) and parts[:3] == [1, 1, 1]


MAIL = b"""From: Ann Jones <ann@x.example>\r\nTo: "Bob, B." <bob@y.example>, bob@y.example\r\nSubject: =?utf-8?q?Gr=C3=B6=C3=9Fe?=\r\nDate: Mon, 4 Mar 2024 10:12:00 +0100\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hello <b>you</b></p><table><tr><td>a</td><td>b</td></tr></table>\r\n--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=note.txt\r\n\r\nhi\r\n--B--\r\n"""


def test_a_folder_of_mail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.EML").write_bytes(MAIL)
    (tmp_path / "b.msg").write_bytes(b"broken")
    (tmp_path / "~$c.eml").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x")
    files = scan(spark, str(tmp_path))
    got = {r.path[-5:]: r for r in read_mail(files).collect()}
    assert len(got) == 2
    a = got["a.EML"]
    assert (a.subject, a.sender_email, a.date_iso, a.message_id) == ("Größe", "ann@x.example", "2024-03-04T10:12:00+01:00", "<1@x>")
    assert "Hello you" in a.body and "a | b" in a.body and a.attachments[0].file_name == "note.txt" and a.attachments[0].sha1
    assert [p.email for p in a.to_list] == ["bob@y.example", "bob@y.example"] and got["b.msg"].read_error
    known = files.select("path", "modificationTime", "length")
    assert to_read(files, known).count() == 0
    assert to_read(files, known.where("path like '%msg'")).count() == 1
    old = rows(spark, "path string, n int", ("gone", 1), ("a", 1))
    new, there = rows(spark, "path string, n int", ("a", 2)), rows(spark, "path string", ("a",))
    assert {tuple(r) for r in merged(old, new, there, True).collect()} == {("a", 2)}
    assert {tuple(r) for r in merged(old, new, there, False).collect()} == {("a", 2), ("gone", 1)}


QUOTING = """Fine.

On Mon, 4 Mar 2024 at 10:12, Ann
<ann@x.example> wrote:
> First line
> Von: Bob <BOB@y.example>
> Gesendet: 3. März 2024 09:00
> Betreff: Wand
>
> Alt

From: Depot A
To: Gate 4"""


def test_quoted_messages(spark):
    got = parse_quoted(QUOTING)
    assert [(q["sender_email"], q["subject"]) for q in got] == [("ann@x.example", ""), ("bob@y.example", "Wand")]
    assert got[0]["body"] == "First line" and got[1]["body"].startswith("Alt") and parse_quoted(None) == [] and parse_quoted("") == []
    emails = rows(spark, "idx long, mailbox string, date_iso string, sender_email string, body string", (1, "m", "2024-03-05T10:00:00Z", "c@x", QUOTING), (2, "m", "2024-03-04T10:12:30Z", "Ann@x.example", None))
    boxes = rows(spark, "mailbox string, tz_name string, locale string", ("m", "UTC", "en-GB"))
    assert [(r.idx, r.depth, r.sender_email) for r in never_filed(emails, boxes).collect()] == [(1, 1, "bob@y.example")]


def test_html():
    assert html_to_text("<style>x</style><ol><li>one<li>two</ol><a href='https://x.example'>link</a>&amp;") == "1. one\n2. two\nlink <https://x.example>&"
    assert html_to_text("<p>open") == "open" and html_to_text("") == ""


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>Text </w:t><w:delText>gone</w:delText></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = archive({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>'})


def test_documents(spark, tmp_path):
    word = list(extract("a.docx", "word", DOCX))[0]
    assert (word["status"], word["title"]) == ("ok", "Scope") and [b["text"] for b in word["blocks"]] == ["Scope", "Text", "a | b"]
    excel = list(extract("a.xlsx", "excel", XLSX))[0]
    assert [(b["block_type"], b["text"]) for b in excel["blocks"]] == [("sheet", "One"), ("row", "head | 2")]
    found = list(extract("z.zip", "zip", archive({"a.docx": DOCX, "n.txt": "- one\n\npara", "x.bin": "?"})))
    assert [(d["member"], d["status"]) for d in found] == [(None, "ok"), ("a.docx", "ok"), ("n.txt", "ok")]
    bomb = archive({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})
    assert [d["status"] for d in extract("b.docx", "word", bomb)] == ["error"]
    random.seed(7)
    for _ in range(40):
        damaged = bytearray(DOCX)
        for _ in range(5):
            damaged[random.randrange(len(damaged))] = random.randrange(256)
        assert list(extract("d.docx", "word", bytes(damaged)))[0]["status"] in ("ok", "error", "no_text")
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "t.csv").write_text("a;b\n1;2\n")
    assert list(extract("e.txt", "text", b""))[0]["status"] == "no_text"
    got = {r["name"]: r for r in read_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.docx"].kind == "word" and got["t.csv"].blocks[1].text == "a | b"


def test_parts_are_written_all_or_none(tmp_path):
    names = part_names("My: project", 2, "24-01-01", "24-02-01")
    assert names[0] == "My project 24-01-01 to 24-02-01 part 1 of 2.txt"
    write_parts(str(tmp_path), names, ["one", "two"])
    with pytest.raises(ValueError):
        write_parts(str(tmp_path), ["x.txt", "y.txt"], ["only one"])
    assert sorted(p.name for p in tmp_path.glob("*.txt")) == sorted(names)
    assert write_parts(str(tmp_path), [names[0]], ["new"]) == [names[1]]
    assert (tmp_path / names[0]).read_text() == "new" and not (tmp_path / names[1]).exists()


def test_people_of_a_digest(spark):
    from pyspark.sql import functions as F

    from gistmill.operators import people as P

    names = rows(spark, "d string, e string", ("Jones, Ann", ""), ("'AnnJones' (X)", ""), (None, "ann.jones@x"), ("a@x", "bob_b@x"))
    assert [r[0] for r in names.select(P.tidy_name(F.col("d"), F.col("e"))).collect()] == ["Ann Jones", "Ann Jones", "Ann Jones", "Bob B"]
    domains = rows(spark, "domain string", ("x.com",), ("mail.x.com",), ("ax.com",), ("y.z.org",), (None,), ("",))
    assert {r.domain for r in P.listed_domains(domains).collect()} == {"x.com", "ax.com", "y.z.org"}
    labels = rows(spark, "label string", ("stonequay",), ("stonequarry",), ("acme",), ("ac-me",))
    assert {r.label: r.code for r in P.organisation_codes(labels).collect()} == {"stonequay": "STONEQUAY"[:9], "stonequarry": "STONEQUAR", "ac-me": "ACME", "acme": "ACME2"}
    people = rows(spark, "organisation string, email string, display string, uses long", ("o", "1", "Ann Jones", 5), ("o", "2", "Al Jonas", 9), ("o", "3", "Al Jonas", 1), ("o", "4", "Zed", 1))
    got = {r.email: r.alias for r in P.aliases(people).collect()}
    assert got["2"] == "AJ" and got["1"] == "AJo" and len({a.lower() for a in got.values()}) == 4
    assert P.legend(people).collect()[0].names == "Al Jonas; Al Jonas; Ann Jones; Zed"
    lines = [(1, p, k, t) for p in range(1, 5) for k, t in enumerate([f"Report 7 page {p}", "body", f"text {p}", f"more {p} m", "own words", f"{p} of 4"])]
    found = {(r.page, r.line_no) for r in P.page_furniture(rows(spark, "doc_no long, page long, line_no long, text string", *lines), 1).collect()}
    assert found == {(p, k) for p in range(1, 5) for k in (0, 5)}


def test_the_legend_names_everyone(spark):
    from gistmill.operators import people as P

    people = rows(spark, "organisation string, email string, display string, uses long", *[("o", str(k), f"Person {k:03}", k) for k in range(120)])
    got = P.legend(people).collect()
    assert [(r.organisation, r.people, r.names) for r in got] == [("o", 120, "; ".join(f"Person {k:03}" for k in range(120)))]
