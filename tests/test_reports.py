from datetime import datetime

from gistmill.operators import documents as D
from gistmill.operators import reports as R
from pyspark.sql import functions as F


def test_alignment_and_changes():
    old = ["1 Scope", "The wall is 3 m high.", "Same here.", "HP7 | 6.1 | Hold", "Gone now."]
    new = ["2 Scope", "The wall is 4 m high.", "Same here.", "HP7 | 6.2 | Hold", "All new."]
    assert R.aligned(old, new) == [(2, 2)]
    near, lines = R.change_lines(old, new)
    assert lines == ["~ The wall is [-3-] {+4+} m high.", "- Gone now.", "~ HP7 | 6.1 -> 6.2 | Hold", "+ All new."] and 0.5 < near < 1
    assert R.change_lines(old, old) == (1.0, []) and R.change_lines([], []) == (1.0, []) and R.change_lines([], ["a"])[1] == ["+ a"]
    register = [f"item {k} | {k} | open" for k in range(1_500)]
    changed = [f"item {k} | {k + 1} | closed" for k in range(1_500)]
    assert R.change_lines(register, changed)[1][0] == "~ item 0 | 0 -> 1 | open -> closed"
    many = [f"unit {k % 50} {k}" for k in range(20_000)]
    assert len(R.aligned(many, many[:10_000] + ["x"] + many[10_000:])) == 20_000


def test_versions_show_their_changes(spark):
    block = "array<struct<block_type:string,text:string,block_level:int,n_rows:int,hidden:boolean,size:long,sha1:string>>"
    text = "The wall is three metres high. The gate is closed. The pump is ready."
    rows = [
        (1, "s1", "Wall rev A.pdf", "pdf", "ok", None, None, 2, False, 1, "r", [("heading", "Scope", 1, None, False, None, None), ("para", text, 0, None, False, None, None)], datetime(2024, 1, 1)),
        (2, "s2", "Wall rev B.pdf", "pdf", "ok", None, None, 2, False, 1, "r", [("heading", "Scope", 1, None, False, None, None), ("para", text.replace("three", "four"), 0, None, False, None, None)], datetime(2024, 1, 2)),
        (3, "s3", "Copy.pdf", "pdf", "ok", None, None, 1, False, 1, "r", [("heading", "Scope", 1, None, False, None, None), ("para", text, 0, None, False, None, None)], datetime(2024, 1, 3)),
        (4, "s4", "ST-1200 [C].pdf", "pdf", "ok", None, None, 1, True, 1, "r", [("row", "Title: Footing plan | Rev B", 0, None, False, None, None), ("para", "FOR CONSTRUCTION", 0, None, False, None, None)], None),
        (5, None, None, "pdf", "no_text", "scan", None, 3, None, 0, "r", None, None),
    ]
    docs = spark.createDataFrame(rows, f"doc_no long, sha1 string, file_name string, kind string, status string, note string, title string, pages int, drawing boolean, chars long, reader string, blocks {block}, added_at timestamp_ntz")
    got = {r.doc_no: r.text for r in R.documents_digest(docs).collect()}
    assert got[1].startswith("## D1 Wall rev A.pdf; 2 pages\n# Scope\n") and "three metres" in got[1]
    assert got[2] == "## D2 Wall rev B.pdf; 2 pages\nChanges from D1:\n~ The wall is [-three-] {+four+} metres high."
    assert got[3] == "## D3 Copy.pdf; 1 page\nSame text as D1" and got[5] == "## D5 unnamed; 3 pages; no_text; scan"
    assert got[4] == "## D4 ST-1200 [C].pdf; 1 page\nDrawing: Footing plan; rev C; FOR CONSTRUCTION"
    assert R.documents_digest(docs.where("false")).count() == 0
    assert [r.doc_no for r in R.focus_documents(docs, "gate; ST 1200").orderBy("doc_no").collect()] == [1, 2, 3, 4]
    assert [r.doc_no for r in R.focus_documents(docs, "", docs.where("doc_no = 5 or doc_no = 1").select("sha1")).collect()] == [1]


def test_drawings(spark):
    names = ["623.0001-ST-1200 Plan.pdf", "SK01.pdf", "Report rev B 1234.pdf", "Sketch.pdf", "1234 rev C.pdf", "Notes.pdf", None]
    frame = spark.createDataFrame([(n, 2, False, None) for n in names] + [("Big.pdf", 30, True, False), ("Big report.pdf", 30, True, True)], "n string, p int, l boolean, t boolean")
    assert [r[0] for r in frame.select(R.is_drawing(F.col("n"), F.col("p"), F.col("l"), F.col("t"))).collect()] == [True, True, False, True, True, False, False, True, False]
    lines = spark.createDataFrame([("12 Footing 900 450 25 mm",), ("RD-ST-1002 GENERAL NOTES B A1",), ("The wall is 3 m",)], "t string")
    assert [r[0] for r in lines.select(R.table_row(F.col("t"))).collect()] == [True, True, False]
    said = "the wall along the boundary has been measured again and it is out of level by more than the tolerance " * 3
    pages = spark.createDataFrame([(1, 1, said + "a"), (1, 2, said + "b"), (2, 1, said), (2, 2, said), (3, 1, "short")], "doc_no long, page int, text string")
    assert {r.doc_no: r.prose for r in R.prose_pages(pages).collect()} == {1: True, 2: False, 3: False}


def test_photos_files_and_sizes(spark):
    photos = spark.createDataFrame([("t", f"IMG_{k}.jpg") for k in range(9720, 9729)] + [("t", "IMG_9720 (1).jpg"), ("u", "DSC2.jpg"), ("u", "DSC10.jpg"), ("u", "none.jpg")], "k string, file_name string")
    assert {(r.k, r.label) for r in R.photo_groups(photos, ["k"]).collect()} == {("t", "IMG_9720-9728"), ("u", "DSC2,10")}
    sizes = spark.createDataFrame([(None,), (-1,), (12,), (2_048,), (1_300_000,)], "s long")
    assert [r[0] for r in sizes.select(R.size_text(F.col("s"))).collect()] == ["", "", "12 bytes", "2 KB", "1.2 MB"]


def test_pieces_and_rejoined_lines():
    assert R.rejoined(["The wall is mea-", "sured again", "Next one.", "and so on"]) == ["The wall is measured again", "Next one.", "and so on"]
    long = "First item costs 5, " + "and the second part goes on for a while; " * 8
    assert all(len(p) <= 240 for p in R.fact_pieces(long)) and " ".join(R.fact_pieces(long)).split() == long.split()
    assert R.incomplete_reason(10, 4, 6, 0) and R.incomplete_reason(10, 9, 1, 1) and not R.incomplete_reason(10, 9, 1, 0)


def test_capped_texts_pull_what_they_refer_to():
    text = "The opening is here. " + "Nothing much is said in this one. " * 20 + "The concrete costs $ 4,000 now. This brings RFI 12 and RFI 13 to 25 mm. " + "Nothing again. " * 20
    out = D.cap_text(text, 160)
    assert "This brings RFI 12" in out and "The concrete costs" in out and len(out) <= 162
    assert "The concrete" not in D.cap_text(text, 160, seen=("The concrete costs $ 4,000 now. This brings RFI 12 and RFI 13 to 25 mm.",))
    assert len(D.cap_text("word. " * 200_000, 500)) <= 502


def test_caps_with_replies():
    out = D.cap_with_replies("The opening is here. " * 30, "yes " * 100, 300)
    assert out.endswith("]") and "[inline replies: yes" in out and len(out) < 340
    assert D.cap_with_replies("short", "", 300) == "short"


def test_boilerplate_by_section(spark):
    rows = [("heading", "Limitations"), ("para", "The words here say nothing of use."), ("para", "The depth is 25 mm here."), ("heading", "3 Works"), ("para", "The Contractor shall indemnify third parties without written consent. Copyright and liability."), ("para", "Copyright of this report is ours, all rights reserved; confidential.")]
    rows += [("para", f"Body text {k} about the works.") for k in range(12)] + [("para", "Acme Pty, www.acme.example, tel: 02 9999 9999, info@acme.example")]
    frame = spark.createDataFrame([(1, k, kind, t, 1, None) for k, (kind, t) in enumerate(rows)], "doc_no long, block_no long, block_type string, text string, level int, n_rows int")
    assert [r.block_no for r in D.boilerplate(frame).where("is_boilerplate").orderBy("block_no").collect()] == [1, 5, 18]
