import itertools
import random
import re

from gistmill.llm.conversations import conversations, roots
from gistmill.llm.name_variants import same_entity_pairs
from gistmill.llm.near_duplicates import near_duplicate_pairs, similar_sets
from gistmill.llm.own_words import lines_taken_off, own_lines, read_body
from gistmill.llm.wrong_charset import restore, wrong_fields

TEXTS = ["Größere Mängel – prüfen", "l’été à Noël : 5 €", "Proszę sprawdzić łączniki i śruby", "Запрос на пролёт", "Façade “type C” 25°C"]


def test_texts_come_back_from_the_wrong_set():
    for text in TEXTS:
        for name in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850"):
            try:
                wrong = text.encode().decode(name)
            except UnicodeDecodeError:
                continue
            assert restore(wrong) == (text, True), (name, text)
    assert restore("Größe".encode().decode("cp1252").encode().decode("cp1252")) == ("Größe", True)
    assert restore("Запрос 5".encode("cp1251").decode("cp1252"))[0] == "Запрос 5"
    assert restore("Вопрос по чертежу".encode("koi8-r").decode("cp1251"))[0] == "Вопрос по чертежу"


def test_single_byte_sets_that_were_confused():
    for text, written, read in [
        ("Le résumé est prêt", "cp1252", ("cp850", "mac_roman")), ("São João não", "cp1252", ("cp850",)), ("naïve café", "cp1252", ("cp850",)),
        ("Die Prüfung beträgt", "cp1252", ("cp850", "mac_roman", "cp1251", "cp866", "cp437")), ("Größere Mängel", "cp1252", ("cp850", "mac_roman", "cp437")),
        ("El niño comió", "cp1252", ("cp850", "cp437")), ("Proszę sprawdzić łączniki", "cp1250", ("cp1252",)), ("It’s likely", "cp1252", ("cp437",)),
    ]:
        for name in read:
            wrong = text.encode(written).decode(name)
            assert restore(wrong) == (text, True), (name, wrong, restore(wrong))
    for text in ["Запрос на пролёт", "Größere Mängel – prüfen"]:
        assert restore(text.encode().decode("cp866")) == (text, True)


def test_unusual_text_that_is_meant_so_is_left():
    for text in [*TEXTS, "", None, "√ checked   √ signed", "├── 01_models", "SÃO JOÃO – LOTE Â", "¿Ñ o N? – ver plano", "ATENÇÃO: NÃO AVANÇAR", "Ω 4.7", "25°C ±5 mm 3 m²", "plain", "can´t l´été", "McÉwan", "µm kΩ m³/h", "Acme®", "Вопрос RFI-12 по чертежу", "l’œuvre d’été", "Øystein’s ½ pipe"]:
        assert restore(text) == (text, False), text
    assert restore("lost � here")[1]


def test_wrong_fields(spark):
    rows = [(1, "GrÃ¶ÃŸe", "fine"), (2, None, ""), (3, "fine", "one\nitâ€™s\n" + "x" * 100_000)]
    emails = spark.createDataFrame(rows, "idx long, subject string, body string")
    assert sorted((r.idx, r.field) for r in wrong_fields(emails).collect()) == [(1, "subject"), (3, "body")]
    assert wrong_fields(emails.where("false")).count() == 0


BODY = """CAUTION: External sender - do not open attachments.
Hi Ann,

> 40 MPa is required at 28 days.
From: Depot A
To: Gate 4
Best option is the longer span, regards to cost.

Kind regards,
Bob Smith
Engineer | Acme
T +00 555 0123

P.S. Bring the keys.

________________________________
This email and any attachment is confidential and meant only for the addressee.

On Mon, 4 Mar 2024 at 10:12,
Ann Jones <ann@x.example> wrote:
> Can you check?
No, tomorrow.
> And the wall?
Yes.

From: Carl
Sent: Monday, 4 March 2024 09:00
To: Ann
Subject: wall

Old words."""


def test_lines_of_the_sender():
    new, closing = read_body(BODY, "Bob Smith", "bob.smith@acme.example")
    lines = BODY.split("\n")
    assert [lines[k - 1] for k in new] == ["Hi Ann,", "> 40 MPa is required at 28 days.", "From: Depot A", "To: Gate 4", "Best option is the longer span, regards to cost.", "P.S. Bring the keys.", "No, tomorrow.", "Yes."]
    assert closing == [9, 10, 11, 12]
    assert read_body("", "", "") == ([], []) and read_body(" \n\r\n", None, None) == ([], [])


MAIL = "idx long, mailbox string, date_iso string, sender_name string, sender_email string, subject string, conversation_topic string, body string"


def test_wrongly_decoded_bodies_are_read_as_they_were_written(spark):
    """Single-byte damage: each body holds nothing but its first line once it is put right."""
    assert read_body("Dzień dobry.\n\nZ powa¿aniem\nJan Kos", "Jan Kos", "jan.kos@acme.example") == ([1], [3, 4])
    damaged = "Это первая строка.\n\nС уважением,\nJan Kos".encode("koi8-r").decode("cp1251")
    assert read_body(damaged, "Jan Kos", "jan.kos@acme.example") == ([1], [3, 4])
    introduced = "Это первая строка.\n\nAnn <ann@x.example>\nписал(а) 15/11/2021 20:07:\n> Old.".encode("cp1251").decode("koi8-r")
    assert read_body(introduced, "Jan Kos", "jan.kos@acme.example")[0] == [1]
    # the thread compares what was written, too: the second message repeats a damaged passage in whole letters
    first = "Ściana oporowa przy bramie została dzisiaj ponownie zmierzona. Nikt jeszcze nie podpisał protokołu dla pompy."
    rows = [
        (1, "m", "2024-01-01T10:00:00Z", "A", "a@x", "Wall", "Wall", first.encode("cp1250").decode("cp1252")),
        (2, "m", "2024-01-02T10:00:00Z", "B", "b@x", "RE: Wall", "Wall", f"Agreed, go on.\n{first}"),
    ]
    emails = spark.createDataFrame(rows, MAIL)
    boxes = spark.createDataFrame([("m", "UTC", "en-GB")], "mailbox string, tz_name string, locale string")
    assert sorted(map(tuple, own_lines(emails, boxes).collect())) == [(1, 1), (2, 1)]


def test_passages_of_earlier_messages_are_not_new(spark):
    first = "The retaining wall at gate forty was measured again today. Nobody has signed the record for the pump skid yet."
    rows = [
        (1, "m", "2024-01-01T10:00:00Z", "A", "a@x", "Wall", "Wall", first),
        (2, "m", "2024-01-02T10:00:00Z", "B", "b@x", "RE: Wall", "Wall", f"Agreed, go on.\n{first}"),
        (3, "m", "2024-01-02T11:00:00Z", "C", "c@x", "RE: Wall", "", None),
        (4, "m", None, "C", "c@x", None, None, "Alone."),
    ]
    emails = spark.createDataFrame(rows, "idx long, mailbox string, date_iso string, sender_name string, sender_email string, subject string, conversation_topic string, body string")
    boxes = spark.createDataFrame([("m", "UTC", "en-GB")], "mailbox string, tz_name string, locale string")
    assert sorted(map(tuple, own_lines(emails, boxes).collect())) == [(1, 1), (2, 1), (4, 1)]
    assert own_lines(emails.where("false"), boxes).count() == 0


def test_a_passage_of_two_messages_in_different_parts_is_not_new(spark):
    """With automata of one message each, the two sentences of the last message are found by different ones."""
    one, two = "The retaining wall at gate forty was measured again today.", "Nobody has signed the record for the pump skid yet."
    rows = [
        (k, "m", f"2024-01-{k:02d}T10:00:00Z", "A", f"{k}@x", "Wall", "Wall", text)
        for k, text in enumerate([one, two, *[f"Message {k} says something of its own." for k in range(3, 12)], f"{one} {two}"], 1)
    ]
    emails = spark.createDataFrame(rows, MAIL)
    boxes = spark.createDataFrame([("m", "UTC", "en-GB")], "mailbox string, tz_name string, locale string")
    whole = sorted(map(tuple, own_lines(emails, boxes).collect()))
    assert whole == [(k, 1) for k in range(1, 12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(map(tuple, own_lines(emails, boxes).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_history_is_found_in_quotes_and_forms_are_left(spark):
    first = "The wall was measured again today. Nobody has signed yet."
    form = "Please see below. Thanks for your help."
    rows = [
        (1, "m", "2024-01-01T10:00:00Z", "A", "a@x", "Wall", "Wall", f"{first}\n{form}"),
        (2, "m", "2024-01-02T10:00:00Z", "B", "b@x", "RE: Wall", "Wall", "Noted.\n\n> The wall was measured again\n> today. Nobody has signed yet.\n> Something that nobody filed."),
        (3, "m", "2024-01-03T10:00:00Z", "C", "c@x", "RE: Wall", "Wall", form),  # other threads have it too
        (4, "m", "2024-01-03T10:00:00Z", "D", "d@x", "Gate", "Gate", form),
        (5, "m", "2024-03-01T10:00:00Z", "E", "e@x", "RE: Wall", "Wall", first),  # a new thread: silence of more than 21 days
        (6, "m", "2024-01-04T10:00:00Z", "A", "a@x", "RE: Wall", "Wall", first),  # the same sender, sent again
    ]
    emails, boxes = spark.createDataFrame(rows, MAIL), spark.createDataFrame([("m", "UTC", "en-GB")], "mailbox string, tz_name string, locale string")
    assert sorted(map(tuple, own_lines(emails, boxes).collect())) == [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    assert {r.taken_by: r.lines for r in lines_taken_off(emails, boxes).collect()} == {"mark alone": 1, "mark and earlier message": 2}


def test_near_duplicates_against_all_pairs(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(120):
        if i and random.random() < 0.6:
            text = random.choice(docs)[1].split()
            for _ in range(random.randint(0, 4)):
                text[random.randrange(len(text))] = random.choice(words)
        else:
            text = [random.choice(words) for _ in range(random.randint(1, 40))]
        docs.append((i, " ".join(text)))
    rows = [(i, "Title" if i % 7 else None, [(t,), (None,), ("",)]) for i, t in docs] + [(900, None, None), (901, "", [])]
    frame = spark.createDataFrame(rows, "doc_no long, title string, blocks array<struct<text:string>>")

    def grams(title, blocks):
        found = set()
        for t in [title or ""] + [b[0] or "" for b in blocks or []]:
            w = re.findall(r"\w+", t.lower())
            found |= set(zip(w, w[1:], w[2:]))
        return found

    sets = {r[0]: grams(r[1], r[2]) for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in near_duplicate_pairs(frame).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    assert near_duplicate_pairs(frame.where("false")).count() == 0
    small = spark.createDataFrame([(k, list(range(k % 5, k % 5 + 10 + k % 3))) for k in range(1, 40)], "key long, grams array<long>")
    brute = {(a.key, b.key) for a, b in itertools.combinations(small.collect(), 2) if len(set(a.grams) & set(b.grams)) >= 0.8 * len(set(a.grams) | set(b.grams))}
    assert {(r.a, r.b) for r in similar_sets(small, 0.8).collect()} == brute


def test_near_duplicates_do_not_send_each_sequence(spark):
    """The n-grams of a document travel packed, not as a row each: else the time grows beyond the limits on large tables."""
    random.seed(8)
    words = [f"w{k}" for k in range(2000)]
    texts = [[random.choice(words) for _ in range(80)] for _ in range(60)]
    texts += [[*t[:40], f"new{k}", *t[40:]] for k, t in enumerate(texts)] + texts[:20]
    # standard passages, and documents that share half of their words
    texts = [t + words[:40] for t in texts] + [[*t[:40], *(random.choice(words) for _ in range(40)), *words[:40]] for t in texts[:60]]
    frame = spark.createDataFrame([(i, None, [(" ".join(t),)]) for i, t in enumerate(texts)], "doc_no long, title string, blocks array<struct<text:string>>")
    sets = [set(zip(t, t[1:], t[2:])) for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    context = spark.sparkContext

    def sent():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = sent()
    assert {tuple(r) for r in near_duplicate_pairs(frame).collect()} == want and len(want) > 60
    assert sum(records for stage, records in sent().items() if stage not in before) < sum(map(len, sets)) / 2


def test_variants_of_names(spark):
    rows = [
        (1, "Stefanie Hesosen", "stefanie.hesosen@acme.example"), (2, "HESOSEN Stefanie", "stefanie.hesosen@acme.example"), (3, "", "STEFANIE.HESOSEN@ACME.EXAMPLE"),
        (4, "Stefanie Hesosen", ""), (5, "Stefanei Hesosen", "hesosen_s@acme.example"), (6, "S. Hesosen", "stefanie.hesosen@acme.example"),
        (7, "Irma Hesosen", "irma.hesosen@acme.example"), (8, "Stefanie Hesosen", "documents@acme.example"), (9, "Acme Civil Engineering Ltd", "info@acme.example"),
        (10, "Acme Civil Engineering", ""), (11, "info@acme.example", "info@acme.example"), (12, None, None), (13, "Karl Other", "documents@acme.example"),
    ]
    observations = spark.createDataFrame(rows, "obs_id long, display string, email string")
    emails = spark.createDataFrame([], "sender_name string, sender_email string, to_list array<struct<display:string,email:string>>, cc_list array<struct<display:string,email:string>>")
    got = {tuple(r) for r in same_entity_pairs(observations, emails).collect()}
    person, firm = [1, 2, 3, 4, 5, 6, 8], [9, 10, 11]
    assert got == set(itertools.combinations(person, 2)) | set(itertools.combinations(firm, 2))
    assert same_entity_pairs(observations.where("false"), emails).count() == 0


def mails(spark, rows):
    full = [(i, b, "m", d, s, f"RE: {t}" if r == "" else t, "text" if i != 60 else " \n", f"<{i}@x.example>", r, None) for i, b, d, s, t, r in rows]
    return spark.createDataFrame(full, "idx long, batch_id int, mailbox string, date_iso string, sender_email string, subject string, body string, message_id string, in_reply_to string, conversation_topic string")


def test_conversations(spark):
    at = "2024-01-{:02d}T10:00:00Z".format
    rows = [
        (1, 3, at(1), "a@x", "wall", None), (2, 0, at(2), "b@x", "wall", "<1@X.example>"), (3, 9, at(2), "A@x", "wall", "1@x.example"),
        (10, 0, at(1), "a@x", "gate", None), (11, 0, at(5), "b@x", "gate", ""),
        (20, 0, at(1), "a@x", "old", None), (21, 0, "2024-03-01T10:00:00Z", "b@x", "old", ""),
        (30, 0, at(1), "a@x", "lost", "<999@x.example>"), (31, 0, at(2), "b@x", "lost", "<30@x.example>"),
        (40, 0, at(1), "a@x", "ring", "<41@x.example>"), (41, 0, at(2), "b@x", "ring", "<40@x.example>"), (42, 0, at(3), "b@x", "ring", "<41@x.example>"),
        (50, 0, at(1), "a@x", "self", None), (51, 0, at(2), "a@x", "self", "<50@x.example>"),
        (60, 0, at(1), "a@x", "blank", None), (61, 0, at(2), "b@x", "blank", "<60@x.example>"),
        (70, 0, "n/a", "a@x", "undated", None), (71, 0, at(2), "b@x", "undated", "<70@x.example>"),
    ]
    boxes = spark.createDataFrame([("m", "UTC", "en-GB")], "mailbox string, tz_name string, locale string")
    got = sorted(tuple(r) for r in conversations(mails(spark, rows), boxes).collect())
    assert got == [(1, 1, 1, "opener"), (1, 2, 2, "responder"), (1, 3, 3, "opener"), (10, 1, 10, "opener"), (10, 2, 11, "responder")]
    assert conversations(mails(spark, []), boxes).count() == 0


def test_roots_of_long_chains_and_circles(spark):
    rows = [(0, None)] + [(k, k - 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (103, 100), (110, -1), (111, 110), (120, 555)]
    got = {r.idx: r.root for r in roots(spark.createDataFrame(rows, "idx long, parent long")).collect()}
    assert got == dict.fromkeys(range(40), 0)
