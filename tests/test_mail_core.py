from datetime import datetime, timezone

from gistmill.operators.delivery import further_copies, keep_one
from gistmill.operators.instants import with_instant

ROWS = "idx long, message_id string, sender_email string, subject string, message_key string"


def pairs(spark, rows):
    return {tuple(r) for r in further_copies(spark.createDataFrame(rows, ROWS)).collect()}


def test_copies_of_one_message(spark):
    rows = [
        (5, "<A@x.example>", "a@x", "RE: one", "clash"),
        (2, " <a@X.example>\r\n ", "a@x", "one", None),
        (9, "a@x.example", "A@x", None, None),
        (3, "<noid@mailer.invalid>", "b@x", "two", None),
        (4, "<noid@mailer.invalid>", "c@x", "three", None),
        (6, None, "a@x", "one", None),
        (7, "", "a@x", "one", None),
        (8, " ", None, None, None),
        (10, "<unknown>", "b@x", "two", None),
        (11, "<unknown>", "c@x", "three", None),
        (12, "<shared@gate.example>", "b@x", "two", None),
        (13, "<shared@gate.example>", "c@x", "three", None),
    ]
    assert pairs(spark, rows) == {(2, 5), (2, 9)}
    kept = keep_one(spark.createDataFrame(rows, ROWS))
    assert sorted(r.idx for r in kept.collect()) == [2, 3, 4, 6, 7, 8, 10, 11, 12, 13]
    assert kept.columns[0] == "idx" and set(kept.columns) == {"idx", "message_id", "sender_email", "subject", "message_key"}


def test_no_copies_in_an_empty_table(spark):
    assert pairs(spark, []) == set()


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


CASES = [
    ("uk", "2024-05-01T10:00:00+02:00", at(2024, 5, 1, 8)),
    ("uk", "2024-05-01 10:00", at(2024, 5, 1, 9)),
    ("us", "5/1/2024 12:30 AM", at(2024, 5, 1, 4, 30)),
    ("us", "13/1/2024 12:30 PM", at(2024, 1, 13, 17, 30)),
    ("uk", "01/05/2024 12:30:07", at(2024, 5, 1, 11, 30, 7)),
    ("uk", "31.12.23 23:59", at(2023, 12, 31, 23, 59)),
    ("us", "11/3/2024 1:30 AM", at(2024, 11, 3, 5, 30)),  # twice: the first one
    ("us", "3/10/2024 2:30 AM", at(2024, 3, 10, 7, 30)),  # skipped: as if not put forward
    ("us", "Mon Jan 01 00:26:03 EST 2024", at(2024, 1, 1, 5, 26, 3)),
    ("au", "1 Jan 2024 10:00 EST", at(2024, 1, 1, 0)),
    ("uk", "Sat, 30 Oct 2021 20:51:01 +0200 (CEST)", at(2021, 10, 30, 18, 51, 1)),
    ("fr", "4 août 2023 à 07:07", at(2023, 8, 4, 5, 7)),
    ("es", "16 de mayo de 2024 17:59", at(2024, 5, 16, 15, 59)),
    ("uk", "Friday, February 16, 2024 6:02 AM", at(2024, 2, 16, 6, 2)),
    ("uk", "20210924T061937Z", at(2021, 9, 24, 6, 19, 37)),
    ("uk", "1631882936", 1631882936),
    ("uk", "1557191741982", 1557191741),
    ("uk", "1574754362169885", 1574754362),
    ("uk", "132088563265001583", 132088563265001583 // 10**7 - 11644473600),
    ("uk", "Sent: 27 May 2019 1:19 PM BST", at(2019, 5, 27, 12, 19)),
    ("nowhere", "2024-05-01 10:00", at(2024, 5, 1, 10)),
    (None, "2024-05-01 10:00", at(2024, 5, 1, 10)),
    *[("uk", x, None) for x in (None, "", "  ", "0", "yesterday", "n/a", "Sent:", "2024-02-30 10:00", "2024-01-01 25:00", "2024-01-01",
      "1601-01-01T00:00:00Z", "4501-01-01T00:00:00+00:00", "0000-00-00 00:00:00", "32/13/2024 10:00", "13:00 PM 1 May 2024", "9" * 5000)],
]
ZONES = [("uk", "Europe/London", "en-GB"), ("us", "America/New_York", "en-US"), ("au", "Australia/Brisbane", "en-AU"), ("fr", "Europe/Paris", "fr-FR"), ("es", "Europe/Madrid", "es-ES"), ("none", None, None)]


def test_instants(spark):
    rows = [(i, m, t, "kept") for i, (m, t, _) in enumerate(CASES)]
    emails = spark.createDataFrame(rows, "idx long, mailbox string, date_iso string, tz_name string")
    mailboxes = spark.createDataFrame(ZONES, "mailbox string, tz_name string, locale string")
    got = {r.idx: r for r in with_instant(emails, mailboxes).collect()}
    assert len(got) == len(CASES)
    for i, (m, t, want) in enumerate(CASES):
        assert got[i].utc_s == want, (m, t)
        assert got[i].tz_name == "kept"


def test_instants_of_an_empty_table(spark):
    emails = spark.createDataFrame([], "idx long, mailbox string, date_iso string")
    mailboxes = spark.createDataFrame([], "mailbox string, tz_name string, locale string")
    assert with_instant(emails, mailboxes).count() == 0
