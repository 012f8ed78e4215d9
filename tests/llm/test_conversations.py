import numpy as np

from gistmill.llm import conversations as c
from tests.llm.test_text_operators import mails


def buffered(*rows):
    """(root, idx, sender, expected, delivery) as rows of state."""
    out = np.zeros(len(rows), c.ROW)
    for k, (root, idx, sender, expected, delivery) in enumerate(rows):
        out[k] = (root, 0, idx, idx, sender, False, expected, 1, delivery, c.NEVER)
    return out


def test_late_arrival_waits_and_closes():
    rest, out, due = c.advance(buffered((1, 1, 5, 3, 1), (1, 2, 6, 3, 2)))
    assert out is None and len(rest) == 2 and due == 2 + c.PATIENCE
    rest, out, due = c.advance(np.concatenate([rest, buffered((1, 3, 5, 3, 4))]))
    assert not len(rest) and due is None and out.complete.all()
    assert list(zip(out.turn, out.idx, out.speaker)) == [(1, 1, "opener"), (2, 2, "responder"), (3, 3, "opener")]


def test_timeout_emits_an_open_form_and_a_later_message_a_new_one():
    rest, out, due = c.advance(buffered((1, 1, 5, 3, 1), (1, 2, 6, 3, 2), (9, 9, 5, 2, 7)), 2 + c.PATIENCE)
    assert list(out.idx) == [1, 2] and not out.complete.any() and set(out.version) == {2}
    assert len(rest) == 3 and due == 7 + c.PATIENCE  # the other one still has time
    assert c.advance(rest, 3 + c.PATIENCE)[1] is None  # told once
    rest, out, _ = c.advance(np.concatenate([rest, buffered((1, 3, 5, 3, 30))]))
    assert list(out.idx) == [1, 2, 3] and out.complete.all() and set(rest["root"]) == {9}


def test_invalid_ones_leave_without_a_word():
    bad = buffered((1, 1, 5, 2, 1), (1, 2, 6, 2, 1), (3, 3, 5, 2, 1), (3, 4, 5, 2, 1), (7, 8, 5, 2, 1), (7, 9, 6, 2, 1))
    bad["bad"][0] = True
    rest, out, due = c.advance(bad)
    assert not len(rest) and out is None and due is None
    assert not len(c.advance(bad[:0])[0])


def test_latest_form_counts(spark):
    rows = [(1, 0, 2, False), (1, 0, 3, False), (1, 0, 5, True), (2, 0, 1, False), (2, 0, 4, False), (2, 0, 4, False)]
    frame = spark.createDataFrame(rows, "root_idx long, slot int, version int, complete boolean")
    assert sorted((r.root_idx, r.version) for r in c.latest(frame).collect()) == [(1, 5), (2, 4), (2, 4)]


def test_stream_with_gaps_between_deliveries(spark):
    """Watermark and timeouts are at work: open forms are emitted on the way, the last forms are whole."""
    every = {root: (1, 8, 15, 22) if root % 200 else (1, 1, 22) for root in range(100, 2_000, 100)}
    rows = [(root, 0, root + k, 1_000 + k, 5 + k % 2, False, len(days), 1, day) for root, days in every.items() for k, day in enumerate(days)]
    frame = spark.createDataFrame(rows, "root long, slot int, idx long, utc_s long, sender long, bad boolean, expected int, parts int, delivery int")
    told = c.replay(frame, 3)
    assert told.where("not complete").count() > 0
    last = c.latest(told)
    assert last.where("not complete").count() == 0 and last.count() == len(rows)


def test_a_conversation_larger_than_a_slot(spark):
    n = 60_000
    at = lambda k: f"2024-01-{1 + k // 9_000:02d}T{k // 375 % 24:02d}:{k // 7 % 60:02d}:00Z"
    many = [(10 + k, k % 9, at(k), f"{k % 3}@x", "wall", "<10@x.example>" if k else None) for k in range(n) if k + 10 != 60]
    few = [(90_000, 0, at(1), "a@x", "gate", None), (90_001, 5, at(5), "b@x", "gate", "<90000@x.example>")]
    boxes = spark.createDataFrame([("m", "UTC", "en-GB")], "mailbox string, tz_name string, locale string")
    got = c.conversations(mails(spark, many + few), boxes).toPandas()
    large = got[got.root_idx == 10].sort_values("turn")
    want = sorted((t, i) for i, _, t, *_ in many)
    assert list(large.turn) == list(range(1, n)) and list(large.idx) == [i for _, i in want]
    assert list(large.speaker) == ["opener" if (i - 10) % 3 == 0 else "responder" for _, i in want]
    assert sorted(got[got.root_idx == 90_000].speaker) == ["opener", "responder"]
