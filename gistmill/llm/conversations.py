"""Whole conversations from single message rows, with turns and speakers.

Links first: a reply belongs with the stored message that it names, or, if it names none, with the latest earlier message of
its topic within 21 days. Roots come from squaring these links; what leads to no stored message or runs in a
circle has no root. Then messages are replayed in the order in which scans delivered them, through keyed streaming state:
a conversation is buffered until all messages linked to it have arrived, late files included, and then validated and
emitted. One for which nothing came for :data:`PATIENCE` deliveries is emitted as far as it has come, marked as open,
by a timeout of the watermark; it stays buffered, and messages that arrive after all emit it anew. The latest form counts.
Delivery time is the event time, as it never runs backwards; dates in mails do.

State is keyed by slices: a slice holds many small conversations as one packed array, so that a call serves thousands of
rows; a conversation with more than :data:`SLOT` messages is spread over slices by a hash of its messages, is validated
over all of them after the stream, and its turns are counted by day, by second and within a second, so that no task and no
state value grows with a conversation.

Valid: at least two sender addresses, and no message with a blank body or without an instant. Defined results: copies of a
message count once, and so do repeated rows of one ``idx``; replies without a reference and without an earlier message of their topic, or with an
empty topic, open a conversation; NULL sender addresses are no address; equal instants go by ``idx``; an empty table has no
conversation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gistmill.functions.subjects import conversation_key, outermost
from gistmill.operators.delivery import identifier, keep_one, messages, says_nothing
from gistmill.operators.instants import with_instant
from gistmill.sources.tables import shared_dir, staged

DAYS = 21
DAY = 86_400
#: Messages of one conversation that stand in one slice of the state; more are spread over several.
SLOT = 4_096
#: Messages that a slice of the state sees in all, about.
SLICE = 2_000
#: Deliveries (scan runs) without a further message until an unfinished conversation is emitted as it is.
PATIENCE = 4
#: Deliveries that the watermark stays behind the latest one.
DELAY = 1
#: Micro-batches of a replay; each takes whole deliveries.
TRIGGERS = 4


def linked(emails: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``idx, parent, batch_id, utc_s, sender, blank`` of each kept message; ``parent`` -1: names a message that isn't stored."""
    columns = ["idx", "batch_id", "mailbox", "date_iso", "sender_email", "subject", "body", "message_id", "in_reply_to", "conversation_topic"]
    known = staged(messages(emails, least=1), "conversation-messages")
    kept = with_instant(keep_one(emails.select(*columns), known=known), mailboxes)
    address = F.lower(F.trim(F.coalesce("sender_email", F.lit(""))))  # a hash is enough: it is only compared within a conversation
    address = F.when(address == "", F.lit(0).cast("long")).otherwise(F.xxhash64(address))
    kept = kept.select(
        "idx", "batch_id", "utc_s", address.alias("sender"),
        F.coalesce(~F.col("body").rlike(r"[^\s\x{00A0}\x{200B}\x{FEFF}]"), F.lit(True)).alias("blank"),
        identifier(F.col("in_reply_to")).alias("target"), says_nothing(F.col("in_reply_to")).alias("no_target"),
        (outermost(F.col("subject")) == "reply").alias("is_reply"), conversation_key(F.col("conversation_topic"), F.col("subject")).alias("topic"),
    )
    kept = staged(kept, "conversation-rows")

    # the latest earlier message of a topic: within its day, else the last one of the day before that has any
    dated = kept.where("utc_s is not null and topic != ''").select("idx", "utc_s", "topic", F.floor(F.col("utc_s") / DAY).alias("day"), (F.col("no_target") & F.col("is_reply")).alias("asks"))
    within = Window.partitionBy("topic", "day").orderBy("utc_s", "idx")
    at = F.struct("utc_s", "idx")
    days = dated.groupBy("topic", "day").agg(F.max(at).alias("last")).withColumn("before", F.lag("last").over(Window.partitionBy("topic").orderBy("day")))
    asked = dated.withColumn("earlier", F.lag(at).over(within)).where("asks").join(days.select("topic", "day", "before"), ["topic", "day"])
    asked = asked.withColumn("p", F.coalesce("earlier", "before")).where(F.col("utc_s") - F.col("p.utc_s") <= DAYS * DAY)
    by_topic = asked.select("idx", F.col("p.idx").alias("topic_parent"))

    named = kept.where("not no_target").select("idx", "target").join(known.select(F.col("message_key").alias("target"), "kept"), "target", "left")
    by_name = named.select("idx", F.coalesce("kept", F.lit(-1)).alias("named_parent"))
    rows = kept.join(by_name, "idx", "left").join(by_topic, "idx", "left")
    rows = rows.select("idx", F.coalesce("named_parent", "topic_parent").alias("parent"), "batch_id", "utc_s", "sender", "blank")
    return rows.groupBy("idx").agg(*[F.first(c).alias(c) for c in rows.columns if c != "idx"])  # repeated rows; the joins have brought them together


def roots(links: DataFrame) -> DataFrame:
    """``idx, root`` of everything in ``idx, parent`` that hangs on a row without parent; links are squared until no more is found.

    As long as a chain is unfinished, each round finishes some of it; a round that finishes nothing leaves only circles.
    """
    nodes = staged(links.select("idx", F.coalesce("parent", "idx").alias("up"), (F.col("parent").isNull() | (F.col("parent") == -1)).alias("done")), "conversation-links")
    found, todo = nodes.where("done"), nodes.where("not done")
    rest = todo.count()
    while rest:
        above = nodes.select(F.col("idx").alias("up"), F.col("up").alias("further"), F.col("done").alias("above_done"))
        # a row without parent points to itself; one whose message isn't stored points to -1
        stepped = todo.join(above, "up", "left").select("idx", F.when(F.col("further").isNull(), -1).otherwise(F.col("further")).alias("up"), F.coalesce("above_done", F.lit(True)).alias("done"))
        stepped = staged(stepped, "conversation-links")
        nodes = found.unionByName(stepped)
        found, todo = nodes.where("done"), nodes.where("not done")
        left = todo.count()
        if left == rest:
            break
        rest = left
    return found.where("up != -1").select("idx", F.col("up").alias("root"))


#: A message in state. ``told``: the delivery up to which its conversation has been emitted.
ROW = np.dtype([("root", "i8"), ("slot", "i4"), ("idx", "i8"), ("utc_s", "i8"), ("sender", "i8"), ("bad", "?"), ("expected", "i4"), ("parts", "i4"), ("delivery", "i4"), ("told", "i4")])
RESULT = "root_idx long, slot int, parts int, turn int, idx long, utc_s long, sender long, bad boolean, speaker string, complete boolean, version int"
NEVER = np.iinfo(np.int32).min


def advance(rows: np.ndarray, now: int = 0, patience: int = PATIENCE) -> tuple[np.ndarray, pd.DataFrame | None, int | None]:
    """(rows that stay buffered, what is emitted, delivery of the next timeout) of a slice; ``now``: the watermark.

    All conversations of the slice are looked at together: complete ones are emitted and leave, and those that are overdue are
    emitted and stay.
    """
    if not len(rows):
        return rows, None, None
    rows = rows[np.lexsort((rows["idx"], rows["utc_s"], rows["slot"], rows["root"]))]
    first = np.concatenate([[True], (rows["root"][1:] != rows["root"][:-1]) | (rows["slot"][1:] != rows["slot"][:-1])])
    starts = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    count = np.diff(np.append(starts, len(rows)))
    complete = count >= rows["expected"][starts]
    last, told = np.maximum.reduceat(rows["delivery"], starts), np.maximum.reduceat(rows["told"], starts)
    waiting = ~complete & (last > told)
    overdue = waiting & (last + patience <= now)

    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    sender, opens = rows["sender"], rows["idx"] == rows["root"]
    two = np.maximum.reduceat(np.where(sender != 0, sender, low), starts) > np.minimum.reduceat(np.where(sender != 0, sender, high), starts)
    opener = np.maximum.reduceat(np.where(opens, sender, low), starts)
    valid = ~np.logical_or.reduceat(rows["bad"], starts) & np.logical_or.reduceat(opens, starts) & two
    # a part of a spread conversation is judged with the others
    shown = ((complete | overdue) & (valid | (rows["parts"][starts] > 1)))[of]
    out = None
    if shown.any():
        r, g = rows[shown], of[shown]
        out = pd.DataFrame({
            "root_idx": r["root"], "slot": r["slot"], "parts": r["parts"], "turn": (np.arange(len(rows)) - starts[of] + 1)[shown].astype(np.int32), "idx": r["idx"], "utc_s": r["utc_s"],
            "sender": r["sender"], "bad": r["bad"], "speaker": np.where(r["sender"] == opener[g], "opener", "responder"), "complete": complete[g], "version": last[g],
        })
    rows["told"] = np.where(overdue[of], last[of], rows["told"])
    next_ones = (last + patience)[waiting & ~overdue]
    return rows[~complete[of]], out, int(next_ones.min()) if len(next_ones) else None


def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keyed state of one slice: buffers messages, emits on closure or timeout."""
    held = np.frombuffer(state.get[0], ROW) if state.exists else np.empty(0, ROW)
    parts, mark = [held], state.getCurrentWatermarkMs()
    if not state.hasTimedOut:  # a slice with arrivals has no timeout of its own; what is overdue in it is seen to below
        for frame in frames:
            new = np.empty(len(frame), ROW)
            for name in ROW.names:
                new[name] = NEVER if name == "told" else frame[name].to_numpy()
            parts.append(new)
    rest, out, due = advance(np.concatenate(parts), mark // (DAY * 1000))
    if len(rest):
        state.update((rest.tobytes(),))
        if due is not None:
            state.setTimeoutTimestamp(max(due * DAY * 1000, mark + 1))
    elif state.exists:
        state.remove()
    if out is not None:
        yield out


def replay(rows: DataFrame, slices: int) -> DataFrame:
    """:data:`RESULT` of everything that the streaming state emits for ``rows``, delivery after delivery."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/gistmill-conversations-{uuid.uuid4().hex}"
    cuts = rows.agg(F.percentile_approx("delivery", [(k + 1) / TRIGGERS for k in range(TRIGGERS - 1)]), F.min("delivery"), F.max("delivery")).first()  # one row
    # a watermark starts at day 0, when nothing has been delivered yet
    shift = 1 - (cuts[1] or 0)
    borders = sorted({x + shift for x in [*(cuts[0] or []), cuts[2] or 0]})
    arrivals = rows.withColumn("delivery", (F.col("delivery") + shift).cast("int"))
    arrivals = arrivals.withColumn("delivered", F.timestamp_seconds(F.col("delivery").cast("long") * DAY)).withColumn("slice", F.pmod(F.xxhash64("root", "slot"), F.lit(slices)).cast("int"))
    for below, border in zip([None, *borders], borders):  # one after the other: a replay reads files by their time
        step = arrivals.where(F.col("delivery") <= border)
        (step if below is None else step.where(F.col("delivery") > below)).write.mode("append").parquet(f"{folder}/arrivals")
    files = len(spark.read.schema(arrivals.schema).parquet(f"{folder}/arrivals").inputFiles())
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", max(1, -(-files // TRIGGERS))).parquet(f"{folder}/arrivals")
    grouped = stream.withWatermark("delivered", f"{DELAY} days").groupBy("slice")
    told = grouped.applyInPandasWithState(gather, RESULT, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    query = told.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{folder}/told")


def latest(told: DataFrame) -> DataFrame:
    """Of each slot its complete form, or the last open one where it was never completed."""
    whole, still_open = told.where("complete"), told.where("not complete")
    part = ["root_idx", "slot"]
    newest = still_open.groupBy(*part).agg(F.max("version").alias("version"))
    still_open = still_open.join(newest, [*part, "version"]).join(whole.select(*part).distinct(), part, "left_anti")
    return whole.unionByName(still_open)


def _spread(rows: DataFrame) -> DataFrame:
    """Validity and turns of conversations that stand in several slots: partial aggregates, and counts by day, second and ``idx``."""
    said = F.when(F.col("sender") != 0, F.col("sender"))
    valid = rows.groupBy("root_idx").agg(F.min(said).alias("a"), F.max(said).alias("b"), F.max("bad").alias("any_bad"), F.max(F.when(F.col("idx") == F.col("root_idx"), F.col("sender"))).alias("opener"))
    rows = rows.join(valid.where("a < b and not any_bad and opener is not null").select("root_idx", "opener"), "root_idx").withColumn("day", F.floor(F.col("utc_s") / DAY))
    seconds = rows.groupBy("root_idx", "day", "utc_s").agg(F.count(F.lit(1)).alias("n"))
    days = seconds.groupBy("root_idx", "day").agg(F.sum("n").alias("n_day"))
    before = lambda n, *by: F.sum(n).over(Window.partitionBy("root_idx", *by[:-1]).orderBy(by[-1])) - F.col(n)
    days = days.select("root_idx", "day", before("n_day", "day").alias("days_before"))
    seconds = seconds.select("root_idx", "day", "utc_s", before("n", "day", "utc_s").alias("seconds_before"))
    rank = F.row_number().over(Window.partitionBy("root_idx", "day", "utc_s").orderBy("idx"))
    rows = rows.join(seconds, ["root_idx", "day", "utc_s"]).join(days, ["root_idx", "day"]).withColumn("turn", (F.col("days_before") + F.col("seconds_before") + rank).cast("int"))
    return rows.select("root_idx", "turn", "idx", F.when(F.col("sender") == F.col("opener"), "opener").otherwise("responder").alias("speaker"))


def conversations(emails: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``root_idx, turn, idx, speaker`` of every message of every valid conversation."""
    links = staged(linked(emails, mailboxes), "conversation-linked")
    rooted = roots(links.select("idx", "parent"))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1")  # one message has no reply
    sizes = sizes.withColumn("parts", F.ceil(F.col("size") / SLOT).cast("int"))
    rows = links.join(rooted.join(sizes, "root"), "idx").select(
        "root", F.pmod(F.xxhash64("idx"), "parts").cast("int").alias("slot"), "idx", F.coalesce("utc_s", F.lit(0)).alias("utc_s"), "sender",
        (F.col("blank") | F.col("utc_s").isNull()).alias("bad"), "parts", F.col("size").cast("int").alias("expected"), F.col("batch_id").alias("delivery"),
    )
    rows = staged(rows, "conversation-deliveries")
    spread = rows.where("parts > 1")
    shares = spread.groupBy("root", "slot").agg(F.count(F.lit(1)).cast("int").alias("share"))
    spread = spread.join(shares, ["root", "slot"]).withColumn("expected", F.col("share")).drop("share")
    told = replay(rows.where("parts = 1").unionByName(spread), max(1, rows.count() // SLICE))
    last = latest(told)
    return last.where("parts = 1").select("root_idx", "turn", "idx", "speaker").unionByName(_spread(last.where("parts > 1")))
