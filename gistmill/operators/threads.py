"""Messages as a digest shows them: quoted and attached ones matched with filed ones, threads split into conversations, writers' clocks.

Matching: a person's keys are the address and the folded name; a quoted message is the filed one of the same person whose time is nearest
(two minutes, unless the texts are clearly different; or a whole number of hours off with the same text), else one with the same
beginning and the same body. Candidates meet by key and time bucket, or by key and beginning, never by pairs of everything.

Splitting: a conversation ends where its thread is silent for 21 days, unless the next message answers into it. Such places are first
messages of days, so they are found from one row per thread and day, and a thread has few of them; no task holds a thread.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import subjects
from gistmill.operators.cleaning import bodies_cleaned
from gistmill.operators.delivery import keep_one
from gistmill.operators.instants import with_instant
from gistmill.operators.mail import GAP, thread_key
from gistmill.operators.quotes import quoted
from gistmill.sources.tables import spread

DAY = 86_400
#: Seconds that two clocks may differ, letters that are compared, hours that time zones may lie apart.
NEAR, OPENING, HOURS = 120, 40, 15


def letters(text: Column) -> Column:
    """The letters and digits of a text, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def person_keys(email: Column, name: Column) -> Column:
    """``e:address`` and ``n:letters of the name's words in order``; none where both are empty."""
    address = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    words = F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^()]*\)", " ")), r"[^\p{L}]+", " "), " "), lambda w: w != ""))
    key = F.array_join(words, "")
    return F.filter(F.array(F.when(address.contains("@"), F.concat(F.lit("e:"), address)), F.when((key != "") & ~F.coalesce(name, F.lit("")).contains("@"), F.concat(F.lit("n:"), key))), lambda k: k.isNotNull())


def same_start(a: Column, b: Column) -> Column:
    """Letters that begin alike: the first forty are equal, or an opening of fifteen or more is part of the other."""
    x, y = F.substring(a, 1, OPENING), F.substring(b, 1, OPENING)
    k = F.least(F.length(a), F.length(b), F.lit(OPENING))
    equal = (k > 0) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return equal | (F.length(x) >= 15) & b.contains(x) | (F.length(y) >= 15) & a.contains(y)


def clearly_different(a: Column, b: Column) -> Column:
    """Both say something, they don't begin alike, and they part within the first twenty letters."""
    k = F.least(F.length(a), F.length(b), F.lit(20))
    return (F.length(a) > 0) & (F.length(b) > 0) & ~same_start(a, b) & (F.substring(a, F.lit(1), k) != F.substring(b, F.lit(1), k))


def same_whole(a: Column, b: Column) -> Column:
    """They begin alike, and a short one is no small part of the other."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return same_start(a, b) & ((short >= OPENING) | (short >= long * 0.6))


def mail_index(messages: DataFrame, also_filed: DataFrame | None = None) -> DataFrame:
    """``person, f_idx, f_s, f_letters, f_prefix``: one row for each key of each message's sender; the index that matching joins.

    ``also_filed``: further messages of the same columns that are filed but not shown, such as those outside a span of dates.
    """
    columns = ["idx", "sender_email", "sender_name", "utc_s", "text"]
    messages = messages.select(columns) if also_filed is None else messages.select(columns).unionByName(also_filed.select(columns))
    rows = messages.select(F.explode(person_keys(F.col("sender_email"), F.col("sender_name"))).alias("person"), F.col("idx").alias("f_idx"), F.col("utc_s").alias("f_s"), letters(F.col("text")).alias("f_letters"))
    return rows.withColumn("f_prefix", F.substring("f_letters", 1, 80))


def matched(quotes: DataFrame, index: DataFrame) -> DataFrame:
    """``q_id, f_idx, gap_s, hours`` of each quote that is filed; ``quotes``: ``q_id, idx, sender_email, sender_name, utc_s, text``.

    A message is no match of its own quotes. ``hours``: whole hours by which the quote's clock differs.
    """
    asked = quotes.select("q_id", "idx", "utc_s", letters(F.col("text")).alias("q_letters"), F.explode(person_keys(F.col("sender_email"), F.col("sender_name"))).alias("person"))
    bucket = lambda s: F.floor(s / 3600)
    by_time = asked.where("utc_s is not null").withColumn("bucket", F.explode(F.sequence(bucket(F.col("utc_s")) - HOURS - 1, bucket(F.col("utc_s")) + HOURS + 1)))
    timed = by_time.join(index.where("f_s is not null").withColumn("f_bucket", bucket(F.col("f_s"))).withColumnRenamed("person", "f_person"), (F.col("person") == F.col("f_person")) & (F.col("bucket") == F.col("f_bucket")) & (F.col("idx") != F.col("f_idx")))
    gap = F.abs(F.col("utc_s") - F.col("f_s"))
    hours = F.round(gap / 3600)
    off = F.abs(gap - hours * 3600)
    here = (gap <= NEAR) & ~clearly_different(F.col("q_letters"), F.col("f_letters"))
    elsewhere = (gap > NEAR) & (hours <= HOURS) & (off <= NEAR) & same_whole(F.col("q_letters"), F.col("f_letters"))
    timed = timed.where(here | elsewhere).select("q_id", "f_idx", F.lit(0).alias("way"), gap.alias("gap_s"), F.when(gap <= NEAR, 0).otherwise(F.signum(F.col("utc_s") - F.col("f_s")) * hours).cast("int").alias("hours"), "f_s")
    prefix = F.substring("q_letters", 1, 80)
    alike = asked.where("length(q_letters) >= 15").withColumn("prefix", prefix).join(index.withColumnRenamed("person", "f_person"), (F.col("person") == F.col("f_person")) & (F.col("prefix") == F.col("f_prefix")) & (F.col("idx") != F.col("f_idx")))
    alike = alike.where(F.col("q_letters").startswith(F.col("f_letters")) | F.col("f_letters").startswith(F.col("q_letters")))
    alike = alike.select("q_id", "f_idx", F.lit(1).alias("way"), F.lit(0).cast("long").alias("gap_s"), F.lit(None).cast("int").alias("hours"), "f_s")
    best = F.min(F.struct("way", "gap_s", F.coalesce("f_s", F.lit(1 << 60)).alias("at"), "f_idx", "hours"))
    return timed.unionByName(alike).groupBy("q_id").agg(best.alias("b")).select("q_id", "b.f_idx", "b.gap_s", "b.hours")


def writer_hours(quotes: DataFrame, found: DataFrame) -> DataFrame:
    """``person, month, hours``: the whole hours by which quotes of a writer most often differ from the filed messages; none where two are equal."""
    rows = quotes.join(found.where("hours is not null"), "q_id").select(F.lower("sender_email").alias("person"), F.date_format(F.timestamp_seconds("utc_s"), "yyyy-MM").alias("month"), "hours")
    rows = rows.groupBy("person", "month", "hours").agg(F.count(F.lit(1)).alias("n"))
    top = rows.groupBy("person", "month").agg(F.max("n").alias("most"))
    rows = rows.join(top, ["person", "month"]).where("n = most")
    return rows.groupBy("person", "month").agg(F.min("hours").alias("hours"), F.count(F.lit(1)).alias("tied")).where("tied = 1").select("person", "month", "hours")


def prepared(emails: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Each message once, with its instant, its cleaned text and its thread; texts are cleaned before copies are told apart."""
    rows = with_instant(keep_one(emails), mailboxes)
    cleaned = bodies_cleaned(spread(emails.select("idx", "body", "sender_name"))).dropDuplicates(["idx"])
    return rows.join(cleaned, "idx").withColumn("thread", thread_key(F.col("subject")))


def quotes_of(messages: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """The quoted messages of :func:`prepared` ones, as :func:`matched` asks for them, with ``depth``."""
    rows = quoted(messages.select("idx", "body")).join(messages.select("idx", "mailbox", "thread"), "idx")
    rows = with_instant(rows, mailboxes)
    return rows.select(F.concat_ws("/", "idx", "depth").alias("q_id"), "idx", "depth", "thread", "sender_email", "sender_name", "utc_s", F.col("body").alias("text"))


def conversation_parts(messages: DataFrame, quotes: DataFrame, found: DataFrame, gap: int = GAP) -> DataFrame:
    """``idx, thread, part_no``: the conversation of its thread that a message is in.

    Behind a silence of more than ``gap`` seconds a new one begins, unless a message quotes the current one, or is a reply of which nothing says
    that it answers something else: its first quote is missing or names no sender or date. Undated messages are in the first part.
    """
    dated = messages.where("utc_s is not null").select("idx", "thread", "utc_s", F.floor(F.col("utc_s") / DAY).alias("day"), (subjects.outermost(F.col("subject")) == "reply").alias("is_reply"))
    at = F.struct("utc_s", "idx")
    days = dated.groupBy("thread", "day").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min_by("is_reply", at).alias("is_reply"))
    order = Window.partitionBy("thread").orderBy("day")
    days = days.withColumn("before", F.lag("last").over(order))
    places = days.where(F.col("first.utc_s") - F.col("before.utc_s") > gap).select("thread", "day", F.col("first.utc_s").alias("s"), F.col("first.idx").alias("idx"), "is_reply")
    # the latest message of the thread that is quoted, and whether the first quote tells whom it answers
    told = quotes.join(found, "q_id", "left").join(messages.select(F.col("idx").alias("f_idx"), F.col("thread").alias("f_thread"), F.col("utc_s").alias("f_s")), "f_idx", "left")
    told = told.groupBy("idx").agg(
        F.max(F.when(F.col("thread") == F.col("f_thread"), F.col("f_s"))).alias("latest"),
        F.coalesce(F.max(F.when(F.col("depth") == 0, (F.coalesce("sender_email", F.lit("")) != "") & F.col("utc_s").isNotNull())), F.lit(False)).alias("knows"),
    )

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        begin, rows, part = -float("inf"), [], 1
        for r in frame.sort_values(["s", "idx"]).itertuples():
            inside = pd.notna(r.latest) and begin <= r.latest < r.s
            if not inside and (r.knows or not r.is_reply):
                part, begin = part + 1, r.s
                rows.append((r.thread, r.day, part))
        return pd.DataFrame(rows, columns=["thread", "day", "part"])

    splits = places.join(told, "idx", "left").select("thread", "day", "s", "idx", "is_reply", "latest", F.coalesce("knows", F.lit(False)).alias("knows"))
    splits = splits.groupBy("thread").applyInPandas(fold, "thread string, day long, part long")  # a row for each silence of a thread
    parts = days.select("thread", "day").join(splits, ["thread", "day"], "left").withColumn("part_no", F.coalesce(F.max("part").over(order), F.lit(1)))
    out = dated.join(parts.select("thread", "day", "part_no"), ["thread", "day"]).select("idx", "thread", "part_no")
    return out.unionByName(messages.where("utc_s is null").select("idx", "thread", F.lit(1).cast("long").alias("part_no")))


def recovered(quotes: DataFrame, found: DataFrame, hours: DataFrame) -> DataFrame:
    """Quoted messages that nobody filed, each once: the newest quote of it tells, dated by its writer's clock.

    ``q_id, idx, thread, sender_email, sender_name, utc_s, text``; quotes without a sender are left out.
    """
    rows = quotes.join(found.select("q_id"), "q_id", "left_anti").where("coalesce(sender_email, '') != '' or coalesce(sender_name, '') != ''")
    month = F.date_format(F.timestamp_seconds("utc_s"), "yyyy-MM")
    rows = rows.withColumn("month", month).join(hours.withColumnRenamed("person", "h_person").withColumnRenamed("month", "h_month"), (F.lower("sender_email") == F.col("h_person")) & (F.col("month") == F.col("h_month")), "left")
    rows = rows.withColumn("utc_s", F.col("utc_s") - F.coalesce("hours", F.lit(0)) * 3600)
    who = F.coalesce(F.nullif(F.lower("sender_email"), F.lit("")), letters(F.col("sender_name")))
    rows = rows.withColumn("once", F.xxhash64(who, F.substring(letters(F.col("text")), 1, 80), F.when(F.length(letters(F.col("text"))) < 15, F.col("utc_s"))))
    first = rows.groupBy("once").agg(F.min(F.struct("depth", "idx", "q_id")).alias("f")).select(F.col("f.q_id").alias("q_id"))
    return rows.join(first, "q_id", "left_semi").select("q_id", "idx", "thread", "sender_email", "sender_name", "utc_s", "text")


def inline_replies(quotes: DataFrame, found: DataFrame, messages: DataFrame) -> DataFrame:
    """``idx, q_id, replies``: lines inside the first quote of a message that its filed original doesn't have: answers between the lines."""
    pairs = quotes.where("depth = 0").join(found.select("q_id", "f_idx"), "q_id").join(messages.select(F.col("idx").alias("f_idx"), F.col("body").alias("original")), "f_idx")
    lines = lambda c: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^[>|\s]+", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    known = F.regexp_replace(F.coalesce("original", F.lit("")), r"[\s>|]+", "")
    new = F.filter(lines(F.col("text")), lambda x: ~F.col("known").contains(F.regexp_replace(x, r"[\s>|]+", "")))
    return pairs.withColumn("known", known).select("idx", "q_id", new.alias("replies")).where(F.size("replies") > 0)


def aliases_of(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """``path, alias`` of the sender of each record, for the documents digest."""
    return records.select("path", F.lower("sender_email").alias("email")).join(aliases.select("email", "alias"), "email", "left").select("path", "alias")


def identities(seen: DataFrame) -> DataFrame:
    """``name, email``: the address that a bare name means, by its folded words, else by the part before the at sign; none where two fit alike."""
    words = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), " "), lambda w: w != "")), "")
    filed = seen.where("email != '' and display != ''")
    by_name = filed.select(words(F.col("display")).alias("key"), F.lit(0).alias("way"), "email", "n")
    by_local = filed.select(words(F.regexp_extract("email", "^([^@]+)", 1)).alias("key"), F.lit(1).alias("way"), "email", "n")
    known = by_name.unionByName(by_local).where("key != ''").groupBy("key", "way", "email").agg(F.sum("n").alias("n"))
    bare = seen.where("email = '' and display != '' and not contains(display, '@')").select(F.col("display").alias("name"), words(F.col("display")).alias("key")).distinct()
    asked = bare.join(known, "key")
    best = asked.groupBy("name").agg(F.min(F.struct("way", -F.col("n"), "email")).alias("b"), F.min("way").alias("way"))
    ties = asked.groupBy("name", "way").agg(F.countDistinct("email").alias("k"))
    return best.join(ties, ["name", "way"]).where("k = 1").select("name", F.col("b.email").alias("email"))
