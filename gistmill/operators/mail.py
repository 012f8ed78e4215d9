"""Relational passes over mail: classes of messages, threads, gaps, copies, attachments, documents, nearest-time joins.

All are declarative; windows are partitioned by a thread, a document or a day, never by nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import subjects
from gistmill.operators.delivery import identifier

DAY = 86_400
GAP = 21 * DAY
PHOTO = r"(?i)^(?:img|dsc|dscn|pxl|photo|p)[ _-]?\d{3,}.*\.(?:jpe?g|heic|png)$"
INLINE = r"(?i)^(?:image|logo|outlook)[ _-]?\d*\.(?:png|jpe?g|gif|bmp)$"
DOCUMENT = r"(?i)\.(?:docx?|xlsx?|xlsm|pptx?|pdf|txt|md|csv|rtf|zip)$"
NO_REPLY = r"(?i)^(?:no-?reply|do-?not-?reply|notifications?|mailer-daemon|postmaster)@"


# What chat systems and machines put in front of a subject or into an address.
RESPONSE_SUBJECT = r"(?i)^\s*(?:accepted|declined|tentative(?:ly accepted)?|new time proposed|zugesagt|abgelehnt|mit vorbehalt|accepté|refusé|aceptado|rechazado|aceita|zaakceptowano|принято)\s*:"
RECEIPT_SUBJECT = r"(?i)^\s*(?:read|not read|delivered|undeliverable|delivery (?:status notification|failure|delayed)|gelesen|unzustellbar|zugestellt|lu|non remis|leído|no entregado|lida|não entregue|niedostarczalne|прочитано)\s*(?::|$)|(?i)^\s*(?:delivery status notification|mail delivery (?:failed|subsystem))"


def noise_kind(item_class: Column, auto_reply: Column, subject: Column, sender: Column) -> Column:
    """Why a message carries nothing, or NULL: the first that fits of response, receipt, automatic answer, notification; chats are none of these."""
    from gistmill.operators.cleaning import is_chat

    bare = subjects.without_tags(subject)
    return (
        F.when(is_chat(sender, subject), None)
        .when(F.coalesce(item_class.rlike(r"^IPM\.Schedule\.Meeting\.Resp"), F.lit(False)) | bare.rlike(RESPONSE_SUBJECT), "meeting_response")
        .when(F.coalesce(item_class.startswith("REPORT"), F.lit(False)) | bare.rlike(RECEIPT_SUBJECT), "receipt")
        .when(F.coalesce(auto_reply, F.lit(False)) | (subjects.outermost(subject) == "automatic"), "auto_reply")
        .when(sender.rlike(NO_REPLY), "notification")
    )


def thread_key(subject: Column) -> Column:
    return F.lower(subjects.bare(subject))


def with_gaps(rows: DataFrame, key: str, seconds: str, tie: str, gap: int = GAP) -> DataFrame:
    """``rows`` with ``part_no``: a new part begins where a key is silent for more than ``gap`` seconds; undated rows are in the first."""
    order = Window.partitionBy(key).orderBy(F.col(seconds).asc_nulls_first(), tie)
    starts = (F.col(seconds) - F.lag(seconds).over(order) > gap).cast("long")
    return rows.withColumn("_starts", F.coalesce(starts, F.lit(0))).withColumn("part_no", F.sum("_starts").over(order) + 1).drop("_starts")


def numbered(rows: DataFrame, day: Column, order: list[Column], out: str = "number") -> DataFrame:
    """``rows`` numbered from 1 in the order of ``day`` and ``order``, without a window over everything: counts per day are summed up.

    The days are few however many rows there are; NULL days come last.
    """
    rows = rows.withColumn("_day", F.coalesce(day.cast("long"), F.lit(1 << 40)))
    sizes = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_day")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_day").orderBy(*order))
    return rows.join(sizes, "_day").withColumn(out, F.col("_before") + rank).drop("_day", "_before")


#: A date that names its zone in the plain form.
ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def sent_at(date_iso: Column, mtime: Column) -> Column:
    """When a message was sent, in UTC without zone, where its date is plain and no stand-in (before 1971, after 2200); else the time of its file."""
    year = F.substring(date_iso, 1, 4).try_cast("int")
    micros = F.unix_micros(F.when(date_iso.rlike(ZONED) & year.between(1971, 2200), date_iso.try_cast("timestamp")))
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.coalesce(start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)")), mtime)


def attachments(emails: DataFrame) -> DataFrame:
    """One row per attachment: ``idx, position, file_name, kind, key`` with kind inline, link, email, photo, document or other."""
    rows = emails.select("idx", "path", "mtime", "subject", F.posexplode("attachments").alias("position", "a"))
    name = F.coalesce("a.file_name", F.lit(""))
    kind = (
        F.when(F.col("a.email").isNotNull(), "email").when(F.col("a.link"), "link")
        .when(F.col("a.inline") | name.rlike(INLINE), "inline").when(name.rlike(PHOTO), "photo").when(name.rlike(DOCUMENT), "document").otherwise("other")
    )
    key = F.coalesce(F.col("a.sha1"), F.concat(F.lower(name), F.lit("|"), F.coalesce(F.col("a.size").cast("string"), F.lit(""))))
    return rows.select("idx", "path", "mtime", "subject", "position", name.alias("file_name"), kind.alias("kind"), key.alias("key"), F.col("a.sha1").alias("sha1"))


def collected_documents(emails: DataFrame, doctexts: DataFrame) -> DataFrame:
    """``key, number, file_name, first_idx, appearances`` of each document that was attached and could be read, in order of first appearance."""
    seen = attachments(emails).where("kind = 'document' and sha1 is not null")
    at = F.struct("mtime", "path", "position")
    first = seen.groupBy("key").agg(F.min(at).alias("at"), F.min_by(F.struct("file_name", "idx"), at).alias("f"), F.count(F.lit(1)).alias("appearances"))
    read = doctexts.where("status = 'ok'").select(F.col("sha1").alias("key")).distinct()
    shown = first.join(read, "key", "left_semi").select("key", "f.file_name", F.col("f.idx").alias("first_idx"), "appearances", "at")
    out = numbered(shown, F.unix_date(F.col("at.mtime").cast("date")), [F.col("at"), F.col("key")])
    return out.select("key", "number", "file_name", "first_idx", "appearances")


def best_copies(emails: DataFrame) -> DataFrame:
    """``message_key, idx``: of each identified message the copy with an address, a date, most attachments and the longest body."""
    rank = F.struct(
        (F.coalesce("sender_email", F.lit("")) != "").cast("int").alias("a"), (F.coalesce("date_iso", F.lit("")) != "").cast("int").alias("d"),
        F.greatest(F.coalesce(F.size("attachments"), F.lit(0)), F.lit(0)).alias("n"), F.coalesce(F.length("body"), F.lit(0)).alias("l"), (-F.col("idx")).alias("i"),
    )
    rows = emails.select(identifier(F.col("message_id")).alias("message_key"), "idx", rank.alias("rank")).where("message_key is not null")
    return rows.groupBy("message_key").agg(F.max_by("idx", "rank").alias("idx"))


def near_copies(rows: DataFrame, seconds: int = 120) -> DataFrame:
    """``idx, slot``: within a key, a row joins the first slot whose own first row is at most ``seconds`` away and to the same people.

    ``rows``: ``key, idx, utc_s, people, message_key``. Slots keep the time and people of their first row, so the relation is neither symmetric
    nor transitive and is folded in order; a key is the sender, the beginning of the text and more, so its rows are copies. Only keys with
    several rows go to Python.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        slots: list[tuple] = []
        out = []
        for r in frame.sort_values(["utc_s", "idx"], na_position="last").itertuples():
            for slot, when, people, ids in slots:
                both_undated = pd.isna(when) and pd.isna(r.utc_s)
                near = both_undated or (not pd.isna(when) and not pd.isna(r.utc_s) and abs(r.utc_s - when) <= seconds)
                if near and (people == r.people or not people or not r.people) and not (ids and r.message_key and ids != r.message_key):
                    break
            else:
                slot = r.idx
                slots.append((slot, r.utc_s, r.people, r.message_key))
            out.append((r.idx, slot))
        return pd.DataFrame(out, columns=["idx", "slot"])

    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.join(sizes, "key")
    alone = sized.where("_n = 1").select("idx", F.col("idx").alias("slot"))
    return sized.where("_n > 1").drop("_n").groupBy("key").applyInPandas(fold, "idx long, slot long").unionByName(alone)


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, name: str, within: int, unlike: str | None = None) -> DataFrame:
    """For each row of ``left`` the row of ``right`` with the same key whose time is nearest, at most ``within`` seconds away.

    An equi-join on key and time bucket: a bucket is ``within`` long, so a match lies in the same or a neighbouring one. Ties go to the
    smaller ``name``. Rows without match stay, with NULLs. ``unlike``: a column in which a match must differ, for a table joined with
    itself; a row is no match of its own, and NULL differs from nothing.
    """
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    a = left.withColumn("_s", seconds(F.col(time))).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_s") / within) + k for k in (-1, 0, 1)])))
    b = right.select(F.col(key).alias("_k"), F.col(name).alias("near_id"), seconds(F.col(time)).alias("_t"), *([F.col(unlike).alias("_u")] if unlike else [])).withColumn("_rb", F.floor(F.col("_t") / within))
    pairs = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb")) & (F.abs(F.col("_s") - F.col("_t")) <= within))
    if unlike:
        pairs = pairs.where((F.col(unlike) != F.col("_u")) & (F.col(name) != F.col("near_id")))
    best = pairs.groupBy(F.col(name)).agg(F.min(F.struct(F.abs(F.col("_s") - F.col("_t")).alias("gap"), "near_id")).alias("m"))
    return left.join(best, name, "left").select(*left.columns, F.col("m.near_id").alias("near_id"), F.col("m.gap").alias("gap_s"))


def writer_offsets(emails: DataFrame) -> DataFrame:
    """``sender, month, hours``: the hours from UTC that a sender's dates name most often in a month; none where two are equal."""
    zone = F.regexp_extract("date_iso", r"^\d{4}-\d{2}-\d{2}[T ].*([+-]\d{2}):?\d{2}$", 1)
    rows = emails.where(zone != "").groupBy(F.lower("sender_email").alias("sender"), F.substring("date_iso", 1, 7).alias("month"), zone.cast("int").cast("long").alias("hours")).agg(F.count(F.lit(1)).alias("n"))
    top = rows.groupBy("sender", "month").agg(F.max("n").alias("most"))
    rows = rows.join(top, ["sender", "month"]).where("n = most")
    return rows.groupBy("sender", "month").agg(F.min("hours").alias("hours"), F.count(F.lit(1)).alias("tied")).where("tied = 1").select("sender", "month", "hours")


def people_seen(emails: DataFrame) -> DataFrame:
    """``email, display, n`` of every sender and recipient with an address."""
    people = F.concat(
        F.array(F.struct(F.col("sender_name").alias("display"), F.col("sender_email").alias("email"))),
        *[F.coalesce(F.col(c), F.array().cast("array<struct<display:string,email:string>>")) for c in ("to_list", "cc_list")],
    )
    rows = emails.select(F.explode(people).alias("p")).select(F.lower("p.email").alias("email"), F.coalesce("p.display", F.lit("")).alias("display"))
    return rows.where("email != ''").groupBy("email", "display").agg(F.count(F.lit(1)).alias("n"))


def best_names(seen: DataFrame) -> DataFrame:
    """``email, display, uses``: names with a blank first, then the most frequent, then the alphabetically first."""
    good = F.struct((~F.col("display").contains(" ")).cast("int").alias("a"), (-F.col("n")).alias("b"), F.col("display").alias("c"))
    named = seen.where("display != '' and not contains(display, '@')").groupBy("email").agg(F.min(good).alias("g"), F.sum("n").alias("uses"))
    return named.select("email", F.col("g.c").alias("display"), "uses")


GENERIC = "com|org|net|gov|edu|co|ac|example|info|biz|int|mil"


def organisation(domain: Column) -> Column:
    """The label of a domain that names the organisation: country and generic labels are dropped from the right."""
    bare = F.regexp_replace(F.lower(domain), rf"(?:\.(?:{GENERIC}))?(?:\.[a-z]{{2}})?$", "")
    return F.regexp_extract(bare, r"([^.]+)$", 1)


def meeting_label(start_iso: Column, end_iso: Column, place: Column, item_class: Column) -> Column:
    """``meeting 25-03-13 14:00-15:00 @ place``, as written in the record; all-day ones and those over several days as such; NULL without a start."""
    wall = lambda c: F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), F.regexp_replace(F.substring(c, 1, 16), "T", " ").try_cast("timestamp_ntz"))
    start, end = wall(start_iso), wall(end_iso)
    day, minute = lambda c: F.date_format(c, "yy-MM-dd"), lambda c: F.date_format(c, "HH:mm")
    midnight = (minute(start) == "00:00") & (minute(end) == "00:00")
    last = end - F.expr("interval 1 day")
    when = (
        F.when(end.isNull() | (end <= start), F.concat(day(start), F.lit(" "), minute(start)))
        .when(midnight, F.concat(day(start), F.when(day(last) == day(start), "").otherwise(F.concat(F.lit(" to "), day(last))), F.lit(" all day")))
        .when(day(end) == day(start), F.concat(day(start), F.lit(" "), minute(start), F.lit("-"), minute(end)))
        .otherwise(F.concat(day(start), F.lit(" "), minute(start), F.lit(" to "), day(end), F.lit(" "), minute(end)))
    )
    at = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(place, F.lit("")), r"\s+", " ")), r"^[ ;,]+|[ ;,]+$", "")
    at = F.when(F.length(at) > 80, F.concat(F.rtrim(F.substring(at, 1, 79)), F.lit("…"))).otherwise(at)
    cancelled = F.coalesce(F.lower(item_class).contains("canceled"), F.lit(False))
    return F.concat(F.when(cancelled, "meeting cancelled ").otherwise("meeting "), when, F.when(at == "", "").otherwise(F.concat(F.lit(" @ "), at)))


def copies_merged(emails: DataFrame) -> DataFrame:
    """``message_key, idx, copies, paths``: of each message with further copies the best one, how many there are, and where the others were filed."""
    keyed = emails.select(identifier(F.col("message_id")).alias("message_key"), "idx", "path").where("message_key is not null")
    best = best_copies(emails).withColumnRenamed("idx", "best")
    rows = keyed.join(best, "message_key")
    found = rows.groupBy("message_key", "best").agg(F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_set(F.when(F.col("idx") != F.col("best"), F.col("path")))).alias("paths"))
    return found.where("copies > 1").select("message_key", F.col("best").alias("idx"), "copies", F.array_join("paths", "; ").alias("paths"))
