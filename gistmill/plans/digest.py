"""The digest of a mailbox: its conversations as readable text, in parts of a bounded size, each with its own header and legend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators import documents as D
from gistmill.operators import mail as M
from gistmill.operators import people as P
from gistmill.operators import threads as T
from gistmill.plans.packing import packed

DAY = 86_400
#: Characters of an entry's text, and of a part.
ENTRY, PART = 1500, 200_000
MARKERS = {"[again]": "[again]: the same text as one of the sender's last ten in the thread", "(as above)": "(as above): a file of this name is listed earlier in the conversation", "[D": "[D1]: number of the document in the documents digest", "<link>": "<link>: a link was here"}


def rank_in(rows: DataFrame, group: list[str], seconds: str, tie: str, out: str) -> DataFrame:
    """``rows`` with their place from 0 inside a group, by ``seconds`` (NULL last) and ``tie``: counts per day first, so that no task sorts a whole group."""
    rows = rows.withColumn("_day", F.coalesce(F.floor(F.col(seconds) / DAY), F.lit(1 << 40)))
    sizes = rows.groupBy(*group, "_day").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_day")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*group, "_day").orderBy(F.col(seconds).asc_nulls_last(), tie))
    return rows.join(sizes, [*group, "_day"]).withColumn(out, F.col("_before") + within - 1).withColumn("_first_of_day", within == 1).drop("_before")


def attachment_lines(messages: DataFrame, doctexts: DataFrame) -> DataFrame:
    """``idx, files``: what is attached, in one line; documents with their number, further ones of a name in the thread as ``(as above)`` unless the text says revised, photos counted."""
    rows = M.attachments(messages.select("idx", "path", "mtime", "subject", "attachments"))
    rows = rows.where("kind != 'inline'").join(messages.select("idx", "thread", "utc_s", F.col("text").alias("said")), "idx")
    known = M.collected_documents(messages, doctexts).select("key", "number")
    rows = rows.join(known, "key", "left")
    order = Window.partitionBy("thread", F.lower("file_name")).orderBy(F.col("utc_s").asc_nulls_last(), "idx", "position")
    above = (F.col("kind") == "document") & (F.row_number().over(order) > 1) & ~F.coalesce(F.col("said").rlike(r"(?i)\b(?:revised|updated|amended|new revision)\b"), F.lit(False))
    name = F.concat(F.col("file_name"), F.when(F.col("number").isNotNull(), F.concat(F.lit(" [D"), F.col("number").cast("string"), F.lit("]"))).otherwise(""), F.when(above, " (as above)").otherwise(""))
    rows = rows.withColumn("shown", name)
    listed = F.array_sort(F.collect_list(F.when(F.col("kind") != "photo", F.struct("position", F.col("shown").alias("name")))))
    photos = F.count_if(F.col("kind") == "photo")
    line = F.concat_ws("; ", F.transform(listed, lambda x: x["name"]), F.when(photos > 0, F.concat(photos.cast("string"), F.when(photos > 1, " photos").otherwise(" photo"))))
    return rows.groupBy("idx").agg(line.alias("files"))


def entries(emails: DataFrame, mailboxes: DataFrame, doctexts: DataFrame) -> DataFrame:
    """``project, thread, first_s, entry_no, idx, utc_s, email, display, organisation, subject, line``: each message as its line of the digest.

    A conversation is ``thread``: the subject's key and the number of its part. The date stands where it changes. What nobody filed but
    somebody quotes comes as an entry of its own. Noise and pure acknowledgements are left out.
    """
    from gistmill.sources.tables import staged

    messages = staged(T.prepared(emails, mailboxes), "digest-messages")
    quotes = staged(T.quotes_of(messages, mailboxes), "digest-quotes")
    found = staged(T.matched(quotes, T.mail_index(messages)), "digest-matches")
    parts = staged(T.conversation_parts(messages, quotes, found), "digest-conversations")
    # documents are numbered by when they were sent
    sent = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("utc_s").cast("decimal(18,6)"))
    messages = messages.withColumn("mtime", F.coalesce(sent, "mtime"))
    noise = M.noise_kind(*[F.col(c) for c in ("item_class", "auto_reply", "subject", "sender_email")])
    kept = messages.where(noise.isNull() & ~F.col("is_ack"))
    capped = D.capped(kept, "idx", "text", ENTRY)
    shown = kept.select("idx", "mailbox", "utc_s", F.lower(F.coalesce("sender_email", F.lit(""))).alias("email"), P.tidy_name(F.col("sender_name"), F.col("sender_email")).alias("display"), "subject")
    shown = shown.join(capped, "idx").join(parts, "idx").join(attachment_lines(messages, doctexts), "idx", "left")
    # the sender's last ten texts in the thread are not repeated
    last = F.collect_list(F.xxhash64("capped")).over(Window.partitionBy("thread", "email").orderBy(F.col("utc_s").asc_nulls_last(), "idx").rowsBetween(-10, -1))
    again = (F.length("capped") >= 30) & F.array_contains(last, F.xxhash64("capped"))
    shown = shown.withColumn("said", F.when(again, "[again]").otherwise(F.coalesce("capped", F.lit(""))))
    lost = T.recovered(quotes, found, T.writer_hours(quotes, found)).withColumnRenamed("text", "said")
    # of a quote that nobody filed, the conversation of the message that holds it
    lost = lost.drop("thread").join(parts, "idx").join(messages.select("idx", "mailbox", "subject"), "idx")
    lost = lost.select("idx", "mailbox", "utc_s", F.lower(F.coalesce("sender_email", F.lit(""))).alias("email"), P.tidy_name(F.col("sender_name"), F.col("sender_email")).alias("display"), "subject", "thread", "part_no", F.concat(F.lit("(quoted) "), F.substring(F.regexp_replace("said", r"\s+", " "), 1, ENTRY)).alias("said"), F.lit(None).cast("string").alias("files"))
    rows = shown.select(*lost.columns).unionByName(lost).where("said != '' or files is not null")
    rows = rows.select(F.col("mailbox").alias("project"), F.concat_ws("#", "thread", "part_no").alias("thread"), "idx", "utc_s", "email", "display", F.regexp_extract("email", r"@([^.@]+)", 1).alias("organisation"), "subject", "said", "files")
    firsts = rows.groupBy("project", "thread").agg(F.coalesce(F.min("utc_s"), F.lit(1 << 40)).alias("first_s"))
    rows = rank_in(rows, ["project", "thread"], "utc_s", "idx", "entry_no").join(firsts, ["project", "thread"])
    date = F.when(F.col("_first_of_day") & F.col("utc_s").isNotNull(), F.concat(F.date_format(F.timestamp_seconds("utc_s"), "yy-MM-dd"), F.lit(" "))).otherwise("")
    line = F.concat(date, F.when(F.col("display") == "", "unknown").otherwise(F.col("display")), F.lit(": "), F.col("said"), F.when(F.coalesce("files", F.lit("")) == "", "").otherwise(F.concat(F.lit(" {"), F.col("files"), F.lit("}"))))
    return staged(rows.select("project", "thread", "first_s", "entry_no", "idx", "utc_s", "email", "display", "organisation", "subject", line.alias("line")), "digest-entries")


def _span(low: Column, high: Column) -> Column:
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yy-MM-dd")
    return F.when(low.isNull(), "undated").when(day(low) == day(high), day(low)).otherwise(F.concat(day(low), F.lit(" to "), day(high)))


def digest_text(rows: DataFrame, limit: int = PART) -> DataFrame:
    """``project, part, parts, text`` of :func:`entries`: header, legend of the people of the part, explanations of the marks in it, conversations.

    A part's text is bounded by ``limit`` (and one entry), and so is what a task concatenates.
    """
    from gistmill.sources.tables import staged

    rows = rows.withColumn("size", F.length("line") + 1)
    placed = staged(rows.join(packed(rows, limit), ["project", "thread", "entry_no"]), "digest-parts")
    heads = placed.groupBy("project", "thread").agg(F.min_by("subject", "entry_no").alias("title"), F.count(F.lit(1)).alias("n"), F.min("utc_s").alias("low"), F.max("utc_s").alias("high"), F.min("part").alias("opens"))
    title = F.concat(F.lit("## "), F.coalesce("title", F.lit("(no subject)")), F.when(F.col("part") > F.col("opens"), " (continued)").otherwise(""), F.lit(" - "), F.col("n").cast("string"), F.when(F.col("n") > 1, " emails, ").otherwise(" email, "), _span(F.col("low"), F.col("high")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "line"))), lambda e: e["line"]), "\n")
    blocks = placed.groupBy("project", "part", "thread", "first_s").agg(lines.alias("lines"), F.count(F.lit(1)).alias("of_part"), F.min("utc_s").alias("from_s"), F.max("utc_s").alias("to_s"))
    blocks = blocks.join(heads, ["project", "thread"]).select("project", "part", "first_s", "thread", "of_part", "from_s", "to_s", F.concat(title, F.lit("\n"), F.col("lines")).alias("block"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_s", "thread", "block"))), lambda b: b["block"]), "\n\n")
    body = blocks.groupBy("project", "part").agg(whole.alias("body"), F.count(F.lit(1)).alias("threads"), F.sum("of_part").alias("emails"), F.min("from_s").alias("low"), F.max("to_s").alias("high"))
    body = body.withColumn("parts", F.max("part").over(Window.partitionBy("project")))  # as many rows as a project has parts
    people = placed.where("display != ''").groupBy("project", "part", "organisation").agg(F.array_join(F.array_sort(F.collect_set("display")), ", ").alias("names"))
    legend = people.groupBy("project", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("organisation", "names"))), lambda p: F.concat(F.when(p["organisation"] == "", "others").otherwise(p["organisation"]), F.lit(": "), p["names"])), "\n").alias("legend"))
    marks = F.array_join(F.filter(F.array(*[F.when(F.col("body").contains(mark), told) for mark, told in MARKERS.items()]), lambda m: m.isNotNull()), "\n")
    head = F.concat(F.lit("# "), F.col("project"), F.when(F.col("parts") > 1, F.concat(F.lit(" - part "), F.col("part").cast("string"), F.lit(" of "), F.col("parts").cast("string"))).otherwise(""), F.lit("\n"), F.col("emails").cast("string"), F.lit(" emails, "), F.col("threads").cast("string"), F.lit(" conversations, "), _span(F.col("low"), F.col("high")))
    rows = body.join(legend, ["project", "part"], "left").withColumn("marks", marks)
    return rows.select("project", "part", "parts", F.concat_ws("\n\n", head, F.nullif(F.coalesce("legend", F.lit("")), F.lit("")), F.nullif("marks", F.lit("")), "body").alias("text"))
