"""Queries of the operators on mail and documents, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import subjects
from gistmill.functions.facts import MASKED, fact_score, fact_score_sql
from gistmill.operators import cleaning as C
from gistmill.operators import documents as D
from gistmill.operators import mail as M
from gistmill.operators import people as P
from gistmill.operators import quotes as Q
from gistmill.operators import reports as R
from gistmill.operators import threads as T
from gistmill.operators.instants import with_instant
from gistmill.plans import digest as G
from gistmill.plans.packing import packed
from gistmill.sources.tables import spread, staged, table
from gistmill.streaming.streams import deduplicated_stream, session_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


ANY_PREFIX = "|".join(subjects._prefix(x) for x in ["|".join((subjects.REPLY, subjects.FORWARD, subjects.AUTOMATIC, subjects.SYSTEM))])
CLEAN = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{00A0}}\\x{{200B}}]+', ' ', 'g'))"
SUBJECT = CLEAN.format("subject")
BARE_ONLY = f"trim(regexp_replace({SUBJECT}, '^(?:\\s*(?:{subjects.TAG}|{ANY_PREFIX}))+\\s*', '', 'i'))"
BARE = f"CASE WHEN {BARE_ONLY} = '' THEN '(no subject)' ELSE {BARE_ONLY} END"
THREAD = f"lower({BARE})"
UNTAGGED = f"regexp_replace({SUBJECT}, '^(?:\\s*(?:{subjects.TAG}))+\\s*', '', 'i')"
OUTER = f"""CASE WHEN regexp_matches({UNTAGGED}, '^{subjects._prefix(subjects.AUTOMATIC)}', 'i') THEN 'automatic'
 WHEN regexp_matches({UNTAGGED}, '^{subjects._prefix(subjects.REPLY)}', 'i') THEN 'reply'
 WHEN regexp_matches({UNTAGGED}, '^{subjects._prefix(subjects.FORWARD)}', 'i') THEN 'forward' ELSE 'none' END"""
_sql = lambda pattern: pattern.replace("'", "''")
RE2 = lambda pattern: pattern.replace("(?i)", "")


@query(f"SELECT idx, {BARE} AS clean_subject, {THREAD} AS thread_key, {OUTER} AS outermost FROM emails")
def subject_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "emails")
    return rows.select("idx", subjects.bare(F.col("subject")).alias("clean_subject"), M.thread_key(F.col("subject")).alias("thread_key"), subjects.outermost(F.col("subject")).alias("outermost"))


ANY_CASE = lambda pattern: pattern.replace("(?i)", "")
NOISE = f"""CASE WHEN regexp_matches(coalesce(sender_email, ''), '^no-?reply@(?:email\\.)?teams\\.', 'i') AND regexp_matches(coalesce(subject, ''), '{ANY_CASE(C.CHAT_SUBJECT)}', 'i') THEN NULL
 WHEN coalesce(regexp_matches(item_class, '^IPM\\.Schedule\\.Meeting\\.Resp'), false) OR regexp_matches({UNTAGGED}, '{ANY_CASE(M.RESPONSE_SUBJECT)}', 'i') THEN 'meeting_response'
 WHEN coalesce(starts_with(item_class, 'REPORT'), false) OR regexp_matches({UNTAGGED}, '{ANY_CASE(M.RECEIPT_SUBJECT)}', 'i') THEN 'receipt'
 WHEN coalesce(auto_reply, false) OR ({OUTER}) = 'automatic' THEN 'auto_reply'
 WHEN regexp_matches(sender_email, '{RE2(M.NO_REPLY)}', 'i') THEN 'notification' END"""


@query(f"SELECT coalesce({NOISE}, 'kept') AS noise, count(*) AS messages FROM emails GROUP BY 1")
def noise_counts(spark, sf_dir):
    kind = M.noise_kind(*[F.col(c) for c in ("item_class", "auto_reply", "subject", "sender_email")])
    return table(spark, sf_dir, "emails").groupBy(F.coalesce(kind, F.lit("kept")).alias("noise")).agg(F.count(F.lit(1)).alias("messages"))


#: Mail with the time it was sent in place of the file's.
SENT = f"(SELECT * REPLACE (CASE WHEN regexp_matches(coalesce(date_iso, ''), '{M.ZONED}') AND TRY_CAST(substring(date_iso, 1, 4) AS INT) BETWEEN 1971 AND 2200 THEN coalesce(CAST(TRY_CAST(date_iso AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP), mtime) ELSE mtime END AS mtime) FROM emails) AS emails"


def _sent(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "emails").withColumn("mtime", M.sent_at(F.col("date_iso"), F.col("mtime")))


@query(f"""SELECT {THREAD} AS thread_key, count(*) AS messages, min(mtime) AS first_at, max(mtime) AS last_at,
 count(DISTINCT lower(sender_email)) AS senders FROM {SENT} GROUP BY 1""")
def thread_stats(spark, sf_dir):
    rows = _sent(spark, sf_dir).withColumn("thread_key", M.thread_key(F.col("subject")))
    return rows.groupBy("thread_key").agg(F.count(F.lit(1)).alias("messages"), F.min("mtime").alias("first_at"), F.max("mtime").alias("last_at"), F.countDistinct(F.lower("sender_email")).alias("senders"))


@query(f"""WITH t AS (SELECT idx, {THREAD} AS thread_key, CAST(floor(epoch(mtime)) AS BIGINT) AS s FROM {SENT}),
 g AS (SELECT *, CASE WHEN s - lag(s) OVER w > {M.GAP} THEN 1 ELSE 0 END AS starts FROM t WINDOW w AS (PARTITION BY thread_key ORDER BY s, idx))
 SELECT idx, thread_key, CAST(sum(starts) OVER (PARTITION BY thread_key ORDER BY s, idx) + 1 AS BIGINT) AS part_no FROM g""")
def thread_parts(spark, sf_dir):
    rows = _sent(spark, sf_dir).select("idx", M.thread_key(F.col("subject")).alias("thread_key"), F.unix_seconds(F.to_timestamp(F.col("mtime"))).alias("s"))
    return M.with_gaps(rows, "thread_key", "s", "idx").select("idx", "thread_key", "part_no")


@query("SELECT doc_id, source FROM documents WHERE created_at IS NULL OR created_at::DATE BETWEEN DATE '2021-01-01' AND DATE '2022-06-30'")
def dated_documents(spark, sf_dir):
    day = F.col("created_at").cast("date")
    rows = table(spark, sf_dir, "documents")
    return rows.where(F.col("created_at").isNull() | day.between("2021-01-01", "2022-06-30")).select("doc_id", "source")


PEOPLE = """people AS (SELECT lower(p.email) AS email, coalesce(p.display, '') AS display FROM (
 SELECT unnest(list_concat(list_concat([{'display': sender_name, 'email': sender_email}], coalesce(to_list, [])), coalesce(cc_list, []))) AS p FROM emails) WHERE p.email <> ''),
 seen AS (SELECT email, display, count(*) AS n FROM people GROUP BY 1, 2)"""


@query(f"WITH {PEOPLE} SELECT * FROM seen")
def people_observed(spark, sf_dir):
    return M.people_seen(table(spark, sf_dir, "emails"))


@query(f"""WITH {PEOPLE}, r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY CASE WHEN contains(display, ' ') THEN 0 ELSE 1 END, n DESC, display) AS k,
 sum(n) OVER (PARTITION BY email) AS uses FROM seen WHERE display <> '' AND NOT contains(display, '@'))
 SELECT email, display, CAST(uses AS BIGINT) AS uses FROM r WHERE k = 1""")
def people_names(spark, sf_dir):
    return M.best_names(M.people_seen(table(spark, sf_dir, "emails")))


ORG = f"regexp_extract(regexp_replace(lower({{0}}), '(?:\\.(?:{M.GENERIC}))?(?:\\.[a-z]{{{{2}}}})?$', ''), '([^.]+)$', 1)"


@query(f"""WITH g AS (SELECT {ORG.format('domain')} AS organisation, name_key, lower(email) AS email, count(*) AS n FROM person_obs
 WHERE contains(trim(display), ' ') AND email <> '' AND name_key <> '' GROUP BY 1, 2, 3)
 SELECT organisation, name_key, arg_max(email, (n, -length(email), email)) AS canonical, count(*) AS addresses FROM g GROUP BY 1, 2""")
def people_merged(spark, sf_dir):
    rows = table(spark, sf_dir, "person_obs").where("contains(trim(display), ' ') and email != '' and name_key != ''")
    rows = rows.groupBy(M.organisation(F.col("domain")).alias("organisation"), "name_key", F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("email", F.struct(F.col("n"), (-F.length("email")).alias("l"), F.col("email").alias("e")))
    return rows.groupBy("organisation", "name_key").agg(best.alias("canonical"), F.count(F.lit(1)).alias("addresses"))


@query("""WITH d AS (SELECT regexp_extract(lower(trim(split_part(display, ' ', 1))), '^[a-z]+$', 0) AS first_name, lower(email) AS email FROM person_obs WHERE contains(display, ' ') AND email <> '')
 SELECT first_name, min(email) AS email FROM d WHERE first_name <> '' GROUP BY 1 HAVING count(DISTINCT email) = 1""")
def first_names(spark, sf_dir):
    """First names that only one address has."""
    rows = table(spark, sf_dir, "person_obs").where("contains(display, ' ') and email != ''")
    rows = rows.select(F.regexp_extract(F.lower(F.trim(F.split("display", " ")[0])), "^[a-z]+$", 0).alias("first_name"), F.lower("email").alias("email")).where("first_name != ''")
    found = rows.groupBy("first_name").agg(F.min("email").alias("email"), F.max("email").alias("other"))
    return found.where("email = other").select("first_name", "email")


ATTACHED = f"""a AS (SELECT idx, path, mtime, subject, i - 1 AS position, attachments[i] AS t FROM {SENT}, unnest(range(1, len(attachments) + 1)) AS u(i)),
 att AS (SELECT idx, path, mtime, {THREAD} AS thread_key, CAST(position AS BIGINT) AS position, coalesce(t.file_name, '') AS file_name,
 CASE WHEN t.email IS NOT NULL THEN 'email' WHEN t.link THEN 'link' WHEN t.inline OR regexp_matches(coalesce(t.file_name, ''), '{RE2(M.INLINE)}', 'i') THEN 'inline'
 WHEN regexp_matches(coalesce(t.file_name, ''), '{RE2(M.PHOTO)}', 'i') THEN 'photo' WHEN regexp_matches(coalesce(t.file_name, ''), '{RE2(M.DOCUMENT)}', 'i') THEN 'document' ELSE 'other' END AS kind,
 t.sha1 AS sha1, coalesce(t.sha1, lower(coalesce(t.file_name, '')) || '|' || coalesce(CAST(t.size AS VARCHAR), '')) AS key FROM a)"""


@query(f"WITH {ATTACHED} SELECT kind, count(*) AS attachments, count(DISTINCT key) AS contents FROM att GROUP BY 1")
def attachment_kinds(spark, sf_dir):
    rows = M.attachments(table(spark, sf_dir, "emails"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("attachments"), F.countDistinct("key").alias("contents"))


@query(f"""WITH {ATTACHED} SELECT idx, position, row_number() OVER (PARTITION BY thread_key, lower(file_name) ORDER BY mtime, idx, position) > 1 AS as_above
 FROM att WHERE kind = 'document'""")
def attachments_as_above(spark, sf_dir):
    """Whether a document of the same name was already attached earlier in the thread."""
    from pyspark.sql import Window

    rows = M.attachments(_sent(spark, sf_dir)).where("kind = 'document'")
    order = Window.partitionBy(M.thread_key(F.col("subject")), F.lower("file_name")).orderBy("mtime", "idx", "position")
    return rows.select("idx", F.col("position").cast("long").alias("position"), (F.row_number().over(order) > 1).alias("as_above"))


DOCS = f"""{ATTACHED}, shown AS (SELECT key, arg_min(file_name, (mtime, path, position)) AS file_name, arg_min(idx, (mtime, path, position)) AS first_idx, min((mtime, path, position)) AS seen_at, count(*) AS appearances
 FROM att WHERE kind = 'document' AND sha1 IS NOT NULL AND sha1 IN (SELECT sha1 FROM doctexts WHERE status = 'ok') GROUP BY key),
 docs AS (SELECT key, row_number() OVER (ORDER BY seen_at, key) AS number, file_name, first_idx, appearances FROM shown)"""


@query(f"WITH {DOCS} SELECT * FROM docs")
def documents_numbered(spark, sf_dir):
    return M.collected_documents(_sent(spark, sf_dir), table(spark, sf_dir, "doctexts"))


@query(f"WITH {DOCS} SELECT att.idx, att.position, docs.number FROM att JOIN docs USING (key)")
def attachment_documents(spark, sf_dir):
    emails, texts = _sent(spark, sf_dir), table(spark, sf_dir, "doctexts")
    return M.attachments(emails).join(M.collected_documents(emails, texts).select("key", "number"), "key").select("idx", F.col("position").cast("long").alias("position"), "number")


MID = """lower(regexp_replace(CASE WHEN regexp_extract(trim(coalesce(message_id, ''), E' \\t\\r\\n'), '<\\s*([^<>]*?)\\s*>[^<>]*$', 1) <> ''
 THEN regexp_extract(trim(coalesce(message_id, ''), E' \\t\\r\\n'), '<\\s*([^<>]*?)\\s*>[^<>]*$', 1) ELSE trim(coalesce(message_id, ''), E' \\t\\r\\n') END, '[\\s<>]+', '', 'g'))"""


@query(f"""WITH k AS (SELECT {MID} AS message_key, idx, CAST(coalesce(sender_email, '') <> '' AS INT) AS a, CAST(coalesce(date_iso, '') <> '' AS INT) AS d, coalesce(len(attachments), 0) AS n, coalesce(length(body), 0) AS l FROM emails)
 SELECT message_key, arg_max(idx, (a, d, n, l, -idx)) AS idx FROM k WHERE regexp_full_match(message_key, '[^@]+@[^@]+') AND NOT regexp_matches(message_key, '@(.*\\.)?(invalid|localhost)$') GROUP BY 1""")
def best_copy(spark, sf_dir):
    return M.best_copies(table(spark, sf_dir, "emails"))


@query()
def near_copies(spark, sf_dir):
    """Slots of copies with the same sender, beginning, thread and attachments, at most two minutes apart."""
    rows = with_instant(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes"))
    rows = rows.join(C.bodies_cleaned(rows), "idx")
    first = Q.quoted(rows.select("idx", "body")).where("depth = 0").select("idx", F.concat_ws("|", "date_iso", F.lower("sender_email")).alias("quote"))
    rows = rows.join(first, "idx", "left")
    people = F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat("to_list", F.coalesce("cc_list", F.array().cast("array<struct<display:string,email:string>>"))), lambda p: F.lower(p["email"])))), ",")
    names = F.array_join(F.array_sort(F.transform(F.filter("attachments", lambda a: ~a["inline"]), lambda a: F.lower(a["file_name"]))), ",")
    start = F.substring(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "), 1, 200)
    key = F.sha2(F.concat_ws("\u0001", F.lower("sender_email"), start, names, M.thread_key(F.col("subject")), F.coalesce("meeting.start_iso", F.lit("")), F.coalesce("quote", F.lit("")), F.when(start == "", F.col("idx").cast("string"))), 256)
    from gistmill.operators.delivery import identifier

    return M.near_copies(rows.select(key.alias("key"), "idx", "utc_s", people.alias("people"), identifier(F.col("message_id")).alias("message_key")))


@query("""WITH r AS (SELECT lower(sender_email) AS sender, substring(date_iso, 1, 7) AS month, CAST(regexp_extract(date_iso, '^\\d{4}-\\d{2}-\\d{2}[T ].*([+-]\\d{2}):?\\d{2}$', 1) AS BIGINT) AS hours, count(*) AS n
 FROM emails WHERE regexp_extract(date_iso, '^\\d{4}-\\d{2}-\\d{2}[T ].*([+-]\\d{2}):?\\d{2}$', 1) <> '' GROUP BY 1, 2, 3),
 k AS (SELECT *, max(n) OVER (PARTITION BY sender, month) AS most FROM r)
 SELECT sender, month, min(hours) AS hours FROM k WHERE n = most GROUP BY 1, 2 HAVING count(*) = 1""")
def writer_zones(spark, sf_dir):
    return M.writer_offsets(table(spark, sf_dir, "emails"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
 p AS (SELECT a.event_id, b.event_id AS near_id, abs(a.s - b.s) AS gap_s, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.event_id) AS k
 FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.event_id <> b.event_id AND abs(a.s - b.s) <= 86400)
 SELECT a.event_id, a.user_id, p.near_id, p.gap_s FROM e a LEFT JOIN p ON a.event_id = p.event_id AND k = 1""")
def nearest_events(spark, sf_dir):
    """Nearest-time join: for each event the nearest event of another type of the same user, at most a day away."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return M.nearest(events, events, "user_id", "ts", "event_id", 86_400, "event_type").select("event_id", "user_id", "near_id", "gap_s")


@query()
def attached_recovered(spark, sf_dir):
    """Attached messages that were not filed themselves: an anti-join on sender, topic and time bucket."""
    emails, boxes = table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes")
    inner = emails.select("idx", "mailbox", F.posexplode("attachments").alias("position", "a")).where("a.email is not null")
    inner = inner.select("idx", "mailbox", "position", F.lower("a.email.sender_email").alias("sender"), M.thread_key(F.col("a.email.subject")).alias("thread_key"), F.col("a.email.date_iso").alias("date_iso"))
    inner = with_instant(inner, boxes).withColumn("bucket", F.floor(F.col("utc_s") / 120))
    filed = with_instant(emails.select("mailbox", "date_iso", "sender_email", "subject"), boxes).where("utc_s is not null")
    filed = filed.select(F.lower("sender_email").alias("f_sender"), M.thread_key(F.col("subject")).alias("f_thread"), F.col("utc_s").alias("f_s"), F.explode(F.array(*[F.floor(F.col("utc_s") / 120) + k for k in (-1, 0, 1)])).alias("f_bucket"))
    same = (F.col("sender") == F.col("f_sender")) & (F.col("thread_key") == F.col("f_thread")) & (F.col("bucket") == F.col("f_bucket")) & (F.abs(F.col("utc_s") - F.col("f_s")) <= 120)
    return inner.join(filed, same, "left_anti").select("idx", F.col("position").cast("long").alias("position"), "sender", "thread_key")


@query()
def quoted_messages(spark, sf_dir):
    """Quoted messages inside bodies, newest first."""
    return Q.quoted(table(spark, sf_dir, "emails")).select("idx", "depth", "sender_name", "sender_email", "date_iso", "subject")


@query()
def quoted_never_filed(spark, sf_dir):
    """Quoted messages that no row of the table is."""
    return Q.never_filed(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes"))


KEYWORDS = r"\b(?:RFI|NCR)[ -]?0*1\d{2,}\b|crane booking"


@query(f"""WITH t AS (SELECT idx, {THREAD} AS thread_key, regexp_matches(coalesce(subject, '') || ' ' || coalesce(body, ''), '{KEYWORDS}', 'i') AS hit FROM emails),
 h AS (SELECT DISTINCT thread_key FROM t WHERE hit) SELECT idx, thread_key FROM t WHERE thread_key IN (SELECT thread_key FROM h)""")
def focus_threads(spark, sf_dir):
    """All messages of the threads in which any message has a keyword: a semi-join, so that hot threads need no window."""
    rows = table(spark, sf_dir, "emails").select("idx", M.thread_key(F.col("subject")).alias("thread_key"), F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))).rlike(f"(?i){KEYWORDS}").alias("hit"))
    return rows.join(rows.where("hit").select("thread_key").distinct(), "thread_key", "left_semi").select("idx", "thread_key")


@query(f"""SELECT idx, CAST(count(*) OVER (PARTITION BY {THREAD}, lower(sender_email) ORDER BY mtime, idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS BIGINT) AS seen FROM {SENT}""")
def seen_window(spark, sf_dir):
    """How many of its sender's last ten messages a message has before it in its thread."""
    from pyspark.sql import Window

    order = Window.partitionBy(M.thread_key(F.col("subject")), F.lower("sender_email")).orderBy("mtime", "idx").rowsBetween(-10, -1)
    return _sent(spark, sf_dir).select("idx", F.count(F.lit(1)).over(order).alias("seen"))


ACK_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(C.ACK_WORDS)) + "]"
CORE_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(C.ACK_CORE)) + "]"
#: RE2 has no look-ahead; words that excuse a decision word are taken away first.
EXCUSED = r"\\bno\\s+(?:worries|worry|problems?|probs|dramas?|stress)\\b|\\bok\\s*[.,]?\\s*noted"
DECIDES = re.sub(r"\(\?![^()]*(?:\([^()]*\)[^()]*)*\)", "", C.DECISION.replace("(?i)", ""))


@query(f"""WITH t AS (SELECT idx, trim(coalesce(body, '')) AS t FROM emails), w AS (SELECT idx, t, regexp_extract_all(t, '[A-Za-z][A-Za-z'']*') AS w FROM t),
 u AS (SELECT *, list_filter(w, lambda x: NOT list_contains({ACK_LIST}, lower(x))) AS u FROM w)
 SELECT idx, t <> '' AND length(t) <= 90 AND NOT regexp_matches(t, '[?\\d]') AND NOT regexp_matches(regexp_replace(t, '{EXCUSED}', '', 'gi'), '{DECIDES}', 'i')
 AND len(w) BETWEEN 1 AND 12 AND len(list_filter(w, lambda x: list_contains({CORE_LIST}, lower(x)))) > 0 AND len(u) <= 2 AND len(list_filter(u, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 AS ack FROM u""")
def acknowledgements(spark, sf_dir):
    return table(spark, sf_dir, "emails").select("idx", C.ack(F.col("body")).alias("ack"))


WALL = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}') THEN TRY_CAST(replace(substring({0}, 1, 16), 'T', ' ') || ':00' AS TIMESTAMP) END"
DAY, MINUTE = "strftime({0}, '%y-%m-%d')", "strftime({0}, '%H:%M')"


@query(f"""WITH m AS (SELECT idx, {WALL.format('meeting.start_iso')} AS s, {WALL.format('meeting.end_iso')} AS e, lower(coalesce(item_class, '')) LIKE '%canceled%' AS c,
 regexp_replace(trim(regexp_replace(coalesce(meeting.place, ''), '\\s+', ' ', 'g')), '^[ ;,]+|[ ;,]+$', '', 'g') AS p FROM emails WHERE meeting IS NOT NULL),
 w AS (SELECT *, CASE WHEN e IS NULL OR e <= s THEN {DAY.format('s')} || ' ' || {MINUTE.format('s')}
 WHEN {MINUTE.format('s')} = '00:00' AND {MINUTE.format('e')} = '00:00' THEN {DAY.format('s')} || CASE WHEN (e - INTERVAL 1 DAY)::DATE = s::DATE THEN '' ELSE ' to ' || {DAY.format('e - INTERVAL 1 DAY')} END || ' all day'
 WHEN e::DATE = s::DATE THEN {DAY.format('s')} || ' ' || {MINUTE.format('s')} || '-' || {MINUTE.format('e')}
 ELSE {DAY.format('s')} || ' ' || {MINUTE.format('s')} || ' to ' || {DAY.format('e')} || ' ' || {MINUTE.format('e')} END AS w, CASE WHEN length(p) > 80 THEN rtrim(substring(p, 1, 79)) || '…' ELSE p END AS q FROM m)
 SELECT idx, CASE WHEN c THEN 'meeting cancelled ' ELSE 'meeting ' END || w || CASE WHEN q = '' THEN '' ELSE ' @ ' || q END AS label FROM w""")
def meeting_labels(spark, sf_dir):
    label = M.meeting_label(F.col("meeting.start_iso"), F.col("meeting.end_iso"), F.col("meeting.place"), F.col("item_class"))
    return table(spark, sf_dir, "emails").where("meeting is not null").select("idx", label.alias("label"))


@query(f"""WITH k AS (SELECT {MID} AS message_key, idx, path, CAST(coalesce(sender_email, '') <> '' AS INT) AS a, CAST(coalesce(date_iso, '') <> '' AS INT) AS d, coalesce(len(attachments), 0) AS n, coalesce(length(body), 0) AS l FROM emails),
 u AS (SELECT * FROM k WHERE regexp_full_match(message_key, '[^@]+@[^@]+') AND NOT regexp_matches(message_key, '@(.*\\.)?(invalid|localhost)$')),
 b AS (SELECT message_key, arg_max(idx, (a, d, n, l, -idx)) AS best, count(*) AS copies FROM u GROUP BY 1)
 SELECT message_key, best AS idx, copies, coalesce(string_agg(path, '; ' ORDER BY path) FILTER (WHERE idx <> best), '') AS paths FROM u JOIN b USING (message_key) WHERE copies > 1 GROUP BY 1, 2, 3""")
def copies_merged(spark, sf_dir):
    """Where the further copies of a message were filed."""
    return M.copies_merged(table(spark, sf_dir, "emails"))


@query(f"SELECT doc_id, {fact_score_sql('text')} AS score FROM documents")
def document_facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fact_score(F.col("text")).alias("score"))


BLOCKS = """b AS (SELECT doc_no, CAST(i - 1 AS BIGINT) AS block_no, blocks[i].block_type AS block_type, coalesce(blocks[i].text, '') AS text, blocks[i].block_level AS level
 FROM doctexts, unnest(range(1, len(blocks) + 1)) AS u(i) WHERE status = 'ok')"""
KEY = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')"
SHAPE = "regexp_replace(lower(text), '[0-9]+', '#', 'g')"


def _blocks(spark, sf_dir) -> DataFrame:
    return D.blocks(table(spark, sf_dir, "doctexts"))


@query(f"""WITH {BLOCKS} SELECT doc_no, block_no, count(CASE WHEN block_type = 'heading' THEN 1 END) OVER w AS section,
 last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER w AS heading FROM b
 WINDOW w AS (PARTITION BY doc_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def block_sections(spark, sf_dir):
    return D.sections(_blocks(spark, sf_dir)).select("doc_no", "block_no", "section", "heading")


TABLES = f"""{BLOCKS}, s AS (SELECT *, CASE WHEN block_type = 'row' AND coalesce(lag(block_type) OVER (PARTITION BY doc_no ORDER BY block_no), '') <> 'row' THEN 1 ELSE 0 END AS starts FROM b),
 n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_no ORDER BY block_no) AS BIGINT) AS table_no FROM s),
 t AS (SELECT *, row_number() OVER (PARTITION BY doc_no, table_no ORDER BY block_no) AS row_no FROM n WHERE block_type = 'row')"""


@query(f"""WITH {TABLES} SELECT doc_no, table_no, block_no, row_no, row_no = 1 OR row_no <= 3 AND coalesce(min(CASE WHEN contains(text, ' | ') THEN 0 ELSE 1 END)
 OVER (PARTITION BY doc_no, table_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS is_header FROM t""")
def table_rows(spark, sf_dir):
    return D.tables(_blocks(spark, sf_dir)).select("doc_no", "table_no", "block_no", "row_no", "is_header")


@query(f"""WITH {TABLES}, c AS (SELECT doc_no, table_no, block_no, k, trim(string_split(text, ' | ')[k]) AS cell FROM t, unnest(range(1, len(string_split(text, ' | ')) + 1)) AS u(k)),
 v AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_no, table_no, k, lower(cell)) AS share FROM c WHERE cell <> '')
 SELECT doc_no, block_no, round(sum(share), 6) AS rarity FROM v GROUP BY 1, 2""")
def table_row_rarity(spark, sf_dir):
    return D.row_rarity(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, k AS (SELECT doc_no, block_no, {KEY} AS key FROM b WHERE length({KEY}) >= 30)
 SELECT doc_no, block_no, row_number() OVER (PARTITION BY doc_no, key ORDER BY block_no) AS nth, min(doc_no) OVER (PARTITION BY key) AS first_doc FROM k""")
def block_repeats(spark, sf_dir):
    return D.repeats(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, s AS (SELECT doc_no, block_no, {fact_score_sql('text')} AS raw, count(*) OVER (PARTITION BY doc_no, {SHAPE}) AS n FROM b)
 SELECT doc_no, block_no, round(CASE WHEN n > 6 THEN raw * 6.0::DOUBLE / n ELSE raw::DOUBLE END, 6) AS score FROM s""")
def block_scores(spark, sf_dir):
    return D.damped_scores(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS} SELECT doc_no, {SHAPE} AS shape, count(*) AS headings, min(block_no) AS first_block FROM b WHERE block_type = 'heading' GROUP BY 1, 2 HAVING count(*) >= 3""")
def headings_folded(spark, sf_dir):
    return D.folded_headings(_blocks(spark, sf_dir), 3)


def _is(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '{_sql(ANY_CASE(pattern))}'{', {}'.format(chr(39) + 'i' + chr(39)) if pattern.startswith('(?i)') else ''})"


COUNT = lambda patterns: " + ".join(f"CAST({_is(p)} AS INT)" for p in patterns)


@query(f"""WITH {BLOCKS}, s AS (SELECT *, coalesce(last_value(CASE WHEN block_type = 'heading' THEN {_is(D.BOILER_HEAD)} END IGNORE NULLS) OVER (PARTITION BY doc_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_section,
 block_no < 12 OR block_no > max(block_no) OVER (PARTITION BY doc_no) - 6 AS near FROM b),
 c AS (SELECT *, regexp_matches(regexp_replace(text, '{MASKED}', '~', 'g'), '{_sql(D.HARD)}') AS hard, {_is(D.PARTY)} AND {_is(D.DUTY)} AND NOT {_is(D.ABOUT)} AS clause, {COUNT(D.STRONG)} AS strong, {COUNT(D.WEAK)} AS weak,
 len(regexp_extract_all(text, '{_sql(D.CONTACT)}')) AS contact FROM s)
 SELECT doc_no, count(CASE WHEN block_type IN ('para', 'item', 'text') AND (in_section AND NOT hard OR NOT clause AND (strong + weak >= 3 OR strong > 0 AND strong + weak >= 2 AND NOT hard OR strong > 0 AND near AND NOT hard AND length(text) < 600
 OR contact >= 2 AND length(text) < 300 OR contact > 0 AND length(text) < 120 AND NOT hard)) THEN 1 END) AS boilerplate, count(*) AS all_blocks FROM c GROUP BY 1""")
def boilerplate_blocks(spark, sf_dir):
    rows = D.boilerplate(_blocks(spark, sf_dir))
    return rows.groupBy("doc_no").agg(F.count_if("is_boilerplate").alias("boilerplate"), F.count(F.lit(1)).alias("all_blocks"))


@query(f"""WITH {BLOCKS}, m AS (SELECT doc_no, md5(string_agg(text, chr(10) ORDER BY block_no)) AS mark FROM b GROUP BY 1), f AS (SELECT mark, min(doc_no) AS same_as FROM m GROUP BY 1)
 SELECT doc_no, same_as FROM m JOIN f USING (mark) WHERE doc_no <> same_as""")
def documents_same(spark, sf_dir):
    return D.same_texts(_blocks(spark, sf_dir))


FAMILY = "regexp_replace(lower(coalesce(file_name, '')), '\\.[a-z0-9]{1,5}$', '')"
for _p in ("^(?:copy of|kopie von|copie de) ", "[ _-]*(?:rev|v|version)[ ._-]?[a-z0-9]{1,3}$", "[ _-]*\\(?(?:draft|final|signed|entwurf|copy)\\)?$", "\\d{4}-\\d{2}-\\d{2}|\\d{8}", "[^\\p{L}\\p{N}]+"):
    FAMILY = f"regexp_replace({FAMILY}, '{_p}', '', 'g')"
MARK = "upper(regexp_extract(coalesce(file_name, ''), '(?i)(?:rev|version|v)[ ._-]?([a-z]{1,2}\\d{0,2}|\\d{1,3})(?:\\.[a-z0-9]+)?$', 1))"


@query(f"""WITH n AS (SELECT doc_no, kind, {FAMILY} AS family, {MARK} AS mark, added_at FROM doctexts WHERE status = 'ok'),
 r AS (SELECT *, CASE WHEN mark = '' THEN -1 WHEN starts_with(mark, 'P') THEN 0 WHEN regexp_matches(mark, '^[A-Z]') THEN 1 ELSE 2 END AS class, lpad(mark, 6, '0') AS m FROM n WHERE family <> '')
 SELECT doc_no, family, row_number() OVER w AS version_no, lag(doc_no) OVER w AS previous FROM r WINDOW w AS (PARTITION BY family, kind ORDER BY class, CASE WHEN mark = '' THEN '' ELSE m END, added_at, doc_no)""")
def document_versions(spark, sf_dir):
    return D.versions(table(spark, sf_dir, "doctexts"))


@query()
def version_changes(spark, sf_dir):
    """Sentence differences between neighbouring versions."""
    return D.version_changes(table(spark, sf_dir, "doctexts"))


@query()
def blocks_chosen(spark, sf_dir):
    """What each document shows within its budget."""
    return D.chosen_blocks(table(spark, sf_dir, "doctexts"))


@query()
def texts_capped(spark, sf_dir):
    """Texts within 1,500 characters: the opening, then the sentences with most facts."""
    return D.capped(table(spark, sf_dir, "documents"), "doc_id", "text", 1500)


@query()
def bodies_cleaned(spark, sf_dir):
    """What the sender of each mail wrote, as one line, and the history behind it."""
    return C.bodies_cleaned(spread(table(spark, sf_dir, "emails").select("idx", "body", "sender_name")))


def _messages(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, their quotes, which of them are filed)."""
    boxes = table(spark, sf_dir, "mailboxes")
    messages = staged(T.prepared(table(spark, sf_dir, "emails"), boxes), "query-messages")
    quotes = staged(T.quotes_of(messages, boxes), "query-quotes")
    return messages, quotes, staged(T.matched(quotes, T.mail_index(messages)), "query-matches")


@query()
def quotes_matched(spark, sf_dir):
    """The filed message that each quoted one is."""
    return _messages(spark, sf_dir)[2]


@query()
def quotes_recovered(spark, sf_dir):
    """Quoted messages that nobody filed, each once, dated by their writers' clocks."""
    _, quotes, found = _messages(spark, sf_dir)
    return T.recovered(quotes, found, T.writer_hours(quotes, found))


@query()
def writer_clocks(spark, sf_dir):
    """Hours by which a writer's quoted dates differ from the filed ones, by month."""
    _, quotes, found = _messages(spark, sf_dir)
    return T.writer_hours(quotes, found)


@query()
def conversations_split(spark, sf_dir):
    """The conversation of its thread that each message is in, by silences and by what messages quote."""
    messages, quotes, found = _messages(spark, sf_dir)
    return T.conversation_parts(messages, quotes, found)


@query()
def replies_inline(spark, sf_dir):
    """Answers between the lines of a quote."""
    messages, quotes, found = _messages(spark, sf_dir)
    return T.inline_replies(quotes, found, messages)


@query()
def identities_resolved(spark, sf_dir):
    """Which address a bare name means."""
    rows = table(spark, sf_dir, "person_obs").select(F.coalesce("display", F.lit("")).alias("display"), F.lower(F.coalesce("email", F.lit(""))).alias("email"), F.lit(1).alias("n"))
    return T.identities(rows)


def _entries(spark, sf_dir) -> DataFrame:
    return G.entries(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes"), table(spark, sf_dir, "doctexts"))


@query()
def digest_parts(spark, sf_dir):
    """Into which part of its mailbox's digest each entry goes, by the sizes of the rendered lines."""
    return packed(_entries(spark, sf_dir).withColumn("size", F.length("line") + 1))


@query()
def digest_text(spark, sf_dir):
    """The digests of all mailboxes, part by part."""
    return G.digest_text(_entries(spark, sf_dir))


@query("SELECT status, kind, count(*) AS documents, sum(chars) AS chars, count(CASE WHEN drawing THEN 1 END) AS drawings FROM doctexts GROUP BY 1, 2")
def document_counters(spark, sf_dir):
    return table(spark, sf_dir, "doctexts").groupBy("status", "kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"), F.count_if("drawing").alias("drawings"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
 n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS started, count(*) AS n_events FROM n GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """Sessions with a gap of six hours, from a stream with a watermark."""
    return session_stream(spark, f"{sf_dir}/events.parquet")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1, 2")
def events_once(spark, sf_dir):
    """Events counted once per user, type and time, from a stream that drops repeats within its watermark."""
    return deduplicated_stream(spark, f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


TIDY = """trim(regexp_replace(regexp_replace(coalesce(display, ''), '\\s*\\([^()]*\\)\\s*$', ''), '^[''\"]+|[''\"]+$', '', 'g'))"""
TIDY = f"regexp_replace(regexp_replace({TIDY}, '([a-z])([A-Z][a-z])', '\\1 \\2', 'g'), '^([^,@]+), *([^,@]+)$', '\\2 \\1')"


@query(f"SELECT obs_id, {TIDY} AS tidy FROM person_obs WHERE {TIDY} <> '' AND NOT contains({TIDY}, '@')")
def names_tidied(spark, sf_dir):
    rows = table(spark, sf_dir, "person_obs").select("obs_id", F.coalesce("display", F.lit("")).alias("display"), P.tidy_name(F.col("display"), F.lit("")).alias("tidy"))
    return rows.where("tidy != ''").select("obs_id", "tidy")


@query("""WITH d AS (SELECT DISTINCT lower(domain) AS domain FROM person_obs WHERE domain <> '')
 SELECT domain FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE ends_with(a.domain, '.' || b.domain))""")
def domains_listed(spark, sf_dir):
    return P.listed_domains(table(spark, sf_dir, "person_obs").select("domain"))


@query("""WITH o AS (SELECT DISTINCT regexp_extract(lower(domain), '^([^.]+)', 1) AS label FROM person_obs WHERE domain <> ''), l AS (SELECT label, regexp_replace(upper(label), '[^A-Z0-9]+', '', 'g') AS letters FROM o),
 t AS (SELECT label, letters, substring(letters, 1, k) AS code FROM l, unnest(range(least(6, length(letters)), length(letters) + 1)) AS u(k)),
 f AS (SELECT code FROM t GROUP BY 1 HAVING count(*) = 1), b AS (SELECT label, arg_min(code, length(code)) AS code FROM t WHERE code IN (SELECT code FROM f) GROUP BY 1),
 s AS (SELECT label, letters, row_number() OVER (PARTITION BY letters ORDER BY label) AS k FROM l WHERE label NOT IN (SELECT label FROM b))
 SELECT label, code FROM b UNION ALL SELECT label, letters || CASE WHEN k > 1 THEN CAST(k AS VARCHAR) ELSE '' END FROM s""")
def organisation_codes(spark, sf_dir):
    return P.organisation_codes(table(spark, sf_dir, "person_obs").where("domain != ''").select(F.regexp_extract(F.lower("domain"), r"^([^.]+)", 1).alias("label")))


def _people(spark, sf_dir) -> DataFrame:
    named = M.best_names(M.people_seen(table(spark, sf_dir, "emails")))
    return named.select(F.regexp_extract("email", r"@([^.@]+)", 1).alias("organisation"), "email", "display", "uses")


@query()
def people_aliases(spark, sf_dir):
    """Aliases, unique inside an organisation."""
    return P.aliases(_people(spark, sf_dir))


@query(f"""WITH {PEOPLE}, r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY CASE WHEN contains(display, ' ') THEN 0 ELSE 1 END, n DESC, display) AS k,
 sum(n) OVER (PARTITION BY email) AS uses FROM seen WHERE display <> '' AND NOT contains(display, '@')),
 p AS (SELECT regexp_extract(email, '@([^.@]+)', 1) AS organisation, email, display, uses FROM r WHERE k = 1)
 SELECT organisation, count(*) AS people, string_agg(display, '; ' ORDER BY display) AS names FROM p GROUP BY 1""")
def legend_lines(spark, sf_dir):
    return P.legend(_people(spark, sf_dir))


LINKED = "coalesce(subject, '') || ' see https://www.' || {0} || '/files?id=' || idx || ' or plan <https://' || {0} || '/a?b=1> and <http://' || {0} || '/> <mailto:' || coalesce(sender_email, '') || '> end'"
HOST = "CASE WHEN contains(coalesce(sender_email, ''), '@') THEN split_part(lower(sender_email), '@', 2) ELSE 'none.example' END"
SHORT = LINKED.format(HOST)
for _p, _r in ((P.OTHER, ""), (P.HOMEPAGE, ""), (f"<{P.LINK}>", "<link>"), (P.LINK, "\\1")):
    SHORT = f"regexp_replace({SHORT}, '{_sql(_p)}', '{_r}', 'gi')"


@query(f"SELECT idx, {SHORT} AS text FROM emails")
def links_shortened(spark, sf_dir):
    """Links in a line built from every mail: bare, in brackets, to a homepage and to a mailbox."""
    host = F.when(F.coalesce("sender_email", F.lit("")).contains("@"), F.split(F.lower("sender_email"), "@")[1]).otherwise("none.example")
    blank = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(blank("subject"), F.lit(" see https://www."), host, F.lit("/files?id="), F.col("idx").cast("string"), F.lit(" or plan <https://"), host, F.lit("/a?b=1> and <http://"), host, F.lit("/> <mailto:"), blank("sender_email"), F.lit("> end"))
    return table(spark, sf_dir, "emails").select("idx", P.short_links(line).alias("text"))


@query(f"SELECT doc_id, {R.report_score_sql('text')} AS score FROM documents")
def report_facts(spark, sf_dir):
    """How much a text holds that matters in reports."""
    return table(spark, sf_dir, "documents").select("doc_id", R.report_score(F.col("text")).alias("score"))


CELLS = "list_filter(list_transform(string_split(text, ' | '), lambda c: trim(c)), lambda c: c <> '')"
FIGURES = f"len(list_filter({CELLS}, lambda c: regexp_matches(regexp_replace(c, '^.*: ', ''), '{R.NUMBER_CELL}')))"


@query(f"""WITH {TABLES}, h AS (SELECT doc_no, table_no, block_no, text, row_no = 1 OR row_no <= 3 AND coalesce(min(CASE WHEN contains(text, ' | ') THEN 0 ELSE 1 END)
 OVER (PARTITION BY doc_no, table_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS is_header FROM t),
 c AS (SELECT doc_no, table_no, block_no, k, trim(string_split(text, ' | ')[k]) AS cell FROM t, unnest(range(1, len(string_split(text, ' | ')) + 1)) AS u(k)),
 v AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_no, table_no, k, lower(cell)) AS share FROM c WHERE cell <> ''),
 r AS (SELECT doc_no, block_no, round(sum(share), 6) AS rarity FROM v GROUP BY 1, 2)
 SELECT doc_no, block_no, round(rarity * 2 + {FIGURES} * 0.5::DOUBLE + CAST(contains(text, '$') AS INT) + CASE WHEN regexp_matches(text, '{RE2(R.TOTAL_ROW)}', 'i') THEN 20 ELSE 0 END, 4) AS score,
 CASE WHEN is_header OR len({CELLS}) < 3 THEN 0.0::DOUBLE ELSE greatest(CASE WHEN {FIGURES} >= 2 THEN least(3.0::DOUBLE, {FIGURES} * 0.5::DOUBLE) + 3 ELSE 0 END, CASE WHEN regexp_matches({CELLS}[1], '{R.ROW_CODE}') THEN 4 ELSE 0 END)::DOUBLE END AS floor
 FROM h JOIN r USING (doc_no, block_no)""")
def table_row_scores(spark, sf_dir):
    return R.row_scores(_blocks(spark, sf_dir))


BASE = "regexp_replace(regexp_replace(coalesce(file_name, ''), '^.*[\\\\/]', ''), '\\.[^.]*$', '')"


@query(f"""SELECT doc_no, regexp_matches({BASE}, '{R.DRAWING_CODE}') OR NOT regexp_matches({BASE}, '{R.NO_DRAWING}') AND (regexp_matches({BASE}, '{R.DRAWING_WORD}')
 OR regexp_matches({BASE}, '{R.REVISED}') AND regexp_matches(regexp_replace({BASE}, '{R.REVISED}', '', 'g'), '[0-9]{{3}}')) AS drawing_name FROM doctexts""")
def drawing_names(spark, sf_dir):
    return table(spark, sf_dir, "doctexts").select("doc_no", R.drawing_name(F.col("file_name")).alias("drawing_name"))


@query()
def drawing_titles(spark, sf_dir):
    """Title, revision and status from the title blocks of drawings."""
    return R.title_blocks(table(spark, sf_dir, "doctexts"))


NUMBERED = "regexp_replace(file_name, '\\s*\\([0-9]+\\)(\\.[^.]+)$', '\\1')"


@query(f"""WITH {ATTACHED}, p AS (SELECT thread_key, regexp_extract({NUMBERED}, '^(.*?)([0-9]+)\\.[^.]+$', 1) AS prefix, regexp_extract({NUMBERED}, '^(.*?)([0-9]+)\\.[^.]+$', 2) AS digits FROM att WHERE kind = 'photo'),
 g AS (SELECT thread_key, prefix, count(*) AS photos, list_sort(list(DISTINCT {{'number': CAST(digits AS DECIMAL(30, 0)), 'digits': digits}})) AS n FROM p WHERE digits <> '' GROUP BY 1, 2)
 SELECT thread_key, prefix, photos, prefix || CASE WHEN len(n) > 6 AND n[-1].number - n[1].number + 1 = len(n) THEN n[1].digits || '-' || n[-1].digits ELSE array_to_string(list_transform(n, lambda x: x.digits), ',') END AS label FROM g""")
def photo_labels(spark, sf_dir):
    """The photos of a thread by their numbers."""
    rows = M.attachments(table(spark, sf_dir, "emails")).where("kind = 'photo'").withColumn("thread_key", M.thread_key(F.col("subject")))
    return R.photo_groups(rows, ["thread_key"])


IMAGES = "('.jpg', '.jpeg', '.png', '.heic', '.gif', '.bmp', '.tif', '.tiff')"


@query(f"""WITH p AS (SELECT regexp_extract(path, '^(.*)[\\\\/]', 1) AS folder, lower(regexp_extract(path, '(\\.[^.\\\\/]+)$', 1)) AS ext FROM emails),
 k AS (SELECT folder, ext, count(*) AS files, count(CASE WHEN ext IN {IMAGES} THEN 1 END) AS images FROM p GROUP BY 1, 2)
 SELECT folder, ext, files, images, sum(files) OVER w > 6 OR sum(images) OVER w >= 2 AS in_one_line FROM k WINDOW w AS (PARTITION BY folder)""")
def files_grouped(spark, sf_dir):
    """Files by folder and extension, and whether a folder's share a line."""
    return R.other_files(table(spark, sf_dir, "emails").select("path"))


@query("""SELECT idx, CASE WHEN file_size IS NULL OR file_size < 0 THEN '' WHEN file_size >= 1048576 THEN printf('%.1f MB', file_size / 1048576.0::DOUBLE)
 WHEN file_size >= 1024 THEN CAST(CAST(round(file_size / 1024.0::DOUBLE) AS BIGINT) AS VARCHAR) || ' KB' ELSE CAST(file_size AS VARCHAR) || ' bytes' END AS size, CAST(round(length(coalesce(body, '')) / 3.5::DOUBLE) AS BIGINT) AS tokens FROM emails""")
def sizes_told(spark, sf_dir):
    """Sizes as people read them, and the estimate of tokens."""
    return table(spark, sf_dir, "emails").select("idx", R.size_text(F.col("file_size")).alias("size"), R.token_estimate(F.length(F.coalesce("body", F.lit("")))).alias("tokens"))


CONTINUED = "trim(regexp_replace({0}, '\\s*[(\\[]?\\b(?:continued|cont''?d|cont\\.)[)\\]]?\\s*$', ''))"


@query(f"""WITH {BLOCKS}, h AS (SELECT doc_no, block_no, text, lag(text) OVER (PARTITION BY doc_no ORDER BY block_no) AS before FROM b WHERE block_type = 'heading')
 SELECT doc_no, block_no FROM h WHERE {CONTINUED.format('lower(text)')} <> lower(text) AND {CONTINUED.format('lower(text)')} = {CONTINUED.format('lower(before)')}""")
def headings_continued(spark, sf_dir):
    return R.continued_headings(_blocks(spark, sf_dir))


FOCUS = "RFI 12; crane, concrete"
FOUND = " OR ".join(f"regexp_matches(t, '{C.keyword_pattern(k).replace('(?<![a-z0-9])', '(?:^|[^a-z0-9])').replace('(?![0-9])', '(?:$|[^0-9])')}')" for k in C.keyword_list(FOCUS))


@query(f"""WITH t AS (SELECT doc_no, lower(coalesce(file_name, '') || ' ' || coalesce(array_to_string(list_transform(blocks, lambda b: coalesce(b.text, '')), ' '), '')) AS t FROM doctexts)
 SELECT doc_no FROM t WHERE {FOUND}""")
def focus_documents(spark, sf_dir):
    """Documents with a keyword of the settings in their name or text."""
    return R.focus_documents(table(spark, sf_dir, "doctexts"), FOCUS)


@query("""SELECT DISTINCT lower(domain) AS domain, CASE WHEN lower(domain) = 'acme.example' OR ends_with(lower(domain), '.acme.example') THEN 'ACME'
 WHEN lower(domain) = 'x.example' OR ends_with(lower(domain), '.x.example') THEN 'X' END AS code FROM person_obs WHERE domain <> ''""")
def organisation_settings(spark, sf_dir):
    """Codes of organisations that a user has set."""
    domains = table(spark, sf_dir, "person_obs").where("domain != ''").select(F.lower("domain").alias("domain")).distinct()
    return R.configured_codes(domains, C.parse_org_codes("acme.example = ACME; x.example = X"))


@query("""SELECT doc_no, coalesce(regexp_matches(lower(note), 'part|first|limit|scan|too '), false) OR len(list_filter(coalesce(blocks, []), lambda b: b.block_type = 'sheet' AND coalesce(b.hidden, false))) > 0 AS partly FROM doctexts""")
def documents_partly_read(spark, sf_dir):
    return R.partly_read(table(spark, sf_dir, "doctexts"))


@query()
def documents_sources(spark, sf_dir):
    """With which messages each document came."""
    rows = with_instant(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes")).withColumn("thread", M.thread_key(F.col("subject")))
    return R.document_sources(rows)


@query()
def documents_parts(spark, sf_dir):
    """Into which part of the documents digest each line of each document goes."""
    lines = R.documents_digest(table(spark, sf_dir, "doctexts")).select(F.lit("documents").alias("project"), F.col("doc_no").cast("string").alias("thread"), F.col("doc_no").alias("first_s"), F.posexplode(F.split("text", "\n")).alias("entry_no", "line"))
    return packed(lines.select("project", "thread", "first_s", F.col("entry_no").cast("long").alias("entry_no"), (F.length("line") + 1).alias("size")))


@query()
def documents_digest(spark, sf_dir):
    """Every document file as its section of the documents digest."""
    return R.documents_digest(table(spark, sf_dir, "doctexts"))
