"""Mixed timestamp formats and time zones: one instant (whole UTC seconds) for each text that denotes one.

An ordered cascade of anchored patterns rewrites a text to ``year|month|day|hour|minute|second|half|zone``; the parts
are checked strictly and turned into seconds by arithmetic, so the session's time zone plays no part. Policy:

* numbers: 10 or 9 digits seconds, 13 milliseconds, 16 microseconds, 19 nanoseconds since 1970; 18 digits 100 ns
  since 1601, or since year 1 where that would lie beyond 2200;
* no zone: local time of the mailbox (``tz_name``, else UTC); a time that occurs twice is the first one, one that is
  skipped is read with the offset before the change;
* zone letters: what they mean in the mailbox's zone, else in common use; UT, UTC, GMT and Z are zero;
* day and month as numbers: the locale's order, unless only the other one is a date;
* NULL, empty and other texts, dates without a time of day, impossible dates, and years outside 1971..2200: NULL.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names of seven languages, in order January to December.
MONTHS = (
    "january jan januar jänner janvier janv enero ene janeiro stycznia styczeń sty января январь янв",
    "february feb februar février févr fevr fevrier febrero fevereiro fev lutego luty lut февраля февраль фев",
    "march mar märz mrz maerz mars marzo março marco marca marzec марта март мар",
    "april apr avril avr abril abr kwietnia kwiecień kwi апреля апрель апр",
    "may mai mayo maio maja maj мая май",
    "june jun juni juin junio junho czerwca czerwiec cze июня июнь июн",
    "july jul juli juillet juil julio julho lipca lipiec lip июля июль июл",
    "august aug août aout agosto ago sierpnia sierpień sie августа август авг",
    "september sep sept septembre septiembre setembro set września wrzesień wrz сентября сентябрь сен",
    "october oct oktober okt octobre octubre outubro out października październik paź октября октябрь окт",
    "november nov novembre noviembre novembro listopada listopad lis ноября ноябрь ноя",
    "december dec dezember dez décembre déc decembre diciembre dic dezembro grudnia grudzień gru декабря декабрь дек",
)
# Zone letters in common use, hours from UTC, for letters that the mailbox's own zone doesn't know.
ZONES = {
    "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "WET": 0, "WEST": 1, "EET": 2, "EEST": 3, "BST": 1, "MSK": 3, "IST": 5.5, "NPT": 5.75,
    "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "HST": -10,
}

DAYNAME = r"(?:[^\W\d_]{2,}\.?,? )?"
MONTH = r"([^\W\d_]{3,})\.?"
ZONE = r"(?: ?(Z|z|[+-]\d{2}:?\d{2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|(?!AM|PM|am|pm)[A-Za-z]{2,5}))?(?: ?\([^()]*\))?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([AaPp])\.?[Mm]\.?)?"
#: Name, anchored pattern, and the order its groups have in year|month|day|hour|minute|second|half|zone.
CASCADE = (
    ("iso", rf"(?U)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]| ){CLOCK}{ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    ("basic", r"(?U)^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)? ?(Z|z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6||$7"),
    ("day first", rf"(?U)^{DAYNAME}(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -](?:de )?{MONTH},?[ -](?:de )?(\d{{4}}|\d{{2}}),?(?: at| um| à| a las| às| o| в)? {CLOCK}{ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    ("month first", rf"(?U)^{DAYNAME}{MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),?(?: at)? {CLOCK}{ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("year last", r"(?U)^[^\W\d_]{2,}\.?,? ([^\W\d_]{3,}) (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?: ([+-]\d{4}|[A-Za-z]{1,5}))? (\d{4})$", "$7|$1|$2|$3|$4|$5||$6"),
    ("numbers", rf"(?U)^{DAYNAME}(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}}),? {CLOCK}{ZONE}$", "$3|#$1#$2|0|$4|$5|$6|$7|$8"),
)

FIRST = int(datetime(1971, 1, 1, tzinfo=timezone.utc).timestamp())
LAST = int(datetime(2201, 1, 1, tzinfo=timezone.utc).timestamp()) - 1


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def zone_letters(tz_names: pd.Series) -> pd.Series:
    """Letters -> seconds from UTC, as the zone itself used them from 1971 on; the latest meaning counts."""
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    def letters(name: str | None) -> dict[str, int]:
        try:
            zone = ZoneInfo(name or "UTC")
        except Exception:
            return {}
        found: dict[str, int] = {}
        moment = datetime(1971, 1, 1, tzinfo=timezone.utc)
        while moment.year < 2038:
            local = moment.astimezone(zone)
            found[(local.tzname() or "").upper()] = int(local.utcoffset().total_seconds())
            moment += timedelta(days=45)
        if (name or "").startswith("Australia/"):  # where AEST is also written EST
            found = {k[1:]: v for k, v in found.items() if len(k) == 4 and k[0] == "A"} | found
        return {k: v for k, v in found.items() if k.isalpha()}

    return tz_names.map(letters)


def zones_of(mailboxes: DataFrame) -> DataFrame:
    """``mailbox, tz_name, month_first, letters``, one row per mailbox (the first of repeated ones by name order)."""
    one = mailboxes.groupBy("mailbox").agg(F.min("tz_name").alias("tz_name"), F.min("locale").alias("locale"))
    return one.select(
        "mailbox",
        "tz_name",
        F.coalesce(F.col("locale").rlike(r"(?i)[-_](US|PH|FM|PW|BZ)$"), F.lit(False)).alias("month_first"),
        zone_letters(F.col("tz_name")).alias("letters"),
    )


def _epoch(text: Column) -> Column:
    n, v = F.length(text), F.expr("try_cast(date_text AS BIGINT)")
    whole = lambda unit: F.expr(f"try_cast(date_text AS BIGINT) div {unit}")
    return (
        F.when(n.between(9, 10), v)
        .when(n == 13, whole(1_000))
        .when(n == 16, whole(1_000_000))
        .when(n == 19, whole(1_000_000_000))
        .when((n == 18) & (v >= F.lit(600_000_000_000_000_000)), whole(10_000_000) - F.lit(62_135_596_800))
        .when(n == 18, whole(10_000_000) - F.lit(11_644_473_600))
    )


def _month(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, line in enumerate(MONTHS, 1) for w in line.split() for x in (w, k)])
    return F.coalesce(F.expr("try_cast(p_month AS INT)"), names[F.lower(name)])


def with_instant(emails: DataFrame, mailboxes: DataFrame, text: str = "date_iso", out: str = "utc_s") -> DataFrame:
    """``emails`` with the column ``out``: seconds since 1970 UTC, NULL where ``text`` denotes no instant.

    Mailboxes are joined by size: Spark broadcasts them only below its threshold. All columns of ``emails`` stay.
    """
    kept = emails.columns
    clean = F.trim(F.regexp_replace(F.col(text), r"[\s  ]+", " "))
    clean = F.regexp_replace(clean, r"^(?i)(?:date|sent|datum|gesendet|envoyé|enviado)\s*: ", "")
    parts = F.lit(None).cast("string")
    for _, pattern, order in reversed(CASCADE):
        parts = F.when(F.col("date_text").rlike(pattern), F.regexp_replace("date_text", pattern, order)).otherwise(parts)
    rows = emails.join(
        zones_of(mailboxes).withColumnsRenamed({c: f"z_{c}" for c in ("mailbox", "tz_name", "month_first", "letters")}),
        F.col("mailbox") == F.col("z_mailbox"),
        "left",
    )
    rows = rows.withColumn("date_text", clean).withColumn(
        "date_parts", F.when(F.col("date_text").rlike(r"^\d+$") & ~F.length("date_text").isin(12, 14), F.lit(None)).otherwise(F.split(parts, r"\|"))
    )
    get = lambda k: F.col("date_parts")[k]
    a, b = F.expr("try_cast(split(date_parts[1], '#')[1] AS INT)"), F.expr("try_cast(split(date_parts[1], '#')[2] AS INT)")
    as_month_first = F.when(F.col("z_month_first"), (a <= 12)).otherwise((b > 12) & (a <= 12))
    numeric = get(1).startswith("#")
    rows = rows.withColumns(
        {
            "p_year": F.expr("try_cast(date_parts[0] AS INT)"),
            "p_month": F.when(~numeric, get(1)).when(as_month_first, a.cast("string")).otherwise(b.cast("string")),
            "p_day": F.when(~numeric, F.expr("try_cast(date_parts[2] AS INT)")).when(as_month_first, b).otherwise(a),
            "p_hour": F.expr("try_cast(date_parts[3] AS INT)"),
            "p_minute": F.expr("try_cast(date_parts[4] AS INT)"),
            "p_second": F.coalesce(F.expr("try_cast(nullif(date_parts[5], '') AS INT)"), F.lit(0)),
            "p_half": F.lower(get(6)),
            "p_zone": F.upper(get(7)),
        }
    )
    year = F.when(F.length(get(0)) > 2, F.col("p_year")).when(F.col("p_year") < 70, F.col("p_year") + 2000).otherwise(F.col("p_year") + 1900)
    twelve = F.col("p_half").isin("a", "p")
    hour = (
        F.when(~twelve | F.col("p_half").isNull(), F.col("p_hour"))
        .when(F.col("p_hour").between(1, 12), F.col("p_hour") % 12 + F.when(F.col("p_half") == "p", 12).otherwise(0))
    )
    rows = rows.withColumns({"p_year": year, "p_month": _month(F.col("p_month")), "p_hour": hour})
    day = F.expr("cast(try_make_timestamp_ntz(p_year, p_month, p_day, 0, 0, 0) AS DATE)")
    good = F.col("p_hour").between(0, 23) & F.col("p_minute").between(0, 59) & F.col("p_second").between(0, 60)
    wall = F.when(
        good,
        F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.col("p_hour") * 3600 + F.col("p_minute") * 60 + F.col("p_second"),
    )
    rows = rows.withColumn("p_wall", wall)
    zone = F.col("p_zone")
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    digits = F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0"))
    h, m = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    sign = F.when(zone.contains("-"), -1).otherwise(1)
    number = F.when((h <= 18) & (m <= 59), sign * (h * 3600 + m * 60))
    common = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, int(v * 3600))])
    letters = F.when(zone.isin("Z", "UT", "UTC", "GMT"), 0).otherwise(F.coalesce(F.col("z_letters")[zone], common[zone]))
    offset = F.when(zone.rlike("[0-9]"), number).otherwise(letters)
    local = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("p_wall"), F.coalesce("z_tz_name", F.lit("UTC"))))
    instant = F.when(F.col("date_text").rlike(r"^\d{9,19}$") & ~F.length("date_text").isin(12, 14), _epoch(F.col("date_text"))).otherwise(
        F.when(F.coalesce(zone, F.lit("")) == "", local).otherwise(F.col("p_wall") - offset)
    )
    rows = rows.withColumn("p_instant", instant)
    # always true, but no constant: filters on the result are not pushed into the cascade, which would repeat it all
    stays = F.spark_partition_id() >= 0
    checked = F.when(stays & F.col("p_instant").between(FIRST, LAST), F.col("p_instant"))
    return rows.select(*[F.col(c) for c in kept if c != out], checked.cast("long").alias(out))
