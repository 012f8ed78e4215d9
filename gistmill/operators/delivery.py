"""Messages delivered more than once: one identity per message, one kept row per identity.

Defined results: rows whose identifier is NULL, empty, blank, without an ``@`` or of a reserved ``.invalid`` host
identify nothing, and so does an identifier that rows with different senders and different subjects share; such
rows are messages of their own. The kept row is the least by the delivery order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"^[\s ​﻿]+|[\s ​﻿]+$"


def identifier(raw: Column) -> Column:
    """The identifier inside a Message-ID or In-Reply-To value, in lower case; NULL where there is none.

    The part in angle brackets counts where there is one (also after other words), else the trimmed value.
    """
    bare = F.regexp_replace(raw, BLANK, "")
    inside = F.regexp_extract(bare, r"<\s*([^<>]*?)\s*>[^<>]*$", 1)
    # folded white space may break long values
    key = F.lower(F.regexp_replace(F.when(inside != "", inside).otherwise(bare), r"[\s<>]+", ""))
    usable = key.rlike(r"^[^@]+@[^@]+$") & ~key.rlike(r"@(?:.*\.)?(?:invalid|localhost)$")
    return F.when(usable, key)


def reply_target(raw: Column) -> Column:
    """As :func:`identifier`, for the message a reply names."""
    return identifier(raw)


def says_nothing(raw: Column) -> Column:
    """True where a reference is NULL or blank, so that it names no message at all."""
    return F.coalesce(F.regexp_replace(raw, BLANK, ""), F.lit("")) == ""


def delivery_key(order: list[str]) -> Column:
    """The order of delivery as one value: one column as it is, several as a struct (ties go to the next one)."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def messages(rows: DataFrame, order: list[str] | None = None, least: int = 2) -> DataFrame:
    """``message_key, kept, n_rows`` of each identified message that ``rows`` holds at least ``least`` times.

    ``kept`` is the ``idx`` that comes first by ``order``, found by ``min_by`` with partial aggregation before the
    shuffle, so that a key with a third of all rows sends one record a task.
    """
    order = order or ["idx"]
    topic = F.lower(F.regexp_replace(F.coalesce("subject", F.lit("")), r"^.*[:\]]\s*|\s+", ""))
    sender = F.lower(F.trim(F.coalesce("sender_email", F.lit(""))))
    keyed = rows.select(
        identifier(F.col("message_id")).alias("message_key"),
        "idx",
        *[c for c in order if c != "idx"],
        F.xxhash64(sender).alias("sender_hash"),
        F.xxhash64(topic).alias("topic_hash"),
    ).where(F.col("message_key").isNotNull())
    grouped = keyed.groupBy("message_key").agg(
        F.min_by("idx", delivery_key(order)).alias("kept"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("sender_hash").alias("sender_a"),
        F.max("sender_hash").alias("sender_b"),
        F.min("topic_hash").alias("topic_a"),
        F.max("topic_hash").alias("topic_b"),
    )
    unrelated = (F.col("sender_a") != F.col("sender_b")) & (F.col("topic_a") != F.col("topic_b"))
    return grouped.where((F.col("n_rows") >= least) & ~unrelated).select("message_key", "kept", "n_rows")


def further_copies(rows: DataFrame, order: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """``idx_a, idx_b``: the kept row of a message and each further copy of it; ``known``: its :func:`messages`, if there already."""
    keyed = rows.select(F.col("idx").alias("idx_b"), identifier(F.col("message_id")).alias("message_key")).where(
        F.col("message_key").isNotNull()
    )
    known = messages(rows, order) if known is None else known.where("n_rows > 1")
    return (
        keyed.join(known, "message_key")
        .where(F.col("idx_b") != F.col("kept"))
        .select(F.col("kept").alias("idx_a"), "idx_b")
    )


def keep_one(rows: DataFrame, order: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """``rows`` without further copies; all columns stay, rows without a usable identifier stay too."""
    return rows.join(further_copies(rows, order, known).select(F.col("idx_b").alias("idx")), "idx", "left_anti")
