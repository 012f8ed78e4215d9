"""Queries on mail that need no language tools, with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.operators.delivery import further_copies, keep_one
from gistmill.operators.instants import with_instant
from gistmill.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return further_copies(table(spark, sf_dir, "emails"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: what is kept of the table."""
    return keep_one(table(spark, sf_dir, "emails")).select("idx", "batch_id", "mailbox", "path")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails").select("idx", "mailbox", "date_iso")
    return with_instant(emails, table(spark, sf_dir, "mailboxes")).where(F.col("utc_s").isNotNull()).select("idx", "utc_s")


QUERIES = {"p6_found": p6_found, "p6_kept": p6_kept, "p7_found": p7_found}

_COPIES = r"""
bare AS (SELECT idx, trim(coalesce(message_id, ''), E' \t\r\n') AS v,
  lower(coalesce(sender_email, '')) AS sender,
  lower(regexp_replace(coalesce(subject, ''), '^.*[:\]]\s*|\s+', '', 'g')) AS topic FROM emails),
keyed AS (SELECT *, lower(regexp_replace(CASE WHEN regexp_extract(v, '<\s*([^<>]*?)\s*>[^<>]*$', 1) <> ''
  THEN regexp_extract(v, '<\s*([^<>]*?)\s*>[^<>]*$', 1) ELSE v END, '[\s<>]+', '', 'g')) AS mid FROM bare),
usable AS (SELECT * FROM keyed WHERE regexp_full_match(mid, '[^@]+@[^@]+')
  AND NOT regexp_matches(mid, '@(.*\.)?(invalid|localhost)$')),
kept AS (SELECT mid, min(idx) AS idx_a FROM usable GROUP BY mid
  HAVING count(*) > 1 AND NOT (count(DISTINCT sender) > 1 AND count(DISTINCT topic) > 1)),
copies AS (SELECT k.idx_a, u.idx AS idx_b FROM usable u JOIN kept k USING (mid) WHERE u.idx <> k.idx_a)
"""

ORACLES = {
    "p6_found": f"WITH {_COPIES} SELECT idx_a, idx_b FROM copies",
    "p6_kept": f"WITH {_COPIES} SELECT idx, batch_id, mailbox, path FROM emails WHERE idx NOT IN (SELECT idx_b FROM copies)",
}
