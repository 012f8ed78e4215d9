"""How much fact a passage holds: capped, weighted counts of patterns, all inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, pattern (valid for Java and RE2), weight, most that is counted.
PATTERNS = (
    ("amount", r"[€$£] ?\d[\d.,]*|\d[\d.,]* ?(?:€|EUR|USD|GBP)\b", 3, 2),
    ("reference", r"\b(?:RFI|NCR|VO|TQ|SI|WF|CO|EOT)[ -]?\d+", 3, 2),
    ("drawing", r"\b[A-Z]{2,4}-\d{3,6}\b", 2, 2),
    ("date", r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", 2, 2),
    ("quantity", r"\b\d+(?:[.,]\d+)? ?(?:mm|cm|m|km|kg|t|kN|MPa|pcs|pi~ce|St~ck|°C|%)", 1, 2),
    ("question", r"\?", 2, 1),
    ("request", r"(?i)\b(?:please|bitte|merci de|prosz~|favor)\b", 1, 1),
    ("decision", r"(?i)\b(?:approved|rejected|agreed|signed off|on hold|instructed|genehmigt|valid~)\b", 2, 1),
)


#: Letters beyond ASCII are masked first, so that word boundaries are the same in every engine.
MASKED = r"[^\x00-\x7F€£°]"


def fact_score(text: Column) -> Column:
    """Sum of ``weight * least(most, count)``, plus 3 where anything but a question was found; 0 for NULL."""
    text = F.regexp_replace(text, MASKED, "~")
    counts = [F.least(F.lit(most), F.regexp_count(text, F.lit(pattern))) * weight for _, pattern, weight, most in PATTERNS]
    hard = reduce(add, counts[:5])
    return F.coalesce(reduce(add, counts) + F.when(hard > 0, 3).otherwise(0), F.lit(0)).cast("long")


def fact_score_sql(text: str) -> str:
    """The same in SQL of an engine with RE2."""
    text = f"regexp_replace({text}, '{MASKED}', '~', 'g')"
    parts = [f"least({most}, len(regexp_extract_all({text}, '{pattern}'))) * {weight}" for _, pattern, weight, most in PATTERNS]
    hard = " + ".join(parts[:5])
    return f"CAST(coalesce({' + '.join(parts)} + CASE WHEN {hard} > 0 THEN 3 ELSE 0 END, 0) AS BIGINT)"
