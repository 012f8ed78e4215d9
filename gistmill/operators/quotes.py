"""Quoted messages inside bodies as rows, and those of them that were never filed.

A header block (fields with a date among them) or an introduction (name or address, time, a verb of writing) begins a quoted message; its
text runs to the next one. Marks in front of lines are dropped. Depth 0 is the newest. Bodies without quotes, NULL ones too, give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.operators.instants import with_instant

DEPTH = 15
# Names of header fields in seven languages.
FIELDS = {"from": "from|von|de|od|от", "date": "sent|date|gesendet|datum|envoyé|fecha|enviado|enviada|data|wysłano|отправлено|дата", "to": "to|an|à|para|do|кому", "cc": "cc|dw|копия", "subject": "subject|betreff|objet|asunto|assunto|temat|тема"}
FIELD = re.compile("|".join(rf"(?P<{k}>^[\s*]*(?:{v})\s*\*?\s?:\*?\s*)" for k, v in FIELDS.items()), re.I)
WHEN = r"(?:(?:[^\W\d_]{2,},? )?\d{1,2}(?:[./]\d{1,2}[./]\d{2,4}|\.? (?:de )?[^\W\d_]{3,}\.? (?:de )?\d{4}),?(?: at| um| à| a las| às)? \d{1,2}:\d{2})"
WHO = r"(?P<name>[^<>:,]{2,60}?)?\s*(?:<(?P<address>[^<>@\s]+@[^<>\s]+)>)?"
VERB = r"(?:wrote|schrieb|geschrieben|a écrit|escribió|escreveu|napisał\(a\)|пишет|писал\(а\))"
INTRO = re.compile(rf"^(?:(?:on|at|am|le|el|em|w dniu) )?(?P<when>{WHEN})[,\s-]*(?:hat |schrieb )?{WHO}\s*(?:{VERB})?\s?:?$|^{WHO.replace('name', 'name2').replace('address', 'address2')}\s*{VERB}(?: (?:on|am|le|el|em))? (?P<when2>{WHEN})\s?:?$", re.I)
ADDRESS = re.compile(r"<([^<>@\s]+@[^<>\s]+)>")
SCHEMA = "idx long, depth int, sender_name string, sender_email string, date_iso string, subject string, body string"


def parse_quoted(body: str | None) -> list[dict]:
    """The quoted messages of a body, newest first, at most :data:`DEPTH`."""
    lines = [re.sub(r"^\s*(?:[>|]\s?)+", "", x).strip() for x in (body or "").split("\n")]
    found: list[dict] = []
    k = 0
    while k < len(lines):
        line, fields, at = lines[k], {}, k
        while at < len(lines) and (m := FIELD.match(lines[at])) and m.lastgroup not in fields:
            fields[m.lastgroup] = lines[at][m.end() :].strip("* ")
            at += 1
        if len(fields) >= 2 and re.search(r"\d", fields.get("date", "")) and "from" in fields:
            address = ADDRESS.search(fields["from"])
            found.append({"sender_name": ADDRESS.sub("", fields["from"]).strip(), "sender_email": address[1].lower() if address else "", "date_iso": fields["date"], "subject": fields.get("subject", ""), "lines": []})
            k = at
            continue
        # an introduction may be wrapped onto a second line
        alone = bool(re.search(VERB, line, re.I))
        text = line if alone else f"{line} {lines[k + 1]}" if k + 1 < len(lines) and line and len(line) < 160 else ""
        if text and re.search(VERB, text, re.I) and (intro := INTRO.match(text)):
            g = intro.groupdict()
            found.append({"sender_name": (g["name"] or g["name2"] or "").strip(), "sender_email": (g["address"] or g["address2"] or "").lower(), "date_iso": g["when"] or g["when2"] or "", "subject": "", "lines": []})
            k += 1 if alone else 2
            continue
        if found:
            found[-1]["lines"].append(line)
        k += 1
    return [{**{c: f[c] for c in ("sender_name", "sender_email", "date_iso", "subject")}, "body": "\n".join(f["lines"]).strip()} for f in found[:DEPTH]]


def quoted(emails: DataFrame) -> DataFrame:
    """:data:`SCHEMA` of every quoted message."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"idx": i, "depth": d} | q for i, b in zip(frame.idx, frame.body) for d, q in enumerate(parse_quoted(b))]
            yield pd.DataFrame(rows, columns=["idx", "depth", "sender_name", "sender_email", "date_iso", "subject", "body"])

    return emails.where(F.col("body").rlike(r"[0-9]:[0-9]{2}")).select("idx", "body").mapInPandas(work, SCHEMA)


def never_filed(emails: DataFrame, mailboxes: DataFrame, tolerance: int = 120) -> DataFrame:
    """``idx, depth, sender_email, utc_s`` of quoted messages without a filed one of the same sender within ``tolerance`` seconds.

    An anti-join on sender and time bucket; quotes without address or instant are left out, as nothing can tell.
    """
    inner = quoted(emails).join(emails.select("idx", "mailbox"), "idx")
    inner = with_instant(inner, mailboxes).where("utc_s is not null and sender_email != ''").withColumn("bucket", F.floor(F.col("utc_s") / tolerance))
    filed = with_instant(emails.select("mailbox", "date_iso", "sender_email"), mailboxes).where("utc_s is not null")
    near = F.explode(F.array(*[F.floor(F.col("utc_s") / tolerance) + k for k in (-1, 0, 1)]))
    filed = filed.select(F.lower("sender_email").alias("f_sender"), F.col("utc_s").alias("f_s"), near.alias("f_bucket")).distinct()
    same = (F.col("sender_email") == F.col("f_sender")) & (F.col("bucket") == F.col("f_bucket")) & (F.abs(F.col("utc_s") - F.col("f_s")) <= tolerance)
    return inner.join(filed, same, "left_anti").select("idx", "depth", "sender_email", "utc_s")

