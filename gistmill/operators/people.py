"""Who is who in a digest: tidy names, codes of organisations, aliases of people, the legend."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy_name(display: Column, email: Column) -> Column:
    """``Last, First`` turned round, brackets and quotes off, glued words split; without a name the part before the at sign."""
    name = F.regexp_replace(F.coalesce(display, F.lit("")), r"\s*\([^()]*\)\s*$", "")
    name = F.trim(F.regexp_replace(name, r"^['\"]+|['\"]+$", ""))
    name = F.regexp_replace(name, r"([a-z])([A-Z][a-z])", "$1 $2")
    name = F.regexp_replace(name, r"^([^,@]+), *([^,@]+)$", "$2 $1")
    local = F.initcap(F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(email, F.lit(""))), r"^([^@]+)", 1), r"[._-]+", " "))
    return F.when((name == "") | name.contains("@"), local).otherwise(name)


def listed_domains(domains: DataFrame) -> DataFrame:
    """``domain`` without those that lie below another one of the list: a semi-join on every parent, not on pairs."""
    one = domains.select(F.lower("domain").alias("domain")).where("domain != ''").distinct()
    parts = F.split("domain", r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    below = one.where(F.size(parts) > 1).select("domain", F.explode(parents).alias("parent"))
    return one.join(below.join(one.select(F.col("domain").alias("parent")), "parent", "left_semi").select("domain"), "domain", "left_anti")


def organisation_codes(labels: DataFrame, least: int = 6) -> DataFrame:
    """``label, code``: the shortest beginning of six letters or more that no other label has, in capitals; else all of it and a number."""
    one = labels.select("label", F.regexp_replace(F.upper("label"), r"[^A-Z0-9]+", "").alias("letters")).where("letters != ''").distinct()
    whole = F.length("letters")
    cuts = F.transform(F.sequence(F.least(F.lit(least), whole), whole), lambda k: F.substring("letters", 1, k))
    tried = one.select("label", "letters", F.explode(cuts).alias("code"))
    free = tried.join(tried.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "code").groupBy("label").agg(F.min_by("code", F.length("code")).alias("code"))
    order = Window.partitionBy("letters").orderBy("label")
    same = one.join(free, "label", "left_anti").withColumn("k", F.row_number().over(order))
    return free.unionByName(same.select("label", F.concat("letters", F.when(F.col("k") > 1, F.col("k").cast("string")).otherwise("")).alias("code")))


def aliases(people: DataFrame) -> DataFrame:
    """``email, alias`` of ``organisation, email, display, uses``: initials, then more letters of the last name, then a number; the busiest choose first.

    Choosing is in order inside an organisation, so each one's people (names only) go to one task.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        frame = frame.assign(low=frame.display.str.lower()).sort_values(["uses", "low", "email"], ascending=[False, True, True])
        for r in frame.itertuples():
            words = [w for w in "".join(c if c.isalpha() else " " for c in r.display).split() if w] or ["X"]
            last = words[-1]
            tries = [words[0][0] + last[:k] for k in range(1, len(last) + 1)] if len(words) > 1 else [last[:k] for k in range(2, len(last) + 1)] or [last]
            pick = next((t for t in tries if t.lower() not in taken), None)
            k = 2
            while pick is None or pick.lower() in taken:
                pick, k = f"{tries[-1]}{k}", k + 1
            taken.add(pick.lower())
            out.append((r.email, pick))
        return pd.DataFrame(out, columns=["email", "alias"])

    return people.groupBy("organisation").applyInPandas(choose, "email string, alias string")


def legend(people: DataFrame) -> DataFrame:
    """``organisation, people, names``: the people of an organisation in one line, all of them named."""
    named = F.array_sort(F.collect_list("display"))
    return people.groupBy("organisation").agg(F.count(F.lit(1)).alias("people"), F.array_join(named, "; ").alias("names"))


# The parts of links that are handled.
LINK = r"https?://(?:www\.)?([^/\s<>|)\]?#\"']+)[^\s<>|)\]\"']*"
HOMEPAGE = r"<https?://[^/\s<>|)\]?#\"']+/?>"
WRAPPED = r"https?://[\w.-]*safelinks\.protection\.outlook\.com/[^\s<>|)]*?[?&]url=([^&\s<>|)]+)[^\s<>|)]*"
OTHER = r"<(?:mailto|tel|file|cid|callto|sip):[^<>\s]*>|\[(?:mailto|cid):[^\]]*\]"


def replace_links(text: str) -> str:
    """Links as readers need them: those that a mail filter has wrapped are decoded, one in brackets behind its words is ``<link>``, a bare
    one its host. Links to mail, phones, files and pictures go, and so do homepages, pictures' links and links behind their own address."""
    text = re.sub(OTHER, "", re.sub(WRAPPED, lambda m: unquote(m[1]), text, flags=re.I), flags=re.I)
    text = re.sub(r"\bmailto:", "", text, flags=re.I)
    if "://" not in text and "www." not in text:
        return text
    lines = re.sub(HOMEPAGE, "", text, flags=re.I).split("\n")
    for k, line in enumerate(lines):
        while m := re.search(rf"[ \t]*<{LINK}>", line, re.I):
            words = line[: m.start()].split()
            told = words and not re.search(r"(?:https?://\S+|www\.\S+|\.[a-z]{2,4}|@[\w.-]+)$", words[-1], re.I)
            line = line[: m.start()] + (" <link>" if told else "") + line[m.end() :]
        lines[k] = re.sub(r"\bwww\.([\w-]+(?:\.[\w-]+)+)[^\s<>\"]*", r"\1", re.sub(LINK, r"\1", line, flags=re.I), flags=re.I)
    return "\n".join(lines)


def short_links(text: Column) -> Column:
    """:func:`replace_links` by built-in expressions, for texts without wrapped links, and without the rules that look at the words in front."""
    for pattern, put in ((OTHER, ""), (HOMEPAGE, ""), (f"<{LINK}>", "<link>"), (LINK, "$1")):
        text = F.regexp_replace(text, f"(?i){pattern}", put)
    return text


def page_furniture(lines: DataFrame, edge: int = 3) -> DataFrame:
    """``doc_no, page, line_no`` of headers and footers: short edge lines whose shape stands on three of ten pages, and bare page numbers."""
    up, down = Window.partitionBy("doc_no", "page").orderBy("line_no"), Window.partitionBy("doc_no", "page").orderBy(F.desc("line_no"))
    edges = lines.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)}).where((F.least("_a", "_b") <= edge) & (F.length("text") < 200))
    edges = edges.withColumn("shape", F.regexp_replace(F.lower("text"), r"[0-9]+", "#"))
    pages = lines.groupBy("doc_no").agg(F.countDistinct("page").alias("pages"))
    often = edges.groupBy("doc_no", "shape").agg(F.countDistinct("page").alias("on")).join(pages, "doc_no").where(F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.3)))
    bare = F.trim("shape").rlike(r"^(?:page|seite|strona|стр\.?)?\s*#(?:\s*(?:of|von|de|/|z|из)\s*#)?$")
    frequent = edges.join(often.select("doc_no", "shape"), ["doc_no", "shape"], "left_semi")
    return frequent.unionByName(edges.where(bare)).select("doc_no", "page", "line_no").distinct()
