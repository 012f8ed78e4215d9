"""What the documents digest is made of: scores of passages and rows, drawings, photos, further files, changes between versions, rendered documents."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions.facts import MASKED, fact_score, fact_score_sql
from gistmill.operators import documents as D
from gistmill.operators.cleaning import keyword_list, keyword_pattern
from gistmill.sources.tables import ship

# What counts in reports besides the facts of mail (name, pattern for Java and RE2, weight, whether it is hard).
REPORT_PATTERNS = (
    ("year date", r"(?i)\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)?[0-9]{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]?,?\s+(?:19|20)[0-9]{2}\b", 1, True),
    ("standard", r"\b(?:AS/NZS|AS|NZS|ISO|EN|BS|ASTM|AASHTO|AUSTROADS|MRTS|TfNSW|QA)\s?[A-Z]?[0-9]{2,5}\b", 2, True),
    ("unit", r"\b[0-9][0-9,.]*\s?(?:um|microns?|GPa|kN/m[23]?|kNm|kN[.]m|mg/(?:[lL]|kg)|ppm|dB|kW|kVA|MW)\b|\bpH\s?(?:of\s|=\s?)?[0-9]", 1, True),
    ("member", r"\b[0-9]{2,4}\s?(?:UB|UC|PFC|WB|WC|TFB|UBP|EA|UA)(?:\s?[0-9]{1,3}(?:[.][0-9])?)?\b|\b[0-9]{2,3}(?:[.][0-9])?\s?[xX]\s?[0-9]{2,3}(?:[.][0-9])?(?:\s?[xX]\s?[0-9]{1,2}(?:[.][0-9])?)?\s?(?:SHS|RHS|CHS|EA|UA)\b|\b(?:[0-9]{1,2}\s?-\s?)?N[1-3][0-9](?:\s?[-@]\s?[0-9]{2,3})?\b|\b(?:SL|RL)[0-9]{2,4}\b|\bM[1-3][0-9]\b", 2, True),
    ("size", r"\b[0-9]{2,5}\s?[xX]\s?[0-9]{2,5}(?:\s?[xX]\s?[0-9]{2,5})?\b", 1, True),
    ("ratio", r"\b(?:span|height|length|[LHlh])\s?/\s?[0-9]{2,4}\b|\b[0-9]+(?:[.][0-9]+)?\s?[VH]\s?:\s?[0-9]+(?:[.][0-9]+)?\s?[VH]\b|\b1\s?in\s?[0-9]{1,4}\b", 2, True),
    ("clause", r"(?i)\b(?:clause|cl|section|sect|condition|specification|spec)[.]?\s?[A-Z]?[0-9]{1,3}(?:[.][0-9]{1,3})*\b", 1, False),
    ("design", r"(?i)\bdesign(?:ed)? (?:for|life|loads?|speed|traffic|criteria|pressure|capacity|strength|cbr|flows?|storm|level|wind)\b", 1, False),
    ("requirement", r"(?i)\b(?:shall|must|required?|requirements?|is to be|are to be|minimum|maximum|not less than|not more than|no more than|at least|not (?:to )?exceed[a-z]*|no steeper|limited to|allowable)\b", 1, False),
    ("risk", r"(?i)\b(?:recommend[a-z]*|conclu[a-z]*|risks?|hazards?|unsuitable|not suitable|critical|non-?complian[a-z]*|fail(?:ure|ed|s)?|defects?|crack(?:s|ing|ed)?|settlement|corrosion|deteriorat[a-z]*|exceed[a-z]*|unacceptable|inadequate|insufficient|urgent[a-z]*|should|contaminat[a-z]*|asbestos|groundwater)\b", 1, False),
)


def report_score(text: Column) -> Column:
    """The fact score of a passage, plus up to two of each kind that matters in reports, plus 3 where any of these is a figure or reference."""
    masked = F.regexp_replace(F.coalesce(text, F.lit("")), MASKED, "~")
    counts = [(F.least(F.lit(2), F.regexp_count(masked, F.lit(p))), weight, hard) for _, p, weight, hard in REPORT_PATTERNS]
    found = reduce(add, [n for n, _, hard in counts if hard]) > 0
    return (F.coalesce(fact_score(text), F.lit(0)) + reduce(add, [n * w for n, w, _ in counts]) + F.when(found, 3).otherwise(0)).cast("long")


def report_score_sql(text: str) -> str:
    masked = f"regexp_replace(coalesce({text}, ''), '{MASKED}', '~', 'g')"
    parts = [(f"least(2, len(regexp_extract_all({masked}, '{p}')))", weight, hard) for _, p, weight, hard in REPORT_PATTERNS]
    found = " + ".join(n for n, _, hard in parts if hard)
    return f"CAST({fact_score_sql(text)} + {' + '.join(f'{n} * {w}' for n, w, _ in parts)} + CASE WHEN {found} > 0 THEN 3 ELSE 0 END AS BIGINT)"


# Cells that are figures, rows of totals, items' codes.
NUMBER_CELL = r"^[-+(]?[$£€]?\s?[0-9][0-9,]*(?:[.][0-9]+)?[)]?\s?%?[a-zA-Z]{0,3}$"
TOTAL_ROW = r"(?i)\b(?:sub-?)?totals?\b|\bgrand total\b"
ROW_CODE = r"^[A-Z]{1,4}[-. ]?[0-9]{1,5}[A-Za-z]?$"


def _cells(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r" \| "), lambda c: F.trim(c)), lambda c: c != "")


def row_scores(rows: DataFrame) -> DataFrame:
    """``doc_no, block_no, score, floor`` of table rows: twice the rarity, half a point a figure, one for money, 20 for totals; and the least that a row of
    a table with a header is worth: 3 and half a point a figure from two figures on, 4 if it begins with an item's code."""
    base = D.tables(rows).join(D.row_rarity(rows), ["doc_no", "block_no"])
    cells = _cells(F.col("text"))
    figures = F.size(F.filter(cells, lambda c: F.regexp_replace(c, r"^.*: ", "").rlike(NUMBER_CELL)))
    score = F.round(F.col("rarity") * 2 + figures * 0.5 + F.col("text").contains("$").cast("int") + F.when(F.col("text").rlike(TOTAL_ROW), 20).otherwise(0), 4)
    floor = F.greatest(F.when(figures >= 2, F.least(F.lit(3.0), figures * 0.5) + 3).otherwise(0.0), F.when(cells[0].rlike(ROW_CODE), 4.0).otherwise(0.0))
    return base.select("doc_no", "block_no", score.alias("score"), F.when(F.col("is_header") | (F.size(cells) < 3), 0.0).otherwise(floor).alias("floor"))


# Names of drawings and of documents.
DRAWING_CODE = r"(?:^|[ _.-])(?:ST|CI|CV|SK|DR|AR|EL|HY)[-_ ]?[0-9]{1,5}[A-Z]?(?:$|[ _.\[(-])|(?:^|[ _.-])[CSA][-_]?[0-9]{3,4}(?:$|[ _.\[(-])|[-_](?:ST|CI|CV|SK|DR|AR|EL|ME|HY|LA|GE|C|S|A|E|M|H)[-_][A-Z]{0,4}[0-9]"
DRAWING_WORD = r"(?i)(?:^|[^a-z])(?:dwgs?|drgs?|drawings?|sketch(?:es)?)(?:$|[^a-z])"
NO_DRAWING = r"(?i)(?:^|[^a-z])(?:report|memo|letter|minutes|specs?|specification|calcs?|calculations?|proposal|invoice|quote|quotation|rfi|transmittal|register|programme|program|certificate|checklist|swms|itp|fee|variation|claim|agenda|photos?)(?:$|[^a-z])"
REVISED = r"\[[A-Z]{1,2}[0-9]{0,2}\]|(?i:\brev(?:ision)?[ ._-]*[A-Z0-9]{1,3}\b)"


def drawing_name(name: Column) -> Column:
    """A name like a drawing's: a discipline's code and number, a word for drawings, or a revision beside a job number, unless it names a document."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[\\/]", ""), r"\.[^.]*$", "")
    return base.rlike(DRAWING_CODE) | ~base.rlike(NO_DRAWING) & (base.rlike(DRAWING_WORD) | base.rlike(REVISED) & F.regexp_replace(base, REVISED, "").rlike("[0-9]{3}"))


def is_drawing(name: Column, pages: Column, large: Column, prose: Column) -> Column:
    """Mostly A3 pages or larger that don't read like a document, or five pages or fewer under a drawing's name."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[\\/]", "")
    document = base.rlike(NO_DRAWING) & ~base.rlike(DRAWING_CODE) | F.coalesce(prose, F.lit(False))
    return F.coalesce(large, F.lit(False)) & ~document | F.coalesce(pages.between(1, 5), F.lit(False)) & drawing_name(name)


def table_row(line: Column) -> Column:
    """A line of a page that looks like a table's row: a figure, unit, date or revision at its end, and three numbers in it."""
    ends = line.rlike(r"(?:[0-9](?:[.,][0-9]+)?\s?(?:mm|m|m2|m3|kN|kPa|MPa|kg|t|%|days?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})[)]?$")
    return line.rlike(r"\b[A-Z0-9]{1,2}\s+A[0-4]$") | ends & (F.regexp_count(line, F.lit(r"(?:^|\s)[0-9]")) >= 3)


def prose_pages(lines: DataFrame) -> DataFrame:
    """``doc_no, prose``: whether most pages hold 300 characters of sentences that no other page has; ``lines``: ``doc_no, page, text``."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0))
    said = lines.select("doc_no", "page", F.trim("text").alias("text"), (F.size(words) >= 8).alias("long"), (F.size(F.filter(words, lambda w: w.rlike("^[a-z]"))) * 2 >= F.size(words)).alias("low"))
    pages = lines.groupBy("doc_no").agg(F.countDistinct("page").alias("pages"))
    said = said.where("long and low").groupBy("doc_no", "text").agg(F.countDistinct("page").alias("on"), F.min("page").alias("page"), F.count(F.lit(1)).alias("n")).join(pages, "doc_no")
    per_page = said.where("on = 1 or pages = 1").groupBy("doc_no", "page").agg(F.sum(F.length("text") * F.col("n")).alias("chars"))
    full = per_page.where("chars >= 300").groupBy("doc_no").agg(F.count(F.lit(1)).alias("full"))
    return pages.join(full, "doc_no", "left").select("doc_no", (F.coalesce("full", F.lit(0)) * 2 > F.col("pages")).alias("prose"))


# Labels of title blocks.
_LABEL = re.compile(r"^(?:project|client|scale|drawn|designed|checked|approved|date|sheet|size|rev(?:ision)?|status|job|drawing no|dwg no|title)\b", re.I)
_TITLE = re.compile(r"^(?:drawing |dwg |sheet )?title\s*[:\-]?\s*(.*)$", re.I)
_REVISION = re.compile(r"\brev(?:ision)?\.?\s*(?:no\.?)?\s*[:\-]?\s*([A-Z]{1,2}\d{0,2}|\d{1,2})\b", re.I)
_STATUS = re.compile(r"\b(?:not for construction|for construction|for tender|for approval|for review|for information|for coordination|for comment|preliminary|issued for [a-z]+)\b", re.I)


def title_block(texts: list[str], name: str = "") -> tuple[str, str, str]:
    """(title, revision, status) of a drawing; a revision in the file's name comes first, of several statuses the last one."""
    cells = [c.strip() for t in texts for c in t.split(" | ") if c.strip()]
    title = ""
    for k, cell in enumerate(cells):
        if m := _TITLE.match(cell):
            below = []
            for c in cells[k + 1 : k + 3]:
                if _LABEL.match(c) or not re.search(r"[A-Za-z]{3}", c):
                    break
                below.append(c)
            value = m[1].strip(" :-") or " ".join(below)
            if re.search(r"[A-Za-z]{3}", value):
                title = value[:120]
                break
    in_name = re.search(r"\[([A-Z]{1,2}\d{0,2})\]|\brev(?:ision)?[ ._-]*([A-Z0-9]{1,3})\b", name, re.I)
    rev = (in_name[1] or in_name[2]).upper() if in_name else next((m[1].upper() for c in reversed(cells) if len(c) <= 80 and (m := _REVISION.search(c))), "")
    status = [m[0].upper() for m in _STATUS.finditer(" ".join(cells))]
    return title, rev, status[-1] if status else ""


def title_blocks(doctexts: DataFrame) -> DataFrame:
    """``doc_no, title, revision, status`` of the drawings."""
    ship(doctexts.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [title_block([t or "" for t in texts], name or "") for texts, name in zip(frame.texts, frame.file_name)]
            yield pd.DataFrame([(d, *f) for d, f in zip(frame.doc_no, found)], columns=["doc_no", "title", "revision", "status"])

    rows = doctexts.where("drawing and blocks is not null").select("doc_no", "file_name", F.transform("blocks", lambda b: b["text"]).alias("texts"))
    return rows.mapInPandas(work, "doc_no long, title string, revision string, status string")


def photo_groups(rows: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """``by..., prefix, photos, label`` of ``by..., file_name``: photos of one prefix as their numbers, as a range if there are more than ``most`` and none is missing."""
    name = F.regexp_replace("file_name", r"\s*\([0-9]+\)(\.[^.]+)$", "$1")
    parts = rows.select(*by, F.regexp_extract(name, r"^(.*?)([0-9]+)\.[^.]+$", 1).alias("prefix"), F.regexp_extract(name, r"^(.*?)([0-9]+)\.[^.]+$", 2).alias("digits")).where("digits != ''")
    parts = parts.withColumn("number", F.col("digits").cast("decimal(30,0)"))
    grouped = parts.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("photos"), F.array_sort(F.collect_set(F.struct("number", "digits"))).alias("n"))
    digits = F.transform("n", lambda x: x["digits"])
    whole = (F.size("n") > most) & (F.element_at("n", -1)["number"] - F.element_at("n", 1)["number"] + 1 == F.size("n"))
    label = F.concat("prefix", F.when(whole, F.concat(F.element_at(digits, 1), F.lit("-"), F.element_at(digits, -1))).otherwise(F.array_join(digits, ",")))
    return grouped.select(*by, "prefix", "photos", label.alias("label"))


def other_files(rows: DataFrame, most: int = 6) -> DataFrame:
    """``folder, ext, files, images, in_one_line`` of ``path``: files of a folder share a line if there are more than ``most`` or two images."""
    parts = rows.select(F.regexp_extract("path", r"^(.*)[\\/]", 1).alias("folder"), F.lower(F.regexp_extract("path", r"(\.[^.\\/]+)$", 1)).alias("ext"))
    per_kind = parts.groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("ext").isin(".jpg", ".jpeg", ".png", ".heic", ".gif", ".bmp", ".tif", ".tiff")).alias("images"))
    folders = per_kind.groupBy("folder").agg(F.sum("files").alias("all_files"), F.sum("images").alias("all_images"))
    return per_kind.join(folders, "folder").select("folder", "ext", "files", "images", ((F.col("all_files") > most) | (F.col("all_images") >= 2)).alias("in_one_line"))


def size_text(size: Column) -> Column:
    """Bytes as people read them; empty for NULL and negative ones."""
    return (
        F.when(size.isNull() | (size < 0), "").when(size >= 1 << 20, F.format_string("%.1f MB", size / F.lit(1048576.0)))
        .when(size >= 1024, F.concat(F.round(size / 1024.0).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(size.cast("long").cast("string"), F.lit(" bytes")))
    )


def token_estimate(chars: Column) -> Column:
    return F.round(chars / 3.5).cast("long")


def continued_headings(rows: DataFrame) -> DataFrame:
    """``doc_no, block_no`` of headings that only go on with the last one: the same text with ``(continued)``, ``cont'd`` and the like."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s*[(\[]?\b(?:continued|cont'?d|cont\.)[)\]]?\s*$", ""))
    heads = rows.where("block_type = 'heading'").withColumn("before", F.lag("text").over(D.by_document()))
    return heads.where((bare(F.col("text")) != F.lower("text")) & (bare(F.col("text")) == bare(F.col("before")))).select("doc_no", "block_no")


def rejoined(texts: list[str]) -> list[str]:
    """Lines of pages as paragraphs: a line without an end goes on with one that starts in lower case; a hyphen at the break is taken out."""
    out: list[str] = []
    for text in texts:
        if out and text[:1].islower() and not re.search(r"[.!?:;]$", out[-1]) and " | " not in out[-1] + text:
            out[-1] = out[-1][:-1] + text if re.search(r"[a-z]-$", out[-1]) else f"{out[-1]} {text}"
        else:
            out.append(text)
    return out


def fact_pieces(text: str, size: int = 240) -> list[str]:
    """Sentences; those above ``size`` cut at items, then at clauses."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9•])", text):
        parts = [sentence]
        for cut in (r"(?= • )", r"(?<=;)\s+", r"(?<=,)\s+"):
            parts = [x for p in parts for x in (re.split(cut, p) if len(p) > size else [p])]
        joined: list[str] = []
        for p in parts:
            if joined and len(joined[-1]) + len(p) + 1 <= size and len(sentence) > size:
                joined[-1] += " " + p
            else:
                joined.append(p)
        out += [p.strip() for p in joined if p.strip()]
    return out


def document_sources(emails: DataFrame, seconds: str = "utc_s") -> DataFrame:
    """``sha1, sources``: with which messages a document came, each minute, sender and thread once, in order."""
    rows = emails.select(F.explode("attachments").alias("a"), F.floor(F.col(seconds) / 60).alias("minute"), F.lower(F.coalesce("sender_email", F.lit(""))).alias("sender"), "thread").where("a.sha1 is not null")
    return rows.groupBy(F.col("a.sha1").alias("sha1")).agg(F.array_sort(F.collect_set(F.struct("minute", "sender", "thread"))).alias("sources"))


def focus_documents(doctexts: DataFrame, keywords: str, shown: DataFrame | None = None) -> DataFrame:
    """``doc_no`` of documents with a keyword in their name or text, or whose ``sha1`` the mail digest shows."""
    words = [keyword_pattern(k) for k in keyword_list(keywords)]
    text = F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.array_join(F.transform(F.coalesce("blocks", F.array()), lambda b: F.coalesce(b["text"], F.lit(""))), " "))
    hit = reduce(lambda a, b: a | b, [F.lower(text).rlike(w) for w in words], F.lit(False))
    rows = doctexts.where(hit).select("doc_no")
    return rows if shown is None else rows.unionByName(doctexts.join(shown.select("sha1").distinct(), "sha1", "left_semi").select("doc_no")).distinct()


def configured_codes(domains: DataFrame, settings: list[tuple[str, str]]) -> DataFrame:
    """``domain, code``: the code of the first setting that is the domain or lies above it; ``settings`` are a user's few lines."""
    code = reduce(lambda rest, s: F.when((F.lower("domain") == s[0]) | F.lower("domain").endswith("." + s[0]), s[1]).otherwise(rest), reversed(settings), F.lit(None).cast("string"))
    return domains.select("domain", code.alias("code"))


def member_matches(members: DataFrame, files: DataFrame) -> DataFrame:
    """``name, member, same_as``: members of archives whose content a document of its own has; an equi-join on the content's hash."""
    known = files.groupBy("sha1").agg(F.min("name").alias("same_as"))
    return members.join(known, "sha1", "left").select("name", "member", "same_as")


def partly_read(doctexts: DataFrame) -> DataFrame:
    """``doc_no, partly``: whether a note, a cut sheet or a hidden part says that not all of a document was read."""
    cut = F.exists(F.coalesce("blocks", F.array()), lambda b: (b["block_type"] == "sheet") & F.coalesce(b["hidden"], F.lit(False)))
    return doctexts.select("doc_no", (F.coalesce(F.lower("note").rlike("part|first|limit|scan|too "), F.lit(False)) | cut).alias("partly"))


def incomplete_reason(files: int, read: int, unreadable: int, unreachable: int) -> str:
    """Why a run can't replace an earlier one, or nothing."""
    if unreachable:
        return f"{unreachable} folders could not be opened"
    if files and unreadable * 2 > files:
        return f"{unreadable} of {files} files could not be read"
    return "" if read or not files else "nothing was read"


def aligned(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with the same unit, rising on both sides: units that are unique on both sides anchor (the longest rising run of them), and
    equal neighbours of anchors join them. Near linear in the number of units."""
    count_old, count_new = Counter(old), Counter(new)
    place = {u: k for k, u in enumerate(old) if count_old[u] == 1}
    pairs = sorted((place[u], k) for k, u in enumerate(new) if u in place and count_new[u] == 1)
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, k) in enumerate(pairs):
        at = bisect_left(tails, k)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(k)
            ends.append(n)
        else:
            tails[at], ends[at] = k, n
    run = []
    n = ends[-1] if ends else -1
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    found = set(run)
    for step in (1, -1):
        for i, j in run if step == 1 else run[::-1]:
            i, j = i + step, j + step
            while 0 <= i < len(old) and 0 <= j < len(new) and old[i] == new[j] and (i, j) not in found:
                found.add((i, j))
                i, j = i + step, j + step
    out: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if not out or i > out[-1][0] and j > out[-1][1]:
            out.append((i, j))
    # what both sides begin or end with belongs together without any anchor, too
    if not out:
        k = next((k for k, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
        out = [(x, x) for x in range(k)]
    return out


def _words(text: str) -> Counter:
    return Counter(re.findall(r"\w+", text.lower()))


def similarity(old: list[str], new: list[str], pairs: list[tuple[int, int]]) -> float:
    """Share of characters that both sides have: of aligned units all, of the others as many as the words that both rests have."""
    total = sum(map(len, old)) + sum(map(len, new))
    if not total:
        return 1.0
    same = sum(len(old[i]) + len(new[j]) for i, j in pairs)
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    rest_old, rest_new = [u for k, u in enumerate(old) if k not in left], [u for k, u in enumerate(new) if k not in right]
    a, b = _words(" ".join(rest_old)), _words(" ".join(rest_new))
    if a and b:
        same += 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) * (sum(map(len, rest_old)) + sum(map(len, rest_new)))
    return same / total


def _unnumbered(text: str) -> str:
    return re.sub(r"^\s*(?:\d+(?:\.\d+)*|[A-Za-z]|[ivx]+)[.)]?\s+", "", text)


def word_changes(old: str, new: str) -> str:
    """The new passage with what is gone in ``[-...-]`` and what is new in ``{+...+}``, or ``""`` where half of it or more changed."""
    a, b = old.split(), new.split()
    pairs = aligned(a, b)
    if len(pairs) * 2 <= max(len(a), len(b)):
        return ""
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        if i < x:
            out.append("[-" + " ".join(a[i:x]) + "-]")
        if j < y:
            out.append("{+" + " ".join(b[j:y]) + "+}")
        if y < len(b):
            out.append(b[y])
        i, j = x + 1, y + 1
    return " ".join(out)


def change_lines(old: list[str], new: list[str]) -> tuple[float, list[str]]:
    """(similarity, lines): ``-`` gone, ``+`` new, ``~`` changed within a passage or a row with the same first cell. Headings that were only renumbered are no change."""
    pairs = aligned(old, new)
    lines: list[str] = []
    i, j = 0, 0
    for x, y in [*pairs, (len(old), len(new))]:
        gone, come = old[i:x], new[j:y]
        first = lambda u: u.split(" | ")[0].strip() if " | " in u else ""
        by_first: dict[str, list[str]] = {}
        for u in gone:
            by_first.setdefault(first(u), []).append(u)
        twice = Counter(map(first, come))
        bare = {_unnumbered(u) for u in gone}
        used: set[str] = set()
        told_new: list[str] = []
        for u in come:
            key = first(u)
            if _unnumbered(u) in bare and u not in gone:
                used |= {g for g in gone if _unnumbered(g) == _unnumbered(u)}
            elif key and twice[key] == 1 and len(by_first.get(key, [])) == 1:
                before, after = by_first[key][0].split(" | "), u.split(" | ")
                cells = [f"{b} -> {c}" if b != c else c for b, c in zip(before, after)] + after[len(before) :]
                told_new.append("~ " + " | ".join(cells))
                used.add(by_first[key][0])
            elif len(gone) == len(come) and (told := word_changes(gone[come.index(u)], u)):
                told_new.append("~ " + told)
                used.add(gone[come.index(u)])
            else:
                told_new.append("+ " + u)
        lines += ["- " + u for u in gone if u not in used] + told_new
        i, j = x + 1, y + 1
    return similarity(old, new, pairs), lines


def documents_digest(doctexts: DataFrame, budget: int = 2_500, least: float = 0.6) -> DataFrame:
    """``doc_no, text`` of every document file: a line of name, kind, pages and note; drawings with title, revision and status; the same text as an earlier one
    by reference; a later version by its changes; others by the blocks they show."""
    rows = doctexts.select("doc_no", "file_name", "kind", "status", "note", "title", "pages", "drawing", "chars")
    chosen = D.chosen_blocks(doctexts, budget).join(D.blocks(doctexts), ["doc_no", "block_no"])
    repeated = D.repeats(D.blocks(doctexts)).where("nth > 1").select("doc_no", "block_no")
    repeated = repeated.unionByName(continued_headings(D.blocks(doctexts)))
    chosen = chosen.join(repeated, ["doc_no", "block_no"], "left_anti")
    mark = F.when(F.col("block_type") == "heading", F.concat(F.lit("# "), F.col("text"))).when(F.col("block_type") == "item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    shown = chosen.where("text != ''").groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("block_no", mark.alias("line")))).alias("b")).select("doc_no", F.array_join("b.line", "\n").alias("body"))
    same = D.same_texts(D.blocks(doctexts))
    changes = D.version_changes(doctexts, least).where("size(changes) > 0").select("doc_no", "previous", F.substring(F.array_join("changes", "\n"), 1, budget).alias("changed"))
    drawn = title_blocks(doctexts).select("doc_no", F.col("title").alias("d_title"), "revision", "status").withColumnRenamed("status", "d_status")
    rows = rows.join(same, "doc_no", "left").join(changes, "doc_no", "left").join(drawn, "doc_no", "left").join(shown, "doc_no", "left")
    pages = F.when(F.col("pages") > 1, F.concat(F.col("pages").cast("string"), F.lit(" pages"))).when(F.col("pages") == 1, "1 page")
    head = F.concat(F.lit("## D"), F.col("doc_no").cast("string"), F.lit(" "), F.concat_ws("; ", F.coalesce("file_name", F.lit("unnamed")), pages, F.when(F.col("status") != "ok", F.col("status")), F.nullif("note", F.lit(""))))
    drawing = F.concat(F.lit("Drawing: "), F.concat_ws("; ", F.nullif(F.coalesce("d_title", "title"), F.lit("")), F.when(F.col("revision") != "", F.concat(F.lit("rev "), F.col("revision"))), F.nullif("d_status", F.lit(""))))
    body = (
        F.when(F.col("same_as").isNotNull(), F.concat(F.lit("Same text as D"), F.col("same_as").cast("string"))).when(F.coalesce("drawing", F.lit(False)), drawing)
        .when(F.col("changed").isNotNull(), F.concat(F.lit("Changes from D"), F.col("previous").cast("string"), F.lit(":\n"), F.col("changed"))).otherwise(F.coalesce("body", F.lit("")))
    )
    return rows.select("doc_no", F.concat_ws("\n", head, F.nullif(body, F.lit(""))).alias("text"))
