"""Passes over extracted documents: blocks as rows, sections, tables, repeats, boilerplate, versions, differences, budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions.facts import MASKED, PATTERNS, fact_score
from gistmill.sources.tables import ship


def blocks(doctexts: DataFrame) -> DataFrame:
    """``doc_no, block_no, block_type, text, level, n_rows`` of every block of the documents that could be read; texts are never NULL."""
    rows = doctexts.where("status = 'ok'").select("doc_no", F.posexplode("blocks").alias("block_no", "b"))
    return rows.select("doc_no", F.col("block_no").cast("long").alias("block_no"), "b.block_type", F.coalesce("b.text", F.lit("")).alias("text"), F.col("b.block_level").alias("level"), "b.n_rows")


def paragraph_key(text: Column) -> Column:
    """Letters and digits only, lower case: what makes two paragraphs the same."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def shape(text: Column) -> Column:
    """Lower case with runs of digits masked."""
    return F.regexp_replace(F.lower(text), r"[0-9]+", "#")


def by_document():
    """The blocks of a document in order."""
    return Window.partitionBy("doc_no").orderBy("block_no")


def sections(rows: DataFrame) -> DataFrame:
    """Blocks with ``section`` (number of headings so far) and ``heading`` (the last one)."""
    head = F.when(F.col("block_type") == "heading", F.col("text"))
    so_far = by_document().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"section": F.count(head).over(so_far), "heading": F.last(head, ignorenulls=True).over(so_far)})


def tables(rows: DataFrame) -> DataFrame:
    """Row blocks with ``table_no`` (runs of rows), ``row_no``, and ``is_header``: the first row, or up to three while they have one cell."""
    is_row = F.col("block_type") == "row"
    starts = (is_row & (F.coalesce(F.lag("block_type").over(by_document()), F.lit("")) != "row")).cast("long")
    rows = rows.withColumn("_start", starts).withColumn("table_no", F.sum("_start").over(by_document())).where(is_row)
    inside = Window.partitionBy("doc_no", "table_no").orderBy("block_no")
    one_cell = (~F.col("text").contains(" | ")).cast("int")
    all_single = F.min(one_cell).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("row_no", F.row_number().over(inside).cast("long"))
    return rows.withColumn("is_header", (F.col("row_no") == 1) | ((F.col("row_no") <= 3) & (F.coalesce(all_single, F.lit(1)) == 1))).drop("_start")


def row_rarity(rows: DataFrame) -> DataFrame:
    """``doc_no, block_no, rarity``: for each table row the sum over filled cells of 1 / rows of its table that have the same value there."""
    cells = tables(rows).select("doc_no", "table_no", "block_no", F.posexplode(F.split("text", r" \| ")).alias("column_no", "cell")).where(F.trim("cell") != "")
    value = Window.partitionBy("doc_no", "table_no", "column_no", F.lower(F.trim("cell")))
    weighed = cells.withColumn("share", F.lit(1.0) / F.count(F.lit(1)).over(value))
    return weighed.groupBy("doc_no", "block_no").agg(F.round(F.sum("share"), 6).alias("rarity"))


def repeats(rows: DataFrame, least: int = 30) -> DataFrame:
    """``doc_no, block_no, nth, first_doc``: which appearance of its text in the document a long block is, and in which document it stood first."""
    keyed = rows.select("doc_no", "block_no", paragraph_key(F.col("text")).alias("key")).where(F.length("key") >= least)
    nth = F.row_number().over(Window.partitionBy("doc_no", "key").orderBy("block_no")).cast("long")
    first = keyed.groupBy("key").agg(F.min("doc_no").alias("first_doc"))
    return keyed.withColumn("nth", nth).join(first, "key").select("doc_no", "block_no", "nth", "first_doc")


def damped_scores(rows: DataFrame, most: int = 6) -> DataFrame:
    """``doc_no, block_no, score``: fact scores; a shape that more than ``most`` blocks of a document share is scaled by ``most`` over their number."""
    scored = rows.select("doc_no", "block_no", fact_score(F.col("text")).alias("raw"), shape(F.col("text")).alias("shape"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_no", "shape"))
    return scored.select("doc_no", "block_no", F.round(F.when(n > most, F.col("raw") * F.lit(float(most)) / n).otherwise(F.col("raw").cast("double")), 6).alias("score"))


def folded_headings(rows: DataFrame, least: int = 3) -> DataFrame:
    """``doc_no, shape, headings, first_block``: headings of a document that differ in numbers only, at least ``least`` of them."""
    heads = rows.where("block_type = 'heading'").select("doc_no", "block_no", shape(F.col("text")).alias("shape"))
    return heads.groupBy("doc_no", "shape").agg(F.count(F.lit(1)).alias("headings"), F.min("block_no").alias("first_block")).where(F.col("headings") >= least)


# The wording of covers, copyright, limits of liability and contacts; each strong or weak pattern counts once.
STRONG = (
    r"(?i)all rights reserved|copyright of this (?:document|report|drawing)", r"(?i)(?:prepared|produced) (?:solely |only |exclusively )?(?:for|on behalf of) (?:the )?(?:use of|client)",
    r"(?i)(?:no|any) (?:other )?(?:third part(?:y|ies)|person) (?:may|shall|can|should) (?:rely|use)|not (?:be )?rel(?:y|ied) (?:up)?on by", r"(?i)without (?:the )?(?:prior )?(?:written|express) (?:consent|permission|approval)",
    r"(?i)accepts? no (?:liability|responsibility|duty)|strictly confidential|nutzungsrechte vorbehalten|tous droits r.serv.s",
)
WEAK = (r"(?i)\bconfidential\b|vertraulich", r"(?i)\bcopyright\b", r"(?i)\bliabilit|haftung", r"(?i)disclaim", r"(?i)\bproprietary\b|intellectual property", r"(?i)\breliance\b|\bthird part(?:y|ies)\b", r"(?i)\bindemnif")
PARTY = r"\b(?:Sub-?contractor|Contractor|Sub-?consultant|Consultant|Client|Principal|Superintendent|Engineer|Owner|Purchaser|Supplier|Vendor|Employer|Proprietor)s?\b"
DUTY = r"(?i)\b(?:shall|must|agrees? to|(?:is|are) liable)\b"
ABOUT = r"(?i)\bthis (?:report|document|drawing|letter|certificate|proposal)\b"
CONTACT = r"(?i)\babn:?\s*[0-9]|\bacn:?\s*[0-9]|\bwww[.]|[a-z0-9_.-]+@[a-z0-9_-]+[.][a-z0-9_.]+|\b(?:tel|ph|phone|fax|mob|mobile)\s*[:.]\s*[+]?[(]?[0-9](?:[\s().-]*[0-9]){7}|\bp[.]?o[.]? box\b"
BOILER_HEAD = r"(?i)^(?:[0-9]{1,2}(?:[.][0-9]{1,2})*[.]?\s+|appendix\s+[a-z0-9]{1,3}\s*[:.-]?\s*)?(?:(?:statement of |report |general )?limitations?(?: of (?:this report|use))?|disclaimers?|copyright(?: notice)?|reliance|basis of (?:this )?report|confidentiality|terms of use)\s*:?$|^(?:appendix\s+[a-z0-9]{1,3}\s*[:.-]?\s*)?important (?:information|notice)\b"
HARD = PATTERNS[0][1] + "|" + PATTERNS[1][1] + "|" + PATTERNS[2][1] + "|" + PATTERNS[3][1] + "|" + PATTERNS[4][1]


def is_boilerplate(text: Column, in_section: Column, near_cover: Column) -> Column:
    """Cover, copyright, liability and contact wording; a clause on a party's duty is none, and under a heading of limitations all without a figure is."""
    hard = F.regexp_replace(text, MASKED, "~").rlike(HARD)
    clause = text.rlike(PARTY) & text.rlike(DUTY) & ~text.rlike(ABOUT)
    strong, weak = (sum((text.rlike(p).cast("int") for p in patterns), F.lit(0)) for patterns in (STRONG, WEAK))
    contact = F.regexp_count(text, F.lit(CONTACT))
    told = (strong + weak >= 3) | (strong > 0) & (strong + weak >= 2) & ~hard | (strong > 0) & near_cover & ~hard & (F.length(text) < 600)
    reached = (contact >= 2) & (F.length(text) < 300) | (contact > 0) & (F.length(text) < 120) & ~hard
    return in_section & ~hard | ~clause & (told | reached)


def boilerplate(rows: DataFrame) -> DataFrame:
    """``rows`` with ``is_boilerplate``: of paragraphs and items, by the heading above them and how near the start or end they are."""
    last = F.last(F.when(F.col("block_type") == "heading", F.col("text").rlike(BOILER_HEAD)), ignorenulls=True).over(by_document().rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("doc_no").agg(F.max("block_no").alias("_last"))
    rows = rows.withColumn("_in", F.coalesce(last, F.lit(False))).join(ends, "doc_no")
    near = (F.col("block_no") < 12) | (F.col("block_no") > F.col("_last") - 6)
    says = F.col("block_type").isin("para", "item", "text") & is_boilerplate(F.col("text"), F.col("_in"), near)
    return rows.withColumn("is_boilerplate", says).drop("_in", "_last")


def page_capped(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with ``page`` marks as blocks of their own) up to a page; what is left out is told by :func:`gistmill.operators.reports.partly_read`."""
    page = F.max(F.when(F.col("block_type") == "page", F.col("text").try_cast("int"))).over(by_document().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_page", F.coalesce(page, F.lit(1))).where(F.col("_page") <= limit).drop("_page")


def contents_lists(rows: DataFrame) -> DataFrame:
    """``doc_no, block_no`` of lines of tables of contents: runs of three or more lines that end in page numbers which never fall."""
    page = F.regexp_extract("text", r"^\S.*?[ .\t]{2,}(\d{1,4})\s*$", 1).try_cast("int")
    lines = rows.select("doc_no", "block_no", page.alias("page"))
    breaks = (F.col("page").isNull() | F.lag("page").over(by_document()).isNull() | (F.col("page") < F.lag("page").over(by_document()))).cast("int")
    runs = lines.withColumn("_b", breaks).withColumn("run", F.sum("_b").over(by_document())).where("page is not null")
    return runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_no", "run"))).where("n >= 3").select("doc_no", "block_no")


def family_key(name: Column) -> Column:
    """A file name without extension, copy and revision marks, dates and punctuation: what versions of a document share."""
    key = F.regexp_replace(F.lower(name), r"\.[a-z0-9]{1,5}$", "")
    for pattern in (r"^(?:copy of|kopie von|copie de) ", r"[ _-]*(?:rev|v|version)[ ._-]?[a-z0-9]{1,3}$", r"[ _-]*\(?(?:draft|final|signed|entwurf|copy)\)?$", r"\d{4}-\d{2}-\d{2}|\d{8}", r"[^\p{L}\p{N}]+"):
        key = F.regexp_replace(key, pattern, "")
    return key


def revision(name: Column) -> Column:
    """(class, text) that sorts revisions: P first, then letters, then numbers; NULL without one."""
    mark = F.upper(F.regexp_extract(name, r"(?i)(?:rev|version|v)[ ._-]?([a-z]{1,2}\d{0,2}|\d{1,3})(?:\.[a-z0-9]+)?$", 1))
    rank = F.when(mark == "", None).when(mark.startswith("P"), 0).when(mark.rlike("^[A-Z]"), 1).otherwise(2)
    return F.when(rank.isNotNull(), F.struct(rank.alias("class"), F.lpad(mark, 6, "0").alias("mark")))


def versions(doctexts: DataFrame) -> DataFrame:
    """``doc_no, family, version_no, previous``: the documents of a family and kind in order of revision, date and number."""
    named = doctexts.where("status = 'ok'").select("doc_no", "kind", family_key(F.coalesce("file_name", F.lit(""))).alias("family"), revision(F.col("file_name")).alias("revision"), "added_at")
    order = Window.partitionBy("family", "kind").orderBy(F.col("revision").asc_nulls_first(), "added_at", "doc_no")
    return named.where("family != ''").select("doc_no", "family", F.row_number().over(order).cast("long").alias("version_no"), F.lag("doc_no").over(order).alias("previous"))


def same_texts(rows: DataFrame) -> DataFrame:
    """``doc_no, same_as``: documents whose sequence of texts an earlier one has."""
    ordered = rows.groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    marked = ordered.select("doc_no", F.md5(F.array_join("b.text", "\n")).alias("mark"))
    first = marked.groupBy("mark").agg(F.min("doc_no").alias("same_as"))
    return marked.join(first, "mark").where("doc_no != same_as").select("doc_no", "same_as")


def units(texts: list[str]) -> list[str]:
    """Sentences, rows and headings as the units of a comparison."""
    return [u for t in texts for u in re.split(r"(?<=[.!?])\s+", t) if u.strip()]


def version_changes(doctexts: DataFrame, least: float = 0.6) -> DataFrame:
    """``doc_no, previous, similarity, changes`` of each version that is similar enough to the one before it."""
    from gistmill.operators.reports import change_lines

    ship(doctexts.sparkSession)
    texts = blocks(doctexts).groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b")).select("doc_no", F.col("b.text").alias("texts"))
    pairs = versions(doctexts).where("previous is not null").select("doc_no", "previous")
    pairs = pairs.join(texts, "doc_no").join(texts.select(F.col("doc_no").alias("previous"), F.col("texts").alias("old")), "previous")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                similarity, lines = change_lines(units(list(r.old)), units(list(r.texts)))
                if similarity >= least:
                    out.append((r.doc_no, r.previous, round(similarity, 4), lines))
            yield pd.DataFrame(out, columns=["doc_no", "previous", "similarity", "changes"])

    return pairs.select("doc_no", "previous", "old", "texts").mapInPandas(work, "doc_no long, previous long, similarity double, changes array<string>")


def cut_at(text: str, limit: int) -> str:
    """At most ``limit`` characters, cut at the end of a sentence, else of a clause, else of a word."""
    if len(text) <= limit:
        return text
    head = text[:limit]
    for pattern in (r".*[.!?](?=\s|$)", r".*[;,:](?=\s|$)", r".*(?=\s)"):
        if (m := re.match(pattern, head, re.S)) and m.end() > limit // 3:
            return m.group(0).rstrip() + " …"
    return head.rstrip() + " …"


PIECE = re.compile(r"(?<=[.!?])\s+|\n+")


def fact_weight(piece: str) -> int:
    """Facts of a sentence, as :func:`gistmill.functions.facts.fact_score` counts them."""
    masked = re.sub(MASKED, "~", piece)
    counts = [min(most, len(re.findall(pattern, masked))) * weight for _, pattern, weight, most in PATTERNS]
    return sum(counts) + 3 * (sum(counts[:5]) > 0)


# How a sentence begins whose subject stands in the one before it.
REFERS_BACK = re.compile(r"(?:this|these|that|those|it|they|which|such|the (?:same|latter|former|above))\b", re.I)


class _Choice:
    """The pieces chosen so far, and how long they are with their gaps; a piece is added at the cost of its neighbours' joints."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.taken, self.size = pieces, [False] * len(pieces), 0

    def cost(self, k: int) -> int:
        """What a piece adds: itself, and a blank or a gap mark for each side."""
        left, right = k > 0 and self.taken[k - 1], k + 1 < len(self.pieces) and self.taken[k + 1]
        return len(self.pieces[k]) + (3 if not left and not right else 1 if left != right else -1)

    def take(self, k: int, limit: int) -> bool:
        if self.taken[k]:
            return True
        cost = self.cost(k)
        if self.size + cost > limit:
            return False
        self.taken[k], self.size = True, self.size + cost
        return True

    def text(self) -> str:
        out, last = "", -1
        for k, piece in enumerate(self.pieces):
            if self.taken[k]:
                out += ("" if not out else " " if last == k - 1 else " … ") + piece
                last = k
        return out + (" …" if last < len(self.pieces) - 1 else "")


def cap_text(text: str, limit: int, opening: float = 0.4, seen: tuple[str, ...] = ()) -> str:
    """The opening, then the sentences with most facts, in their order, within ``limit`` and two characters; gaps are marked.

    A sentence that refers back brings the one before it; long ones that ``seen`` texts hold are left out. Linear but for sorting.
    """
    if len(text) <= limit:
        return text
    pieces = [p for p in PIECE.split(text) if p]
    if len(pieces) < 2 or len(pieces[0]) > limit:
        return cut_at(text, max(limit - 2, 1))
    choice = _Choice(pieces)
    choice.take(0, limit)
    for k in range(1, len(pieces)):
        if not choice.take(k, int(limit * opening)):
            break
    weights = [fact_weight(p) for p in pieces]
    again = [len(p) >= 30 and any(p in s for s in seen) for p in pieces]
    for k in sorted((k for k in range(1, len(pieces)) if weights[k] > 0 and not again[k]), key=lambda k: (-weights[k], k)):
        back = REFERS_BACK.match(pieces[k]) and not choice.taken[k - 1]
        if back and choice.size + len(pieces[k]) + len(pieces[k - 1]) + 4 > limit:
            continue
        if choice.take(k, limit) and back:
            choice.take(k - 1, limit)
    for k in range(1, len(pieces)):
        if not again[k] and not choice.take(k, limit):
            break
    out = choice.text()
    return out if len(out) <= limit + 2 else cut_at(text, max(limit - 2, 1))


def cap_with_replies(text: str, replies: str, limit: int, seen: tuple[str, ...] = ()) -> str:
    """A text and the answers between the lines of its quote, together near ``limit``; the label and its bracket always survive."""
    if not replies:
        return cap_text(text, limit, seen=seen)
    room = max(limit - len(" [inline replies: ]"), 100)
    text = cap_text(text, max(room - len(replies), room // 2), seen=seen)
    return f"{text} [inline replies: {cap_text(replies, max(room - len(text), room // 2))}]".strip()


def capped(rows: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key, capped`` of each row; NULL stays NULL."""
    ship(rows.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "capped": [None if t is None else cap_text(t, limit) for t in frame[text]]})

    return rows.select(key, text).mapInPandas(work, f"{key} {rows.schema[key].dataType.simpleString()}, capped string")


def chosen_blocks(doctexts: DataFrame, budget: int = 2500, heads: float = 0.2, opening: float = 0.25) -> DataFrame:
    """``doc_no, block_no`` of the blocks that a document shows within ``budget`` characters.

    Sheet names always; headings by level within their share; the opening in order within its share; then the rest by
    score, then in order until one does not fit. A block costs its length and three.
    """
    rows = blocks(doctexts)
    rows = rows.join(damped_scores(rows), ["doc_no", "block_no"])
    packed = rows.groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_type", F.length("text").alias("size"), "level", "score"))).alias("b"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, b in zip(frame.doc_no, frame.b):
                kept, used = set(), 0

                def take(x, most: float) -> bool:
                    nonlocal used
                    if x["block_no"] in kept:
                        return True
                    if used + x["size"] + 3 > most:
                        return False
                    kept.add(x["block_no"])
                    used += x["size"] + 3
                    return True

                for x in b:
                    if x["block_type"] == "sheet":
                        take(x, float("inf"))
                for x in sorted((x for x in b if x["block_type"] == "heading"), key=lambda x: (x["level"], x["block_no"])):
                    take(x, budget * heads)
                for x in (x for x in b if x["block_type"] not in ("heading", "sheet", "row")):
                    if not take(x, budget * (heads + opening)):
                        break
                for x in sorted((x for x in b if x["score"] > 0), key=lambda x: (-x["score"], x["block_no"])):
                    take(x, budget)
                for x in b:
                    if not take(x, budget):
                        break
                out += [(doc, k) for k in sorted(kept)]
            yield pd.DataFrame(out, columns=["doc_no", "block_no"])

    return packed.mapInPandas(work, "doc_no long, block_no long")
