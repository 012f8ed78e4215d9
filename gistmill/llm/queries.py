"""Queries of the operators on text, and SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.llm.conversations import conversations
from gistmill.llm.encode_corpus import encode_corpus
from gistmill.llm.mixing import mix
from gistmill.llm.name_variants import same_entity_pairs
from gistmill.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from gistmill.llm.own_words import lines_taken_off, own_lines
from gistmill.llm.splitting import split_texts
from gistmill.llm.wrong_charset import wrong_fields
from gistmill.sources.tables import staged, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_fields(table(spark, sf_dir, "emails")).select("idx", "field")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that were found, as they were written as far as that can be had."""
    return wrong_fields(table(spark, sf_dir, "emails"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_lines(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes"))


def p3_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines marks and automata take off."""
    return lines_taken_off(table(spark, sf_dir, "emails"), table(spark, sf_dir, "mailboxes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "doctexts"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of equal sets and its number of partners."""
    return near_duplicate_classes(table(spark, sf_dir, "doctexts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entity_pairs(table(spark, sf_dir, "person_obs"), table(spark, sf_dir, "emails"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents of each plan with their number of uses."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the plans reach."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the texts above each profile's limit."""
    profiles = [tuple(r) for r in table(spark, sf_dir, "split_limits").select("profile", "tokenizer", "max_tokens", "overlap_tokens").collect()]
    return split_texts(table(spark, sf_dir, "documents"), profiles)


def p10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each profile: texts, characters that pieces or whole texts cover, pieces above the limit, and neighbours that share nothing though they should."""
    limits = table(spark, sf_dir, "split_limits").select("profile", "max_tokens", "overlap_tokens")
    texts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"))
    pieces = staged(p10_pieces(spark, sf_dir).drop("piece"), "pieces")
    # a piece adds what lies behind all pieces before it; pieces of one text are in order
    text = Window.partitionBy("profile", "doc_id")
    pieces = pieces.withColumn("reached", F.coalesce(F.max("end_char").over(text.orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = pieces.join(F.broadcast(limits), "profile")
    per_text = pieces.groupBy("profile", "doc_id").agg(
        F.sum(F.when(F.col("start_char") <= F.col("reached"), F.col("end_char") - F.col("reached")).otherwise(F.col("end_char") - F.col("start_char"))).alias("covered"),
        F.count_if(F.col("n_tokens") > F.col("max_tokens")).alias("too_large"),
        F.count_if((F.col("overlap_tokens") > 0) & (F.col("piece_no") > 1) & (F.col("start_char") >= F.col("reached"))).alias("sharing_nothing"),
    )
    profiles = [r[0] for r in limits.select("profile").collect()]  # a few
    every = texts.select("*", F.explode(F.array(*[F.lit(p) for p in profiles]) if profiles else F.array().cast("array<string>")).alias("profile"))
    both = every.join(per_text, ["profile", "doc_id"], "left")
    return both.groupBy("profile").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.coalesce("covered", "chars")).alias("chars_covered"),
        F.sum(F.coalesce("too_large", F.lit(0))).alias("too_large"), F.sum(F.coalesce("sharing_nothing", F.lit(0))).alias("sharing_nothing"),
    )


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p3_found": p3_found, "p3_taken": p3_taken, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_pieces": p10_pieces, "p10_check": p10_check}
_SETS = r"""WITH seg AS (SELECT doc_no, title AS t FROM doctexts UNION ALL SELECT doc_no, b.text FROM (SELECT doc_no, unnest(blocks) AS b FROM doctexts)),
 w AS (SELECT doc_no, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM seg WHERE t IS NOT NULL),
 g AS (SELECT DISTINCT doc_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
 n AS (SELECT doc_no, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.doc_no AS a, b.doc_no AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_no < b.doc_no GROUP BY 1, 2),
 f AS (SELECT p.a AS doc_no_a, p.b AS doc_no_b FROM p JOIN n x ON p.a = x.doc_no JOIN n y ON p.b = y.doc_no WHERE 10 * c >= 7 * (x.n + y.n - c))
"""
ORACLES: dict[str, str] = {
    "p4_found": _SETS + "SELECT doc_no_a, doc_no_b FROM f",
    "p4_classes": _SETS
    + """, s AS (SELECT doc_no, string_agg(gram, '/' ORDER BY gram) AS grams FROM g GROUP BY 1),
 d AS (SELECT doc_no, count(*) AS links FROM (SELECT doc_no_a AS doc_no FROM f UNION ALL SELECT doc_no_b FROM f) GROUP BY 1)
 SELECT s.doc_no, min(s.doc_no) OVER (PARTITION BY s.grams) AS class_no, coalesce(d.links, 0) AS links FROM s LEFT JOIN d ON s.doc_no = d.doc_no""",
    "p10_check": """SELECT profile, count(text) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars_covered, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS sharing_nothing
 FROM documents, split_limits WHERE text IS NOT NULL GROUP BY profile""",
}
