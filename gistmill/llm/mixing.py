"""Mixing sources to target weights, by histograms over hash thresholds.

A plan asks for ``corpus_fraction`` of the corpus's tokens, of which each source brings ``target_share``. A source with
fewer tokens than its target is repeated: every document is used ``floor(target / tokens)`` times, at most ``max_repeats``
times, and the documents with the least hashes once more as far as they fit. The document on the border does not fit; beyond it those go on that are
no larger than what is left, and so on, until next to nothing is left or nothing fits; where all that may go on have fitted, they are used
once more again, within ``max_repeats``. What is short of a target
because of ``max_repeats`` stays short; the shares report it.

Thresholds come from sums of tokens by source and hash bucket. Only the bucket that a threshold falls into is looked at
again, by finer buckets and at last document by document; the documents are then filtered, never sorted. Documents share
one hash order in all plans.

Defined results: NULL or empty texts and NULL sources count for the corpus (with no tokens where there is no text) and are
chosen in no plan; sources without documents reach 0; rows of one ``doc_id`` and source go together; empty tables give an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.tokens import FOLDER, coder, cut_batch, is_pieces, text_sizes
from gistmill.sources.tables import staged

#: Bits of the coarse and of the fine buckets. Beyond them about one in 2^32 documents of a source is left to look at.
COARSE, FINE = 12, 20


def token_counts(documents: DataFrame, tokenizers: list[str], folder: str = FOLDER, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns and ``n_<tokenizer>`` of each document, in one scan without a shuffle."""
    names = sorted(set(tokenizers))
    kinds = {is_pieces(n): n for n in names}
    rows = documents.select(*keep, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = {k: cut_batch(batch.column("text"), n) for k, n in kinds.items()}
            sizes = [text_sizes(cut[is_pieces(n)], coder(n, folder)) for n in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *sizes], [*keep, *[f"n_{n}" for n in names]])

    schema = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep] + [f"n_{n} long" for n in names]
    return rows.mapInArrow(count, ", ".join(schema))


#: What is left of a target may be this part of it.
TOLERANCE = 0.001
#: Bits of a document's place that are not in its coarse bucket, and not in its fine one.
BELOW_COARSE, BELOW_FINE = 63 - COARSE, 63 - COARSE - FINE
LAST = (1 << 63) - 1


def _place(hash_order: str | Column, doc_id: str | Column) -> Column:
    """A document's place in the common order: by hash, then by id."""
    return F.struct(F.col(hash_order).alias("hash_order") if isinstance(hash_order, str) else hash_order.alias("hash_order"), F.col(doc_id).alias("doc_id") if isinstance(doc_id, str) else doc_id.alias("doc_id"))


def _boundary(sums: DataFrame, by: list[str], step: str, left: str) -> DataFrame:
    """The bucket in which the running sum of ``tokens`` passes ``left``, and what is left for it; none if all fit."""
    order = Window.partitionBy(*by).orderBy(step)
    run = sums.withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    inside = run.where((F.col("before") <= F.col(left)) & (F.col("before") + F.col("tokens") > F.col(left)))
    return inside.select(*by, step, (F.col(left) - F.col("before")).alias("rest"))


def _pick(tokenizers: list[str], prefix: str = "n_") -> Column:
    return F.coalesce(*[F.when(F.col("tokenizer") == n, F.col(f"{prefix}{n}")) for n in tokenizers])


def _wanted(counts: DataFrame, targets: DataFrame, tokenizers: list[str]) -> DataFrame:
    """The rows of the plans with ``target, tokens_there, repeats, left``: what whole rounds over a source leave of its target."""
    sums = counts.groupBy(F.col("source").alias("s_source")).agg(*[F.sum(f"n_{n}").alias(f"sum_{n}") for n in tokenizers])
    sums = staged(sums, "mix-sums")
    corpus = sums.agg(*[F.sum(f"sum_{n}") for n in tokenizers]).first()  # one row
    all_tokens = F.coalesce(*[F.when(F.col("tokenizer") == n, F.lit(corpus[k] or 0).cast("long")) for k, n in enumerate(tokenizers)], F.lit(0))
    rows = targets.join(sums, F.col("source") == F.col("s_source"), "left")
    rows = rows.withColumn("target", F.floor(F.col("target_share") * F.col("corpus_fraction") * all_tokens)).withColumn("tokens_there", F.coalesce(_pick(tokenizers, "sum_"), F.lit(0)))
    some = F.col("tokens_there") > 0
    rows = rows.withColumn("repeats", F.when(some, F.least(F.floor(F.col("target") / F.col("tokens_there")), F.col("max_repeats"))).otherwise(0))
    rows = rows.withColumn("left", F.when(some & (F.col("repeats") < F.col("max_repeats")), F.col("target") - F.col("repeats") * F.col("tokens_there")).otherwise(0))
    return rows.select("plan", "source", "tokenizer", "target_share", "target", "tokens_there", "max_repeats", "repeats", "left")


def _threshold(counts: DataFrame, open_rows: DataFrame, tokenizers: list[str]) -> DataFrame:
    """``plan, source, most, after, until, next, rest`` for rows of plans with ``left`` and ``after``.

    Documents behind ``after``, of ``most`` tokens at most, are taken until ``until``; ``next`` is the document that doesn't fit any
    more (NULL where all have fitted) and ``rest`` what is left. Rows without such documents are left out. Sums are bounded by rows of plans times buckets, and what is
    broadcast has a row for each row of the plans.
    """
    by = ["plan", "source"]
    asked = open_rows.select("plan", F.col("source").alias("p_source"), "tokenizer", "left", "after")
    rows = counts.join(F.broadcast(asked), F.col("source") == F.col("p_source")).withColumn("tokens", _pick(tokenizers))
    place = _place("hash_order", "doc_id")
    rows = rows.where((F.col("tokens") > 0) & (F.col("tokens") <= F.col("left")) & (F.col("after").isNull() | (place > F.col("after"))))
    rows = rows.select(*by, "left", "tokens", "doc_id", "hash_order", F.shiftright("hash_order", BELOW_COARSE).cast("int").alias("coarse"), F.shiftright("hash_order", BELOW_FINE).alias("fine"))
    sums = staged(rows.groupBy(*by, "coarse", "left").agg(F.sum("tokens").alias("tokens")), "mix-buckets")
    eligible = sums.groupBy(*by).agg(F.sum("tokens").alias("eligible"))
    coarse = staged(_boundary(sums, by, "coarse", "left"), "mix-coarse")
    inner = rows.drop("left").join(F.broadcast(coarse), [*by, "coarse"])
    inner = staged(inner.select(*by, "fine", "rest", "doc_id", "hash_order", "tokens"), "mix-boundary")  # one bucket in 4096 of each source
    fine = _boundary(inner.groupBy(*by, "fine", "rest").agg(F.sum("tokens").alias("tokens")), by, "fine", "rest").withColumnRenamed("rest", "fine_rest")
    # 1 in 2^32 documents of a source: those of one fine bucket, by hash and then by id
    last = inner.join(fine, [*by, "fine"]).groupBy(*by, "fine", "hash_order", "doc_id", "fine_rest").agg(F.sum("tokens").alias("tokens"))
    last = last.withColumn("run", F.sum("tokens").over(Window.partitionBy(*by).orderBy("hash_order", "doc_id")))
    fits = F.col("run") <= F.col("fine_rest")
    ends = last.groupBy(*by, "fine", "fine_rest").agg(F.max(F.when(fits, place)).alias("limit"), F.min(F.when(~fits, place)).alias("next"), F.max(F.when(fits, F.col("run"))).alias("taken"))
    before_bucket = _place(F.shiftleft("fine", BELOW_FINE) - 1, F.lit(LAST))
    until = F.when(F.col("next").isNull(), _place(F.lit(LAST), F.lit(LAST))).otherwise(F.coalesce("limit", before_bucket))
    rest = F.when(F.col("next").isNull(), F.col("left") - F.col("eligible")).otherwise(F.col("fine_rest") - F.coalesce("taken", F.lit(0)))
    return open_rows.join(eligible, by).join(ends, by, "left").select(*by, "tokenizer", "target", "passes", F.col("left").alias("most"), "after", until.alias("until"), "next", rest.alias("rest"))


def thresholds(counts: DataFrame, wanted: DataFrame, tokenizers: list[str]) -> DataFrame:
    """``wanted`` with ``stretches``: of the common order of documents, those that are used once more."""
    # ``passes``: how often the source may still be gone through
    open_rows = wanted.where("left > 0").withColumn("passes", F.col("max_repeats") - F.col("repeats")).withColumn("after", F.lit(None).cast(f"struct<hash_order:bigint,doc_id:{counts.schema['doc_id'].dataType.simpleString()}>"))
    rounds = []
    while True:
        found = staged(_threshold(counts, open_rows, tokenizers), "mix-round")
        rounds.append(found.select("plan", "source", "most", "after", "until"))
        open_rows = found.where(F.col("rest") > F.col("target") * TOLERANCE).withColumn("passes", F.col("passes") - F.col("next").isNull().cast("int")).where("passes > 0")
        open_rows = open_rows.select("plan", "source", "tokenizer", "target", "passes", F.col("rest").alias("left"), F.col("next").alias("after"))
        if open_rows.isEmpty():
            break
    stretches = reduce(DataFrame.unionByName, rounds).groupBy("plan", "source").agg(F.collect_list(F.struct("most", "after", "until")).alias("stretches"))
    return wanted.join(stretches, ["plan", "source"], "left")


def mix(documents: DataFrame, targets: DataFrame, folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """(``plan, doc_id, source, n_tokens, uses`` of the chosen documents, ``plan, source, ...`` of the shares reached)."""
    tokenizers = sorted(r[0] for r in targets.select("tokenizer").distinct().collect())  # of the plans, not of the data
    counts = token_counts(documents, tokenizers, folder)
    counts = staged(counts.withColumn("hash_order", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)), "mix-counts")
    wanted = staged(_wanted(counts, targets, tokenizers), "mix-wanted")
    limits = staged(thresholds(counts, wanted, tokenizers), "mix-limits")
    rows = counts.join(F.broadcast(limits.withColumnRenamed("source", "p_source")), F.col("source") == F.col("p_source"))
    rows = rows.withColumn("n_tokens", _pick(tokenizers)).withColumn("place", _place("hash_order", "doc_id"))
    again = F.filter("stretches", lambda s: (F.col("n_tokens") <= s["most"]) & (s["after"].isNull() | (F.col("place") > s["after"])) & (F.col("place") <= s["until"]))
    rows = rows.withColumn("uses", (F.col("repeats") + F.when(F.col("stretches").isNull(), 0).otherwise(F.size(again))).cast("int"))
    chosen = rows.where((F.col("uses") > 0) & (F.col("n_tokens") > 0)).select("plan", "doc_id", "source", "n_tokens", "uses")
    got = chosen.groupBy("plan", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n"), F.count(F.lit(1)).alias("documents"))
    shares = (
        limits.join(got, ["plan", "source"], "left")
        .withColumn("tokens", F.coalesce("n", F.lit(0)))
        .select(
            "plan", "source", "target_share", F.col("target").alias("target_tokens"), "tokens",
            F.coalesce("documents", F.lit(0)).alias("documents"),
            (F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("plan")), F.lit(0))).alias("actual_share"),
            (F.col("tokens") / F.nullif("target", F.lit(0)) - 1).alias("deviation"),
        )
    )
    return chosen, shares
