"""Encoding of a whole corpus with a public tokenizer, and decoding.

Defined results: one row for each input row, ties and repeated rows included; NULL and empty texts have the empty list;
other columns are dropped. Very long texts are encoded whole. Decoded, NULL and the empty list are the empty text; bytes that
are no UTF-8, which ids of whole texts never give, become U+FFFD; an id without a token is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.tokens import FOLDER, coder, encode_batch, is_pieces


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of each document; no shuffle: scan, cut and encode are one stage."""
    if is_pieces(tokenizer):
        raise ValueError("ids of a piece tokenizer are not made of words; take a byte-level one")
    rows = documents.select(F.col(key), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(tokenizer, folder, True)
        for batch in batches:
            ids = encode_batch(batch.column("text"), encoder)
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"{key} {kind}, ids array<int>")


def decode_corpus(rows: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of each row of token ids; no shuffle."""
    if is_pieces(tokenizer):
        raise ValueError("ids of a piece tokenizer are not made of words; take a byte-level one")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = coder(tokenizer, folder, True).automaton
        for batch in batches:
            texts = [automaton.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(decode, f"{key} {kind}, text string")
