"""Packing by concatenate and cut: prefix sums over partition totals give global offsets; windows have fixed ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.llm.ordering import offsets
from glyphsphere.llm.token_files import Model, encoded_ids, in_order
from glyphsphere.llm.tokenization import public_tokenizer

#: Tokens of a sequence, at most.
SEQUENCE = 4096


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = SEQUENCE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    The documents' ids, each with the end id, stand one after another in ascending doc_id (nulls last; rows that share
    an id: by their ids) and are cut every ``length`` ids, so only the last sequence can have padding. First pass:
    ids in buckets of doc_id, and each bucket's total. Second pass: the totals, summed on the driver (one number a
    bucket), give where each bucket begins, and its rows are counted on from there in order; a row that crosses window
    ends becomes several pieces. Null or empty text: one piece with the end id. Repeated rows are packed each. Empty
    table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = Model(spark, tokenizer or public_tokenizer("word_bpe_49k.json"), end_id)
    rows, buckets = encoded_ids(docs, model, doc_col, text_col)
    before, dtype = offsets(rows.select("bucket", "n"), "bucket", "n"), model.dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.binary() if x == "ids" else pa.int64() for x in names]
        bucket, place, out = None, 0, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for b, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    bucket, place = b, before[b]
                ids = np.frombuffer(raw.as_buffer(), dtype).astype("<u4")
                at, n = 0, len(ids)
                while at < n:
                    size = min(n - at, length - place % length)
                    out.append((key, at, size, ids[at : at + size].tobytes(), n, place // length, place % length))
                    at, place = at + size, place + size
                    if len(out) == 512:
                        yield made()
                        out = []
        if out:
            yield made()

    kind = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return in_order(rows.select("bucket", "doc_id", "ids"), buckets).mapInArrow(cut, kind)


def pieces(docs: DataFrame, **kw) -> DataFrame:
    """``packed`` with the ids' crc32 in place of the ids."""
    return packed(docs, **kw).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
