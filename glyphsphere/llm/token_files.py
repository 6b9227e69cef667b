"""Token-ID files: ids in order of document, coded by frequency rank with separate control bytes.

Format. A folder with two Parquet tables, so that every store that Spark can write takes it:

``blocks``  one row per block of whole documents, in ascending (bucket, block): ``bucket``, ``block``, ``start`` (ids of the
            bucket before it), ``n_ids``, ``doc_ids``, ``doc_tokens``, ``control``, ``data``, ``data_crc32``.
``ranks``   ``rank``, ``id``, ``n``: ids by falling frequency (ties: smaller id).

Each id is stored as its rank in as many little-endian bytes (1 to 4) as it needs. ``control`` has two bits an id (bytes
less one), four ids a byte, the first in the lowest bits; ``data`` has the ranks' bytes without gaps. A table of 256
rows gives the four lengths of a control byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsphere.llm.common import materialize, new_path
from glyphsphere.llm.ordering import bucket_bounds, bucket_of, offsets
from glyphsphere.llm.tokenization import encoder, public_tokenizer

#: Ids of a block, about: a longer document is a block of its own.
BLOCK_IDS = 1 << 18
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_ZEROS = np.zeros(3, np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2**32."""
    ranks = ranks.astype("<u4", copy=False)
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = size
    q = quads.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), _ZEROS))
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = size > k
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Model:
    """A tokenizer file's text, for the executors, the end id and the numpy type that holds its ids."""

    def __init__(self, spark: SparkSession, tokenizer: str, end_id: int):
        with open(tokenizer, encoding="utf-8") as f:
            spec = f.read()
        self.spec, self.end_id, self.dtype = spark.sparkContext.broadcast(spec), end_id, np.dtype(encoder(spec, end_id).dtype).str


def encoded_ids(docs: DataFrame, model: Model, doc_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """A written table (bucket, doc_id, n, ids), with ids as little-endian bytes of the model's type, and the number of
    buckets. Each text is encoded once."""
    docs = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = bucket_bounds(docs, "doc_id")
    spec, end_id = model.spec, model.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value, end_id)
        for batch in batches:
            for lo, rows in e.encode(batch.column(1)):
                key = batch.column(0).slice(lo, len(rows))
                cols = [pa.array(bucket_of(bounds, key), pa.int32()), key.cast(pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "doc_id", "n", "ids"])

    return materialize(docs.mapInArrow(run, "bucket int, doc_id long, n long, ids binary"), "ids", compression="zstd"), len(bounds) + 1


def in_order(rows: DataFrame, buckets: int) -> DataFrame:
    """One partition a bucket of ids, each sorted by doc_id (nulls last; ties: by the ids)."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "ids")


def id_counts(rows: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over all ids of a table; each task sends one count per id that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if not len(column) or ends[0] == ends[-1]:
                continue
            ids = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype)
            for lo in range(0, len(ids), 1 << 18):
                seen = np.bincount(ids[lo : lo + (1 << 18)])
                count = np.pad(count, (0, max(0, len(seen) - len(count))))
                count[: len(seen)] += seen
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(count[met], pa.int64())], ["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, doc_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all documents (null text: only the end id) in ascending ``doc_col`` to ``path``.

    Coding needs the whole corpus's frequencies first, so the ids are written once, counted and then coded. What the
    driver holds: a count per id of the vocabulary, a bound per bucket. Rows that share an id follow one another by
    their ids; null ids come last. Empty table: no block. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = Model(spark, tokenizer or public_tokenizer("byte_bpe_50k.json"), end_id)
    rows, buckets = encoded_ids(docs, model, doc_col, text_col)
    dtype = model.dtype
    counts = sorted((-r["n"], r["id"]) for r in id_counts(rows, dtype).collect())
    ids = [i for _, i in counts]
    spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(counts)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    rank = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "block", "start", "n_ids", "doc_ids", "doc_tokens", "control", "data", "data_crc32"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        held: list[tuple[int | None, np.ndarray]] = []
        bucket, block, start, size = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate([x for _, x in held])
            control, data = encode_ranks(rank.value[flat])
            row = [bucket, block, start, len(flat), [k for k, _ in held], [len(x) for _, x in held], control, data, zlib.crc32(data)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for b, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (b != bucket or size >= BLOCK_IDS):
                    yield close()
                    block, start, size, held = block + 1, start + size, 0, []
                if b != bucket:
                    bucket, block, start = b, 0, 0
                x = np.frombuffer(raw.as_buffer(), dtype)
                held.append((key, x))
                size += len(x)
        if held:
            yield close()

    kind = "bucket int, block int, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, control binary, data binary, data_crc32 long"
    in_order(rows.select("bucket", "doc_id", "ids"), buckets).mapInArrow(blocks, kind).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a folder written by ``write``: ``start`` counts the ids of all documents before it."""
    blocks = spark.read.parquet(f"{path}/blocks")
    before = offsets(blocks.select("bucket", "n_ids"), "bucket", "n_ids")
    by_rank = np.array([r["id"] for r in sorted(spark.read.parquet(f"{path}/ranks").collect(), key=lambda r: r["rank"])], np.uint32)
    by_rank = spark.sparkContext.broadcast(by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                data = row["data"].as_py()
                if zlib.crc32(data) != row["data_crc32"].as_py():
                    raise ValueError(f"{path}: block {row['bucket']}/{row['block']} is damaged")
                ids = by_rank.value[decode_ranks(row["control"].as_py(), data, row["n_ids"].as_py())].astype("<u4")
                size = np.array(row["doc_tokens"].as_py(), np.int64)
                at = np.r_[0, np.cumsum(size)]
                start = before[row["bucket"].as_py()] + row["start"].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(start + at[:-1], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    blocks = blocks.select("bucket", "block", "start", "n_ids", "doc_ids", "doc_tokens", "control", "data", "data_crc32")
    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    out = read(spark, write(docs, new_path(spark, "token-files"), tokenizer, end_id))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
