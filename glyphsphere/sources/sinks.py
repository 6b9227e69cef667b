"""Sinks: delimited exports in chunks, model files, collections that take upserts, points as EWKB."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from glyphsphere.functions.geometry import AXES
from glyphsphere.sources.storage import cut

#: Null is \\N and differs from an empty text; texts may hold separators, quotes, blanks and line ends.
CSV = {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
ENTRY = np.dtype([("order", "u1"), ("kind", "<u4"), ("p", "<f8", 4)])


def export(df: DataFrame, path: str, chunk: int = 1_000_000) -> None:
    """Writes delimited files of at most ``chunk`` rows each."""
    df.write.mode("overwrite").options(**CSV).option("maxRecordsPerFile", chunk).csv(path)


def exported(spark: SparkSession, path: str, schema) -> DataFrame:
    """Reads what ``export`` wrote."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file through the file system of its path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def tensor_file(tensors: dict[str, np.ndarray]) -> bytes:
    """Bytes of a tensor file: the header's length, the header as JSON, the float32 numbers."""
    head, body = {}, b""
    for name, t in tensors.items():
        raw = np.ascontiguousarray(t, "<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(t.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + body


def with_ewkb(points: DataFrame, name: str = "ewkb") -> DataFrame:
    """``points`` (with x, y, z, m) and each point's EWKB: little endian, Z and M, no reference system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, ENTRY)
            out["order"], out["kind"] = 1, 0xC0000001
            out["p"] = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False) for a in AXES]) if batch.num_rows else out["p"]
            made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ENTRY.itemsize), len(out), [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(pa.binary())], [*batch.schema.names, name])

    typed = points.withColumns({a: F.col(a).cast("double") for a in AXES})
    return typed.mapInArrow(run, StructType([*typed.schema.fields, StructField(name, BinaryType())]))


class Collection:
    """A vector store of Parquet files in buckets of the id: an upsert or a delete rewrites only the buckets it touches."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        """Replaces the buckets of ``rows``, which must not be read from them any more."""
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def recreate(self, rows: DataFrame) -> None:
        """Drops all and writes ``rows``; of equal ids one stays."""
        self._bucketed(rows.dropDuplicates([self.key])).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        """All rows; a bucket without rows holds one without an id, which is left out."""
        return self.spark.read.parquet(self.path).filter(F.col(self.key).isNotNull()).drop("bucket")

    def _touched(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Touched buckets (there are no more than ``buckets``) and their rows that ``ids`` doesn't name."""
        hit = self._bucketed(ids).select("bucket").distinct()
        rows = self.spark.read.parquet(self.path).join(F.broadcast(hit), "bucket", "left_semi")
        return hit, rows.join(ids.select(self.key), self.key, "left_anti")

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows; those of known ids replace the old ones. Of equal ids one stays."""
        _, kept = self._touched(rows)
        self._write(cut(kept.unionByName(self._bucketed(rows.dropDuplicates([self.key])))))

    def delete(self, ids: DataFrame) -> None:
        """Deletes the rows of the given ids."""
        hit, kept = self._touched(ids)
        self._write(cut(hit.join(kept, "bucket", "left")))
