"""File sources: text folders, model files (safetensors, indexes, tokenizers, vocabularies, configurations), request lines."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a tensor's data types.
SIZES = {"F64": 8, "I64": 8, "F32": 4, "F16": 2, "BF16": 2}
REQUEST = "custom_id string, method string, url string, body string, _corrupt string"


def texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole text files, recursively, whose name fits the pattern."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def models(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, files, bytes): folders that hold tensor files."""
    f = _files(spark, folder, "*.safetensors").select(F.regexp_extract("path", "(.*)/[^/]*$", 1).alias("folder"), "length")
    return f.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def tensor_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, dtype, shape, first, last): one row per tensor of each file; offsets count from the file's start.

    A file begins with the header's length (8 bytes, little endian) and the header as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(data.as_buffer())
                (size,) = struct.unpack("<Q", raw[:8])
                for name, t in json.loads(bytes(raw[8 : 8 + size])).items():
                    if name != "__metadata__":
                        a, b = t["data_offsets"]
                        out.append((path, name, t["dtype"], t["shape"], 8 + size + a, 8 + size + b))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "name", "dtype", "shape", "first", "last"])

    return _files(spark, folder, "*.safetensors").select("path", "content").mapInArrow(run, "path string, name string, dtype string, shape array<long>, first long, last long")


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """Numbers of a tensor's bytes, as float32; BF16 is the upper half of a float32."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)
    kind = {"F64": "<f8", "I64": "<i8", "F32": "<f4", "F16": "<f2"}[dtype]
    return np.frombuffer(raw, kind).astype(np.float32)


def tensor_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, row, values): each row of each tensor; one of a single dimension is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(data.as_buffer())
                (size,) = struct.unpack("<Q", raw[:8])
                for name, t in json.loads(bytes(raw[8 : 8 + size])).items():
                    if name == "__metadata__" or t["dtype"] not in SIZES:
                        continue
                    a, b = t["data_offsets"]
                    v = decode(bytes(raw[8 + size + a : 8 + size + b]), t["dtype"]).reshape(-1, t["shape"][-1] if t["shape"] else 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(v)), pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(list(v), pa.list_(pa.float32()))], ["path", "name", "row", "values"]
                    )

    return _files(spark, folder, "*.safetensors").select("path", "content").mapInArrow(run, "path string, name string, row long, values array<float>")


def model_index(spark: SparkSession, path: str) -> DataFrame:
    """(tensor, file) of a sharded model's index."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json(F.get_json_object("value", "$.weight_map"), "map<string,string>")).alias("tensor", "file"))


def tokenizer_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a tokenizer file."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,bigint>")).alias("token", "id"))


def tokenizer_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, left, right) of a tokenizer file whose merges are texts or pairs."""
    doc = spark.read.text(path, wholetext=True)
    pairs = F.from_json(F.get_json_object("value", "$.model.merges"), "array<string>")
    rows = doc.select(F.posexplode(pairs).alias("rank", "m")).withColumn("p", F.coalesce(F.from_json("m", "array<string>"), F.split("m", " ")))
    return rows.select("rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))


def vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary with one token a line; the id is the line's number from 0."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("id", "token")).select("token", F.col("id").cast("bigint").alias("id"))


def flattened_config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON file, keys as dotted paths."""

    def walk(prefix: str, x) -> Iterator[tuple[str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(f"{prefix}.{k}" if prefix else k, v)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(f"{prefix}.{i}", v)
        else:
            yield prefix, x if isinstance(x, str) else json.dumps(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for text in batch.column(0).to_pylist() for r in walk("", json.loads(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["key", "value"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "key string, value string")


def batch_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request lines (JSON); what is no JSON or lacks an id is left out."""
    rows = spark.read.schema(REQUEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull() & F.col("custom_id").isNotNull()).drop("_corrupt")


def point_ewkb(points: list[tuple[float, float, float, float]]) -> bytes:
    """EWKB of a point (one) or a line string (several) with Z and M, little endian."""
    body = b"".join(struct.pack("<4d", *p) for p in points)
    kind = 0xC0000001 if len(points) == 1 else 0xC0000002
    return struct.pack("<BI", 1, kind) + (b"" if len(points) == 1 else struct.pack("<I", len(points))) + body
