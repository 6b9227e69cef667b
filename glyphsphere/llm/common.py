"""What the operators share: checked broadcasts, the shared folder, row order, Arrow text batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Bytes that a side may have, at most, to be broadcast: as rows in memory, with their place in a hash table.
BROADCAST_BYTES = 32 << 20
#: Of a row besides its values: null bits, key copy and pointers of the hash table.
_ROW_BYTES = 48


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` bytes, counted over all its rows, else as it is. Columns of
    variable length count with their values' lengths; use it on tables that are written, or cheap to make twice."""
    size = F.lit(_ROW_BYTES)
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, StructType, MapType)):
            size = size + 16 + F.octet_length(F.to_json(F.struct(F.col(f.name))))
        else:
            size = size + 8
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


_ROOTS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset: a new temporary one in local mode; on a cluster an error, as
    other machines would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="glyphsphere-")
    return _ROOTS[app]


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended already
            return


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark's cleaner drop the shuffle files of finished plans
    (it does so when the driver collects garbage)."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(spark, path)
    spark.sparkContext._jvm.System.gc()


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, what: str, tidy: bool = False, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, and survives lost executors. ``tidy``:
    Spark deletes the shuffle files once the table is written, whatever the driver's garbage collector does."""
    spark = df.sparkSession
    path, before = new_path(spark, what), spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true" if tidy else before)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a Python worker gets at once, about; a row that has more comes alone.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session's Arrow batches have at most about ``most`` bytes, or fewer if it says so already. By their rows
    alone a file's whole split is one batch, which JVM and worker hold several times."""
    # plans get their batches' size when they run, and the caller runs what an operator returns: so it stays set
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > most:
        spark.conf.set(_BATCH, str(most))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``most`` bytes each (one row at least)."""
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def fold_table(of, kind=np.uint32) -> np.ndarray:
    """``of(chr(c))`` for every code point c."""
    return np.fromiter((of(chr(c)) for c in range(0x110000)), kind, 0x110000)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column (null: empty), and each row's start among them, with the end."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    kind = np.int32 if column.type == pa.string() else np.int64
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if (raw < 128).all():
        return raw.astype(np.uint32), ends
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), first[ends]
