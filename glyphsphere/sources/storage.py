"""Tables by folder, and lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode; on a cluster an error, as other
    machines would not see it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/") if named else f"file://{tempfile.mkdtemp(prefix='glyphsphere-')}"


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder as Parquet, whose compression a checkpoint lacks."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
