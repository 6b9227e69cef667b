"""Pruning, upserts and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.operators.scoring import champions


def prune_weight(edges: DataFrame, least: float) -> DataFrame:
    """Without the edges under a weight; those without a weight stay."""
    return edges.filter(F.col("weight").isNull() | (F.col("weight") >= least))


def prune_quality(projections: DataFrame, least: float = 2.0) -> DataFrame:
    """Without low scores and what didn't converge; rows without a score stay."""
    return projections.filter(F.col("score").isNull() | ((F.col("score") >= least) & F.col("converged")))


def prune_others(projections: DataFrame, k: int = 3) -> DataFrame:
    """Only the projections of each role's best models."""
    return projections.join(F.broadcast(champions(projections, k).select("role", "model")), ["role", "model"], "left_semi")


def prune_counts(projections: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Rows before and after each step: low quality, then all but the champions, then light edges."""
    good = prune_quality(projections)
    rows = [(projections, "before"), (good, "after_quality"), (prune_others(good), "after_champions"), (edges, "edges_before"), (prune_weight(edges, least), "edges_after")]
    return reduce(lambda a, b: a.crossJoin(b), [df.agg(F.count("*").alias(name)) for df, name in rows])  # one row each


def upsert_missing(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """All keys; a value changes only where the old one is null."""
    n = new.select(key, F.col(value).alias("__new"))
    return old.join(n, key, "full").select(key, F.coalesce(value, "__new").alias(value))


def append_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is new, each once."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def integrity(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(check_name, bad): children (parent, ordinal) without a parent, parents whose count differs from the last ordinal, null keys."""
    orphans = children.join(parents.select(F.col("id").alias("parent")), "parent", "left_anti").agg(F.lit("orphan_lines").alias("check_name"), F.count("*").alias("bad"))
    counts = children.groupBy("parent").agg(F.count("*").alias("n"), F.max("ordinal").alias("m"))
    wrong = counts.filter("n <> m").agg(F.lit("count_mismatch").alias("check_name"), F.count("*").alias("bad"))
    nulls = children.filter("parent IS NULL").agg(F.lit("null_keys").alias("check_name"), F.count("*").alias("bad"))
    return orphans.unionByName(wrong).unionByName(nulls)


def orphan_report(branches: dict[str, tuple[DataFrame, str, DataFrame]]) -> DataFrame:
    """(branch, orphans, kept): rows of each branch whose key is in no parent (id), and those that stay when they are deleted."""
    out = []
    for name, (rows, key, parents) in branches.items():
        known = rows.select(F.col(key).alias("id")).join(parents.select("id", F.lit(True).alias("there")).distinct(), "id", "left")
        out.append(known.agg(F.lit(name).alias("branch"), F.count_if(F.col("there").isNull()).alias("orphans"), F.count("there").alias("kept")))
    return reduce(DataFrame.unionByName, out)


def counts_after_delete(counts: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, child_count) lowered by the deleted children (id), at least 0."""
    less = gone.groupBy("id").agg(F.count("*").alias("__gone"))
    return counts.join(less, "id", "left").select("id", F.greatest(F.lit(0), F.col("child_count") - F.coalesce("__gone", F.lit(0))).alias("child_count"))


def atom_report(atoms: DataFrame, id_col: str, code_col: str, geometry: list[str], keys: list[str]) -> DataFrame:
    """(check_name, passed, bad): four checks in one pass over an atom table."""
    missing = lambda cols: F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))
    one = atoms.agg(missing([code_col]).alias("leaves_have_codepoints"), (F.count("*") - F.count_distinct(id_col)).alias("ids_unique"), missing(geometry).alias("valid_geometry"), missing(keys).alias("keys_set"))
    rows = one.unpivot([], one.columns, "check_name", "bad")
    return rows.select("check_name", (F.col("bad") == 0).alias("passed"), "bad")


def registry(log: DataFrame, least: float) -> DataFrame:
    """(experiment, run, metrics, best, last, version, stage) from a log of metrics (experiment, run, event_id, ts, value).

    A run whose best value reaches ``least`` becomes a version of its experiment, numbered by start; the newest is deployed, the
    others approved; the rest is rejected.
    """
    runs = log.groupBy("experiment", "run").agg(F.min("ts").alias("started"), F.count("*").alias("metrics"), F.max("value").alias("best"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    good = runs.filter(F.col("best") >= least)
    good = good.withColumn("version", F.row_number().over(Window.partitionBy("experiment").orderBy("started", "run")))
    newest = good.groupBy("experiment").agg(F.max("version").alias("newest"))
    out = runs.join(good.select("experiment", "run", "version"), ["experiment", "run"], "left").join(newest, "experiment", "left")
    return out.withColumn("stage", F.when(F.col("version").isNull(), "rejected").when(F.col("version") == F.col("newest"), "deployed").otherwise("approved"))
