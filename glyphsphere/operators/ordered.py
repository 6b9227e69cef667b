"""Joins along time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], slot: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same keys at or before its time, null where there is none
    or a key or the time is null; of equal times the largest values count.

    Both sides are sorted once by keys and time; no pair of rows is ever joined. With ``slot`` (a duration such as "1 day") keys are
    split into slots of time, so that a frequent key is spread over tasks: each slot begins with what the slots before it ended on.
    """
    rows = F.struct(*(F.col(c) for c in left.columns))
    found = F.struct(F.col(time).alias("__at"), *(F.col(v) for v in values))
    base = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] + [F.col(time).alias("__time")]
    known = reduce(and_, (F.col(c).isNotNull() for c in [*keys, time]))
    l = left.filter(known).select(*base, rows.alias("__left"), F.lit(1).alias("__side")).withColumn("__found", F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType))
    r = right.filter(known).select(*base, F.lit(None).cast(l.schema["__left"].dataType).alias("__left"), F.lit(0).alias("__side"), found.alias("__found"))
    both, ks = l.unionByName(r), [f"__k{i}" for i in range(len(keys))]
    order = [F.col("__time"), F.col("__side"), F.col("__found")]
    last = F.last("__found", ignorenulls=True)
    if slot:
        both = both.withColumn("__slot", F.window("__time", slot)["start"])
        ends = both.groupBy(*ks, "__slot").agg(F.max("__found").alias("__end"))
        before = F.max("__end").over(Window.partitionBy(*ks).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
        both = both.join(ends.select(*ks, "__slot", before.alias("__before")), [*ks, "__slot"])
        within = Window.partitionBy(*ks, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = F.coalesce(last.over(within), F.col("__before"))
    else:
        got = last.over(Window.partitionBy(*ks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    done = both.withColumn("__got", got).filter("__side = 1")
    done = done.select("__left.*", *(F.col("__got")[v].alias(v) for v in values))
    return done.unionByName(left.filter(~known), allowMissingColumns=True)
