"""Ratings and counts over streams of observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from glyphsphere.operators.relations import DECAY, FIRST, FLOOR, SCALE, TOP, K


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import math

    rating, seen = state.get if state.exists else (FIRST, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for w in rows["weight"]:
        k = max(K * DECAY**seen, FLOOR)
        rating = min(TOP, max(0.0, rating + k * ((w + 1) / 2 - 1 / (1 + math.exp(-(rating - FIRST) / SCALE)))))
        seen += 1
    state.update((rating, seen))
    yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "rating": [rating], "observations": [seen]})


def streamed_ratings(stream: DataFrame) -> DataFrame:
    """(src, dst, rating, observations) after each micro-batch, from (src, dst, ts, seq, weight). State: two numbers a pair;
    observations of one batch are taken in order of time, later batches follow."""
    out, state = "src long, dst string, rating double, observations long", "rating double, observations long"
    return stream.groupBy("src", "dst").applyInPandasWithState(_update, out, state, "update", "NoTimeout")


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n): counts per event-time window; rows later than the watermark are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")
