"""Total order by id without a single-task sort: range buckets from approximate quantiles, one partition a bucket."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, about; quantiles asked for and buckets made, at most.
BUCKET_ROWS, QUANTILES, BUCKETS = 8192, 2048, 1 << 18


def bucket_bounds(df: DataFrame, key: str, rows: int = BUCKET_ROWS) -> np.ndarray:
    """Inner bounds of ranges of about ``rows`` rows: bucket b holds the keys in (bound[b-1], bound[b]].

    Quantiles cut the table into at most ``QUANTILES`` ranges; a larger table's ranges are cut again into equal steps of the
    key, up to ``BUCKETS`` in all (2 MB of bounds). Beyond that the buckets grow with the table. Rows with one key, and
    rows without one, are in one bucket: the key is meant to be an id.
    """
    key_col = F.col(key).cast("long")
    many, least, most = df.agg(F.count(key), F.min(key_col), F.max(key_col)).first()
    parts = min(math.ceil(many / rows), BUCKETS)
    if parts <= 1:
        return np.zeros(0, np.int64)
    wide = min(parts, QUANTILES)
    shares = [i / wide for i in range(1, wide)]
    found = df.agg(F.percentile_approx(key_col, F.array(*map(F.lit, shares)), F.lit(20 * wide if wide > 500 else 10_000))).first()[0]
    ends = np.array([least, *found, most], np.int64)
    steps = math.ceil(parts / wide)
    inner = [ends[:-1] + ((ends[1:] - ends[:-1]).astype(np.float64) * i / steps).astype(np.int64) for i in range(steps)]
    bounds = np.unique(np.concatenate(inner))
    return bounds[(bounds > least) & (bounds < most)] if steps > 1 else np.unique(np.array(found, np.int64))


def bucket_of(bounds: np.ndarray, keys: pa.Array) -> np.ndarray:
    """The bucket of each key; nulls come last."""
    k = keys.cast(pa.int64())
    out = np.searchsorted(bounds, k.fill_null(0).to_numpy(zero_copy_only=False), "left")
    return np.where(k.is_null().to_numpy(zero_copy_only=False), len(bounds), out)


def offsets(totals: DataFrame, bucket: str, total: str) -> dict[int, int]:
    """Sum of the totals of all earlier buckets: one number a bucket on the driver."""
    rows = sorted((r[0], r[1]) for r in totals.groupBy(bucket).agg(F.sum(total)).collect())
    ends = np.cumsum([n for _, n in rows])
    return {b: int(e - n) for (b, n), e in zip(rows, ends, strict=True)}
