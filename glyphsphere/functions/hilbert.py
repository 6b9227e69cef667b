"""128-bit Hilbert keys of four unsigned 32-bit coordinates, as two DECIMAL(20,0) halves. Kernels in numpy, 32 bit planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_CORNER = np.uint32(0x80000000)
_WORD = "decimal(20,0)"


def _rotated(x: np.ndarray, bit: int) -> None:
    """One bit plane of the curve's rotations, over rows of four axes, in the order of the axes."""
    low = np.uint32((1 << bit) - 1)
    for axis in range(4):
        _swap(x, axis, bit, low)


def _swap(x: np.ndarray, axis: int, bit: int, low: np.uint32) -> None:
    lit = (x[:, axis] >> np.uint32(bit)) & np.uint32(1) == 1
    other = np.where(lit, np.uint32(0), (x[:, 0] ^ x[:, axis]) & low)
    x[:, 0] ^= np.where(lit, low, other)
    if axis:
        x[:, axis] ^= other


def encode(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of rows of four coordinates; the centre of the range is the curve's corner."""
    x = points.astype(np.uint32) ^ _CORNER
    for bit in range(31, 0, -1):
        _rotated(x, bit)
    for axis in (1, 2, 3):
        x[:, axis] ^= x[:, axis - 1]
    flip = np.zeros(len(x), np.uint32)
    for bit in range(31, 0, -1):
        flip ^= np.where(x[:, 3] >> np.uint32(bit) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip[:, None]
    hi, lo = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    for bit in range(32):
        for axis in range(4):
            one = (x[:, axis] >> np.uint32(bit) & np.uint32(1)).astype(np.uint64)
            place = 4 * bit + axis
            if place < 64:
                lo |= one << np.uint64(place)
            else:
                hi |= one << np.uint64(place - 64)
    return hi, lo


def decode(hi: np.ndarray, lo: np.ndarray, corner: bool = False) -> np.ndarray:
    """Rows of four coordinates; ``corner``: counted from the curve's corner."""
    x = np.zeros((len(hi), 4), np.uint32)
    for bit in range(32):
        for axis in range(4):
            place = 4 * bit + axis
            word = lo >> np.uint64(place) if place < 64 else hi >> np.uint64(place - 64)
            x[:, axis] |= (word & np.uint64(1)).astype(np.uint32) << np.uint32(bit)
    last = x[:, 3] >> np.uint32(1)
    for axis in (3, 2, 1):
        x[:, axis] ^= x[:, axis - 1]
    x[:, 0] ^= last
    for bit in range(1, 32):
        low = np.uint32((1 << bit) - 1)
        for axis in (3, 2, 1, 0):
            _swap(x, axis, bit, low)
    return x if corner else x ^ _CORNER


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("hi", "lo")]))
def _key(x: pd.Series, y: pd.Series, z: pd.Series, m: pd.Series) -> pd.DataFrame:
    hi, lo = encode(np.stack([x, y, z, m], 1).astype(np.int64).astype(np.uint32))
    return pd.DataFrame({"hi": hi.view(np.int64), "lo": lo.view(np.int64)})


def _unsigned(c: Column) -> Column:
    """The 64 bits of a long, read without a sign."""
    return (c.cast(_WORD) + F.when(c < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))).cast(_WORD)


def _signed(c: Column) -> Column:
    top = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(c >= top, (c - top - top).cast("bigint")).otherwise(c.cast("bigint"))


def with_key(df: DataFrame, axes: tuple[str, ...], hi: str = "hi", lo: str = "lo") -> DataFrame:
    """``df`` with the key of four coordinate columns as two unsigned halves. Two longs leave the kernel."""
    df = df.withColumn("__key", _key(*axes))
    return df.withColumns({hi: _unsigned(F.col("__key.hi")), lo: _unsigned(F.col("__key.lo"))}).drop("__key")


@F.pandas_udf(StructType([StructField(n, LongType()) for n in "xyzm"]))
def _point(hi: pd.Series, lo: pd.Series) -> pd.DataFrame:
    p = decode(hi.to_numpy(np.int64).view(np.uint64), lo.to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame(p.astype(np.int64), columns=["x", "y", "z", "m"])


@F.pandas_udf(StructType([StructField(n, LongType()) for n in "xyzm"]))
def _corner_point(hi: pd.Series, lo: pd.Series) -> pd.DataFrame:
    p = decode(hi.to_numpy(np.int64).view(np.uint64), lo.to_numpy(np.int64).view(np.uint64), corner=True)
    return pd.DataFrame(p.astype(np.int64), columns=["x", "y", "z", "m"])


def point_of(hi: Column, lo: Column, corner: bool = False) -> Column:
    """The point (x, y, z, m) of a key; ``corner``: counted from the curve's corner."""
    return (_corner_point if corner else _point)(_signed(hi), _signed(lo))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def distance(ahi: Column, alo: Column, bhi: Column, blo: Column) -> tuple[Column, Column]:
    """Halves of the absolute difference of two keys, with a borrow."""
    swap = (ahi < bhi) | ((ahi == bhi) & (alo < blo))
    xh, xl = F.when(swap, _wide(bhi)).otherwise(_wide(ahi)), F.when(swap, _wide(blo)).otherwise(_wide(alo))
    yh, yl = F.when(swap, _wide(ahi)).otherwise(_wide(bhi)), F.when(swap, _wide(alo)).otherwise(_wide(blo))
    borrow = xl < yl
    word = F.lit("18446744073709551616").cast("decimal(38,0)")
    zero, one = (F.lit(v).cast("decimal(38,0)") for v in ("0", "1"))
    return (xh - yh - F.when(borrow, one).otherwise(zero)).cast(_WORD), (xl - yl + F.when(borrow, word).otherwise(zero)).cast(_WORD)


def carried(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of a key whose low half, a whole decimal not under 0, may exceed 64 bits: what it has beyond goes to the high half."""
    word = F.lit("18446744073709551616").cast("decimal(38,0)")
    low = _wide(lo) % word
    return (_wide(hi) + ((_wide(lo) - low) / word).cast("decimal(20,0)")).cast(_WORD), low.cast(_WORD)


def rough_distance(ahi: Column, alo: Column, bhi: Column, blo: Column) -> Column:
    """|difference of high halves| * 2^63 + |difference of low halves|, in double."""
    return F.abs(ahi.cast("double") - bhi.cast("double")) * 9223372036854775808.0 + F.abs(alo.cast("double") - blo.cast("double"))


def unit_position(hi: Column) -> Column:
    """Place on the curve in [0, 1), from the high half."""
    return hi.cast("double") / 18446744073709551616.0


def wrapped(a: Column, b: Column) -> Column:
    """Distance of two places on the closed unit interval."""
    d = F.abs(a - b)
    return F.least(d, 1.0 - d)
