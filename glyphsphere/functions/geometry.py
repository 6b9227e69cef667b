"""Points of the unit 3-sphere as four double columns, and their quantised form as four unsigned 32-bit numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column, Column]

# Largest unsigned 32-bit number, centre of the quantised range, parameters of the spiral, code points.
U32, CENTER = 4294967295, 2147483648
PHI, PSI = 2.0**0.5, 1.533751168755204288118041
CODEPOINTS = 1114112
AXES = ("x", "y", "z", "m")


def point(prefix: str = "") -> Point:
    return tuple(F.col(f"{prefix}{a}").cast("double") for a in AXES)  # type: ignore[return-value]


def as_struct(p: Point) -> Column:
    return F.struct(*(c.alias(a) for c, a in zip(p, AXES, strict=True)))


def from_struct(c: str) -> Point:
    return point(f"{c}.")


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]


def add(a: Point, b: Point) -> Point:
    return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: Point, b: Point) -> Point:
    return tuple(x - y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def scale(a: Point, k: Column | float) -> Point:
    return tuple(x * k for x in a)  # type: ignore[return-value]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    d = sub(a, b)
    return F.sqrt(dot(d, d))


def similarity(a: Point, b: Point) -> Column:
    return 1.0 / (1.0 + distance(a, b))


def unit_similarity(a: Point, b: Point) -> Column:
    """1 - d / 2 for coordinates over U32."""
    return 1.0 - distance(scale(a, 1.0 / U32), scale(b, 1.0 / U32)) / 2.0


def geodesic(a: Point, b: Point) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def normalized(a: Point) -> Point:
    """On the unit sphere; (1, 0, 0, 0) for a point without length."""
    n = norm(a)
    return tuple(F.when(n > 1e-12, x / n).otherwise(1.0 if i == 0 else 0.0) for i, x in enumerate(a))  # type: ignore[return-value]


def quantized(a: Point) -> Point:
    """[-1, 1] to 0..U32: clamped, rounded half up."""
    return tuple(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1.0) / 2.0 * U32 + 0.5).cast("bigint") for x in a)  # type: ignore[return-value]


def dequantized(a: Point) -> Point:
    return normalized(tuple(x / U32 * 2.0 - 1.0 for x in a))  # type: ignore[arg-type]


def on_surface(a: Point) -> Column:
    """Squared radius about 1, of quantised coordinates around the centre."""
    r2 = dot(*(tuple((x - CENTER) / (CENTER - 0.5) for x in a),) * 2)  # type: ignore[arg-type]
    return r2.between(0.99, 1.01)


def midpoint(a: Point, b: Point) -> Point:
    """Halfway on the great circle; the first point where the two are closer than 1e-6."""
    theta = geodesic(a, b)
    k = F.sin(theta / 2) / F.sin(theta)
    return tuple(F.when(theta < 1e-6, x).otherwise((x + y) * k) for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def depth_scaled(mean: Point, depth: Column) -> Point:
    """Quantised mean moved towards the centre: the deeper, the closer."""
    k = 1.0 - 1.0 / (depth + 2.0)
    return tuple(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(U32)), CENTER + (x - CENTER) * k)) + 0.5).cast("bigint") for x in mean)  # type: ignore[return-value]


def complexity(kind: Column, many: Column) -> Column:
    """How far inside a composition lies, by its type and number of atoms."""
    n = many.cast("double")
    by = (
        F.when(kind == "word", F.least(n / 10, F.lit(1.0)))
        .when(kind == "phrase", 0.5 + F.least(n / 20, F.lit(1.5)))
        .when(kind == "sentence", 1.0 + F.least(n / 50, F.lit(2.0)))
        .otherwise(n / 100)
    )
    return F.when(many <= 1, 0.0).otherwise(F.least(by, F.lit(3.0)))


def interior(surface: Point, kind: Column, many: Column) -> Point:
    return scale(surface, 1.0 - F.least(complexity(kind, many) * 0.3, F.lit(0.8)))


def on_spiral(rank: Column) -> Point:
    """Super-Fibonacci point of a rank among all code points, in single precision."""
    import math

    i = rank.cast("double") + 0.5
    s, alpha, beta = i / CODEPOINTS, i * (2.0 * math.pi) / PHI, i * (2.0 * math.pi) / PSI
    r, rr = F.sqrt(s), F.sqrt(1.0 - s)
    p = (r * F.cos(alpha), r * F.sin(alpha), rr * F.cos(beta), rr * F.sin(beta))
    n = norm(p)
    return tuple((x / n).cast("float").cast("double") for x in p)  # type: ignore[return-value]


def cell(a: Point, side: float) -> Point:
    """Grid cell of a point."""
    return tuple(F.floor(x / side).cast("bigint") for x in a)  # type: ignore[return-value]


#: Distances by name; extend it to plug in one's own.
METRICS: dict[str, Callable[[Point, Point], Column]] = {
    "euclidean": distance,
    "geodesic": geodesic,
    "manhattan": lambda a, b: F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2]) + F.abs(a[3] - b[3]),
    "cosine": lambda a, b: 1.0 - dot(a, b) / (norm(a) * norm(b)),
    "exponential": lambda a, b: 1.0 - F.exp(-distance(a, b)),
    "xyz": lambda a, b: F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2),
}
