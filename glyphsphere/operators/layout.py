"""Layout of points on the 3-sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.functions import geometry as G
from glyphsphere.operators.topk import batch_knn
from glyphsphere.sources.storage import cut

# Strength of the repulsion, its softening, and the longest move of a round.
STRENGTH, SOFT, LONGEST = 10.0, 1e-8, 1e-3


def repelled(points: DataFrame, k: int = 8, rounds: int = 1, longest: float = LONGEST, id_col: str = "vec_id") -> DataFrame:
    """(id_col, x, y, z, m): unit points moved away from their k nearest, ``rounds`` times.

    Each neighbour at distance r pushes by 10 / r^2 along the chord; the push along the sphere, cut to ``longest``, is the move, after
    which the point is put back on the sphere. Neighbours at the same place don't push. A round is one exact nearest-neighbour join;
    rounds are cut from each other.
    """
    at = points.select(id_col, *G.AXES)
    for i in range(rounds):
        p = cut(at) if i else at
        near = batch_knn(p.select(id_col, F.array(*G.AXES).alias("v")), p.select(id_col, F.array(*G.AXES).alias("v")), k, "l2", id_col, "v").select("src", "dst")
        beside = near.join(p.select(F.col(id_col).alias("src"), *(F.col(a).alias("p_" + a) for a in G.AXES)), "src").join(p.withColumnRenamed(id_col, "dst"), "dst")
        r = G.distance(G.point("p_"), G.point())
        push = F.when(r > 1e-12, STRENGTH / (r * r + SOFT) / r).otherwise(0.0)
        force = beside.groupBy("src").agg(*(F.sum(push * (F.col("p_" + a) - F.col(a))).alias("f_" + a) for a in G.AXES))
        both = p.join(force.withColumnRenamed("src", id_col), id_col, "left").fillna(0.0, ["f_" + a for a in G.AXES])
        along = both.withColumn("__in", G.dot(G.point(), G.point("f_"))).select(id_col, *G.AXES, *((F.col("f_" + a) - F.col("__in") * F.col(a)).alias("f_" + a) for a in G.AXES))
        size = F.sqrt(G.dot(G.point("f_"), G.point("f_")))
        share = F.when(size > longest, longest / size).otherwise(1.0)
        moved = along.withColumn("__share", share).select(id_col, *((F.col(a) + F.col("__share") * F.col("f_" + a)).alias(a) for a in G.AXES))
        at = moved.select(id_col, *(c.alias(a) for c, a in zip(G.normalized(G.point()), G.AXES, strict=True)))
    return at
