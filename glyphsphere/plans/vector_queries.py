"""Vector, geometry and nearest-neighbour queries over ``embeddings``; its first four dimensions serve as 4D points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.functions import geometry as G
from glyphsphere.functions import vectors as V
from glyphsphere.operators import cells, extraction, layout, topk
from glyphsphere.plans.registry import Tables, query

PTS = "pts AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS m FROM embeddings)"
VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.m-b.m)*(a.m-b.m))"


def points(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate(G.AXES)))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _against(t: Tables, vec_id: int = 0) -> DataFrame:
    p = points(t)
    return topk.with_query(p, p.filter(F.col("vec_id") == vec_id))


def _vec_against(t: Tables, vec_id: int = 0) -> DataFrame:
    e = t.embeddings.select("vec_id", "label", "embedding")
    return topk.with_query(e, e.filter(F.col("vec_id") == vec_id))


@query(f"""WITH {VEC}, q AS (SELECT v AS qv FROM vec WHERE vec_id = 0)
SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, list_cosine_similarity(v, qv) AS sim FROM vec, q WHERE vec_id <> 0 ORDER BY sim DESC, vec_id LIMIT 10)""")
def k11_similar_vectors(t: Tables) -> DataFrame:
    rows = _vec_against(t).filter("vec_id <> 0")
    return topk.nearest(rows, V.cosine(F.col("embedding"), F.col("q_embedding")), 10, "vec_id", False, "sim").select("vec_id", r6(F.col("sim"), "sim"))


@query(f"""WITH {VEC}, q AS (SELECT v AS qv FROM vec WHERE vec_id = 1)
SELECT vec_id, round(list_cosine_similarity(v, qv), 6) AS cosine, round(list_distance(v, qv), 6) AS l2, round(list_inner_product(v, qv), 6) AS dot FROM vec, q""")
def v1_v2_v6_similarities(t: Tables) -> DataFrame:
    a, b = F.col("embedding"), F.col("q_embedding")
    return _vec_against(t, 1).select("vec_id", r6(V.cosine(a, b), "cosine"), r6(V.l2(a, b), "l2"), r6(V.dot(a, b), "dot"))


@query(f"""WITH {VEC}, q AS (SELECT v AS qv FROM vec WHERE vec_id = 1)
SELECT vec_id, round(v[1] + qv[1], 6) AS add1, round(v[64] + qv[64], 6) AS add64, round(v[1] - qv[1], 6) AS sub1, round(qv[2] + (v[2] - qv[3]), 6) AS mixed FROM vec, q""")
def v3_v4_arithmetic(t: Tables) -> DataFrame:
    a, b = F.col("embedding"), F.col("q_embedding")
    return _vec_against(t, 1).select(
        "vec_id", r6(V.add(a, b)[0], "add1"), r6(V.add(a, b)[63], "add64"), r6(V.sub(a, b)[0], "sub1"), r6(V.analogy(F.slice(a, 2, 1), F.slice(b, 3, 1), F.slice(b, 2, 1))[0], "mixed")
    )


@query(f"""WITH {VEC}, q AS (SELECT v AS qv FROM vec WHERE vec_id = 2)
SELECT vec_id, round(l2, 6) AS l2 FROM (SELECT vec_id, list_distance(v, qv) AS l2 FROM vec, q WHERE vec_id <> 2 ORDER BY l2, vec_id LIMIT 20)""")
def v5_k16_top_l2(t: Tables) -> DataFrame:
    rows = _vec_against(t, 2).filter("vec_id <> 2")
    return topk.nearest(rows, V.l2(F.col("embedding"), F.col("q_embedding")), 20, "vec_id", name="l2").select("vec_id", r6(F.col("l2"), "l2"))


@query(f"""WITH {VEC}, n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM vec)
SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM n WHERE n >= 0.01""")
def v7_normalized(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("n", V.norm(F.col("embedding"))).filter("n >= 0.01")
    v = V.normalize(F.col("embedding"))
    return e.select("vec_id", r6(F.col("n"), "norm"), r6(v[0], "first"), r6(v[63], "last"))


@query(f"""WITH {VEC} SELECT vec_id, CAST(len(v[1:16]) AS INTEGER) AS dims, round(list_sum(v[1:16]), 6) AS total FROM vec""")
def v10_truncated(t: Tables) -> DataFrame:
    v = V.truncate(F.col("embedding"), 16)
    return t.embeddings.select("vec_id", F.size(v).alias("dims"), r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), "total"))


@query(f"""WITH {VEC} SELECT vec_id, CAST(list_sum(list_transform(v, lambda x: greatest(-127, least(127, CAST(round(x * 127) AS INTEGER))))) AS BIGINT) AS total,
CAST(list_sum(list_transform(v, lambda x: greatest(-127, least(127, CAST(round(x * 127) AS INTEGER))) ** 2)) AS BIGINT) AS self_dot FROM vec""")
def v11_int8(t: Tables) -> DataFrame:
    q = V.to_int8(F.col("embedding"))
    zero = F.lit(0).cast("bigint")
    return t.embeddings.select("vec_id", F.aggregate(q, zero, lambda a, x: a + x).alias("total"), F.aggregate(q, zero, lambda a, x: a + x * x).alias("self_dot"))


@query(f"""WITH {VEC} SELECT src, dst, round(sim, 6) AS sim, rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS sim,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM vec a JOIN vec b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def k14_j4_knn_edges(t: Tables) -> DataFrame:
    e = t.embeddings
    return topk.batch_knn(e, e, 10).select("src", "dst", r6(F.col("score"), "sim"), F.col("rank").cast("bigint").alias("rank"))


@query()
def v8_approximate_knn(t: Tables) -> DataFrame:
    """Ten nearest of all vectors for each whose id is divisible by 20, out of the nearest cells; tests hold the recall to 0.9."""
    e = t.embeddings.select("vec_id", "embedding")
    found = cells.approximate_knn(e.filter("vec_id % 20 = 0"), e, 10, cells.fit(e, 10))
    return found.select("src", "dst", r6(F.col("score"), "sim"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {VEC} SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j, round(sim, 6) AS weight FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS sim,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM vec a JOIN vec b ON a.vec_id <> b.vec_id) WHERE rank <= 8 AND sim >= 0.3""")
def d12_similarity_graph(t: Tables) -> DataFrame:
    e = t.embeddings
    k = topk.batch_knn(e, e, 8, least=0.3)
    return k.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), r6(F.col("score"), "weight")).distinct()


@query(f"""WITH {PTS} SELECT b.vec_id, round({D}, 6) AS dist, round(1 / (1 + {D}), 6) AS similarity,
round(acos(greatest(-1.0, least(1.0, (a.x*b.x+a.y*b.y+a.z*b.z+a.m*b.m) / sqrt((a.x*a.x+a.y*a.y+a.z*a.z+a.m*a.m) * (b.x*b.x+b.y*b.y+b.z*b.z+b.m*b.m))))), 6) AS geodesic,
round(abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)+abs(a.m-b.m), 6) AS manhattan, round(1 - exp(-{D}), 6) AS exponential,
round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS xyz FROM pts a, pts b WHERE a.vec_id = 0""")
def g1_g2_g4_g19_metrics(t: Tables) -> DataFrame:
    a, b = G.point(), G.point("q_")
    m = G.METRICS
    return _against(t).select(
        "vec_id", r6(G.distance(b, a), "dist"), r6(G.similarity(b, a), "similarity"), r6(G.geodesic(G.normalized(a), G.normalized(b)), "geodesic"),
        r6(m["manhattan"](a, b), "manhattan"), r6(m["exponential"](a, b), "exponential"), r6(m["xyz"](a, b), "xyz"),
    )


UNIT = f"{PTS}, unit AS (SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z, m / n AS m FROM (SELECT *, sqrt(x*x+y*y+z*z+m*m) AS n FROM pts))"
QUANT = f"{UNIT}, quant AS (SELECT vec_id, label, " + ", ".join(f"CAST(floor((greatest(-1.0, least(1.0, {a})) + 1.0) / 2.0 * 4294967295 + 0.5) AS BIGINT) AS {a}" for a in "xyzm") + " FROM unit)"


def unit(t: Tables) -> DataFrame:
    return points(t).select("vec_id", "label", *(c.alias(a) for c, a in zip(G.normalized(G.point()), G.AXES, strict=True)))


def quantized(t: Tables) -> DataFrame:
    return unit(t).select("vec_id", "label", *(c.alias(a) for c, a in zip(G.quantized(G.point()), G.AXES, strict=True)))


FORCE = ", ".join(f"sum((a.{c}-b.{c}) * 10 / (d*d + 1e-8) / d) AS f{c}" for c in "xyzm")


@query(f"""WITH {UNIT}, near AS (SELECT a.vec_id AS src, b.vec_id AS dst, {D} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({D}, 12), b.vec_id) AS k FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
f AS (SELECT src, {FORCE} FROM near JOIN unit a ON a.vec_id = src JOIN unit b ON b.vec_id = dst WHERE k <= 8 GROUP BY src),
g AS (SELECT vec_id, x, y, z, m, {", ".join(f"f{c} - (x*fx+y*fy+z*fz+m*fm) * {c} AS f{c}" for c in "xyzm")} FROM unit JOIN f ON src = vec_id),
h AS (SELECT vec_id, {", ".join(f"{c} + f{c} * least(1, 0.05 / sqrt(fx*fx+fy*fy+fz*fz+fm*fm)) AS {c}" for c in "xyzm")} FROM g)
SELECT vec_id, {", ".join(f"round({c} / sqrt(x*x+y*y+z*z+m*m), 6) AS {c}" for c in "xyzm")} FROM h""")
def g21_repelled_layout(t: Tables) -> DataFrame:
    """Unit points moved away from their eight nearest, by 0.05 at most."""
    return layout.repelled(unit(t), longest=0.05).select("vec_id", *(r6(F.col(a), a) for a in G.AXES))


@query(f"""WITH {QUANT} SELECT vec_id, x, y, z, m, ((x-2147483648)/2147483647.5)**2+((y-2147483648)/2147483647.5)**2+((z-2147483648)/2147483647.5)**2+((m-2147483648)/2147483647.5)**2 BETWEEN 0.99 AND 1.01 AS on_surface,
round(x / 4294967295 * 2 - 1, 6) AS back_x FROM quant""")
def g5_g6_g7_g23_quantized(t: Tables) -> DataFrame:
    q = quantized(t)
    return q.select("vec_id", *G.AXES, G.on_surface(G.point()).alias("on_surface"), r6(G.dequantized(G.point())[0], "back_x"))


@query(f"""WITH {UNIT}, p AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, a.z AS az, a.m AS am, b.x AS bx, b.y AS by_, b.z AS bz, b.m AS bm FROM unit a JOIN unit b ON b.vec_id = 0),
h AS (SELECT *, acos(greatest(-1.0, least(1.0, ax*bx+ay*by_+az*bz+am*bm))) AS th FROM p)
SELECT vec_id, round(CASE WHEN th < 1e-6 THEN ax ELSE (ax+bx)*sin(th/2)/sin(th) END, 6) AS x, round(CASE WHEN th < 1e-6 THEN am ELSE (am+bm)*sin(th/2)/sin(th) END, 6) AS m,
round(ax*bx+ay*by_+az*bz+am*bm, 6) AS dot, round(ax+bx, 6) AS sum_x, round(ay-by_, 6) AS dif_y, round(az*2.5, 6) AS scaled_z FROM h""")
def g8_g9_midpoint(t: Tables) -> DataFrame:
    u = unit(t)
    rows = topk.with_query(u, u.filter("vec_id = 0"))
    a, b = G.point(), G.point("q_")
    mid = G.midpoint(a, b)
    return rows.select("vec_id", r6(mid[0], "x"), r6(mid[3], "m"), r6(G.dot(a, b), "dot"), r6(G.add(a, b)[0], "sum_x"), r6(G.sub(a, b)[1], "dif_y"), r6(G.scale(a, 2.5)[2], "scaled_z"))


@query(f"""WITH {PTS} SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(m), 6) AS m FROM pts GROUP BY label""")
def a1_a2_j1_centroids(t: Tables) -> DataFrame:
    return points(t).groupBy("label").agg(F.count("*").alias("n"), *(r6(F.avg(a), a) for a in G.AXES))


S3 = f"{UNIT}, mean AS (SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(m) AS m FROM unit GROUP BY label), s3 AS (SELECT label, n, x/r AS x, y/r AS y, z/r AS z, m/r AS m FROM (SELECT *, sqrt(x*x+y*y+z*z+m*m) AS r FROM mean))"


@query(f"""WITH {S3}, f AS (SELECT *, 1 - least(least(0.5 + least(n / 20.0, 1.5), 3.0) * 0.3, 0.8) AS k FROM s3) SELECT label, round(x, 6) AS x, round(m, 6) AS m, round(x * k, 6) AS inner_x, round(m * k, 6) AS inner_m FROM f""")
def a29_g11_sphere_centroids(t: Tables) -> DataFrame:
    mean = unit(t).groupBy("label").agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in G.AXES))
    s3 = mean.select("label", "n", *(c.alias(a) for c, a in zip(G.normalized(G.point()), G.AXES, strict=True)))
    inner = G.interior(G.point(), F.lit("phrase"), F.col("n"))
    return s3.select("label", r6(F.col("x"), "x"), r6(F.col("m"), "m"), r6(inner[0], "inner_x"), r6(inner[3], "inner_m"))


@query(f"""WITH {QUANT}, mean AS (SELECT label, avg(x) AS x, avg(m) AS m FROM quant GROUP BY label)
SELECT label, d AS depth, CAST(floor(2147483648 + (x - 2147483648) * (1 - 1 / (d + 2.0)) + 0.5) AS BIGINT) AS x, CAST(floor(2147483648 + (m - 2147483648) * (1 - 1 / (d + 2.0)) + 0.5) AS BIGINT) AS m FROM mean, range(1, 4) AS r(d)""")
def g10_depth_scaled(t: Tables) -> DataFrame:
    mean = quantized(t).groupBy("label").agg(*(F.avg(a).alias(a) for a in G.AXES)).withColumn("depth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    p = G.depth_scaled(G.point(), F.col("depth"))
    return mean.select("label", "depth", p[0].alias("x"), p[3].alias("m"))


@query(f"""WITH {UNIT}, w AS (SELECT *, 1 + vec_id % 5 AS w FROM unit), s AS (SELECT label, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*z)/sum(w) AS z, sum(w*m)/sum(w) AS m FROM w GROUP BY label)
SELECT label, round(x / sqrt(x*x+y*y+z*z+m*m), 6) AS x, round(m / sqrt(x*x+y*y+z*z+m*m), 6) AS m FROM s""")
def a28_weighted_centroids(t: Tables) -> DataFrame:
    w = unit(t).withColumn("w", 1 + F.col("vec_id") % 5)
    mean = w.groupBy("label").agg(*((F.sum(F.col("w") * F.col(a)) / F.sum("w")).alias(a) for a in G.AXES))
    n = G.normalized(G.point())
    return mean.select("label", r6(n[0], "x"), r6(n[3], "m"))


@query(f"""WITH {PTS}, c AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(m) AS m FROM pts GROUP BY label)
SELECT b.label, round(max({D}), 6) AS radius, round(avg({D}) / max({D}), 6) AS coverage FROM c a JOIN pts b ON a.label = b.label GROUP BY b.label""")
def a30_bounding_radius(t: Tables) -> DataFrame:
    p = points(t)
    c = p.groupBy("label").agg(*(F.avg(a).alias("c_" + a) for a in G.AXES))
    d = p.join(c, "label").withColumn("d", G.distance(G.point("c_"), G.point()))
    return d.groupBy("label").agg(r6(F.max("d"), "radius"), r6(F.avg("d") / F.max("d"), "coverage"))


@query(f"""WITH {PTS} SELECT vec_id, round(dist, 6) AS dist, round(1 / (1 + dist), 6) AS attention FROM (SELECT b.vec_id, {D} AS dist FROM pts a JOIN pts b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY dist, b.vec_id LIMIT 100)""")
def k1_k2_k3_k15_nearest(t: Tables) -> DataFrame:
    rows = _against(t).filter("vec_id <> 0")
    k = topk.nearest(rows, G.distance(G.point("q_"), G.point()), 100, "vec_id")
    return k.select("vec_id", r6(F.col("dist"), "dist"), r6(1.0 / (1.0 + F.col("dist")), "attention"))


@query(f"""WITH {PTS} SELECT b.vec_id, round({D}, 6) AS dist FROM pts a JOIN pts b ON a.vec_id = 3 AND {D} < 0.2""")
def l15_within_radius(t: Tables) -> DataFrame:
    d = _against(t, 3).withColumn("d", G.distance(G.point("q_"), G.point())).filter("d < 0.2")
    return d.select("vec_id", r6(F.col("d"), "dist"))


@query(f"""WITH {PTS} SELECT b.vec_id, round({D}, 6) AS dist FROM (SELECT c.x + (q.x - p.x) AS x, c.y + (q.y - p.y) AS y, c.z + (q.z - p.z) AS z, c.m + (q.m - p.m) AS m FROM pts p, pts q, pts c WHERE p.vec_id = 1 AND q.vec_id = 2 AND c.vec_id = 3) a, pts b
WHERE b.vec_id NOT IN (1, 2, 3) ORDER BY {D}, b.vec_id LIMIT 5""")
def k8_k9_k13_analogy(t: Tables) -> DataFrame:
    p = points(t)
    inputs = p.filter(F.col("vec_id").isin(1, 2, 3)).agg(*(F.first(F.when(F.col("vec_id") == i, F.struct(*G.AXES)), ignorenulls=True).alias(f"p{i}") for i in (1, 2, 3)))
    at = G.add(G.from_struct("q_p3"), G.sub(G.from_struct("q_p2"), G.from_struct("q_p1")))
    rows = topk.with_query(p.filter(~F.col("vec_id").isin(1, 2, 3)), inputs)
    return topk.nearest(rows, G.distance(at, G.point()), 5, "vec_id").select("vec_id", r6(F.col("dist"), "dist"))


@query(f"""WITH {VEC}, q AS (SELECT list_transform(range(1, 65), lambda i: c.v[i] + (a.v[i] - b.v[i])) AS qv FROM vec a, vec b, vec c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3)
SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, list_cosine_similarity(v, qv) AS sim FROM vec, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY sim DESC, vec_id LIMIT 5)""")
def k10_vector_analogy(t: Tables) -> DataFrame:
    e = t.embeddings
    inputs = e.filter(F.col("vec_id").isin(1, 2, 3)).agg(*(F.first(F.when(F.col("vec_id") == i, F.col("embedding")), ignorenulls=True).alias(f"v{i}") for i in (1, 2, 3)))
    inputs = inputs.select(V.analogy(F.col("v1"), F.col("v2"), F.col("v3")).alias("v"))
    rows = topk.with_query(e.filter(~F.col("vec_id").isin(1, 2, 3)), inputs)
    return topk.nearest(rows, V.cosine(F.col("embedding"), F.col("q_v")), 5, "vec_id", False, "sim").select("vec_id", r6(F.col("sim"), "sim"))


@query(f"""WITH {QUANT} SELECT vec_id, round(s, 6) AS sim FROM (SELECT b.vec_id, 1 - sqrt(((a.x-b.x)/4294967295)**2+((a.y-b.y)/4294967295)**2+((a.z-b.z)/4294967295)**2+((a.m-b.m)/4294967295)**2) / 2 AS s
FROM quant a JOIN quant b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY s DESC, b.vec_id LIMIT 10)""")
def k12_similar_quantized(t: Tables) -> DataFrame:
    q = quantized(t)
    rows = topk.with_query(q, q.filter("vec_id = 0")).filter("vec_id <> 0")
    return topk.nearest(rows, G.unit_similarity(G.point(), G.point("q_")), 10, "vec_id", False, "sim").select("vec_id", r6(F.col("sim"), "sim"))


@query(f"""WITH {VEC} SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM vec a JOIN vec b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4""")
def j11_rx13_similar_pairs(t: Tables) -> DataFrame:
    e = t.embeddings
    k = topk.batch_knn(e, e, None, least=0.4)
    return k.filter("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), r6(F.col("score"), "sim"))


@query(f"""WITH {PTS}, cells AS (SELECT *, CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, CAST(floor(z / 0.1) AS BIGINT) AS cz, CAST(floor(m / 0.1) AS BIGINT) AS cm FROM pts)
SELECT a.vec_id, count(*) AS near FROM cells a JOIN cells b ON abs(a.cx-b.cx) <= 1 AND abs(a.cy-b.cy) <= 1 AND abs(a.cz-b.cz) <= 1 AND abs(a.cm-b.cm) <= 1 AND a.vec_id <> b.vec_id AND {D} <= 0.1 GROUP BY a.vec_id""")
def g20_grid_neighbours(t: Tables) -> DataFrame:
    p = points(t)
    c = p.select("*", *(x.alias("c" + a) for x, a in zip(G.cell(G.point(), 0.1), G.AXES, strict=True)))
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(a) for v, a in zip((i, j, k, m), G.AXES, strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for m in (-1, 0, 1))))
    left = c.withColumn("o", around).select(F.col("vec_id").alias("id"), *(F.col(a).alias("q_" + a) for a in G.AXES), *((F.col("c" + a) + F.col("o." + a)).alias("c" + a) for a in G.AXES))
    pairs = left.join(c, ["c" + a for a in G.AXES]).filter(F.col("id") != F.col("vec_id")).filter(G.distance(G.point("q_"), G.point()) <= 0.1)
    return pairs.groupBy(F.col("id").alias("vec_id")).agg(F.count("*").alias("near"))


def _rx(name: str, k: int, least: float, kind: str, where: str = "TRUE", quality: float = 1.0):
    sql = f"""WITH {VEC}, s AS (SELECT * FROM vec WHERE {where}) SELECT src, dst, '{kind}' AS relation_type, round(sim * {quality}, 6) AS weight FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS sim,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM s a JOIN s b ON a.vec_id <> b.vec_id) WHERE rank <= {k} AND sim >= {least}"""

    def run(t: Tables) -> DataFrame:
        from glyphsphere.operators.relations import knn_edges

        return knn_edges(t.embeddings.filter(where), k, least, kind, quality).withColumn("weight", F.round("weight", 6))

    run.__name__ = name
    query(sql)(run)


_rx("rx1_embedding_edges", 15, 0.45, "E", quality=0.81)
_rx("rx2_weight_row_edges", 15, 0.5, "S", "label < 5")
_rx("rx5_position_edges", 5, 0.2, "T", "label >= 5")
_rx("rx6_visual_edges", 5, 0.2, "V", "label % 2 = 1")

WEIGHTS = f"""{VEC}, weights AS (SELECT 'model.layers.' || label || '.self_attn.q_proj.weight' AS tensor, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS row, v FROM vec)"""


def weights(t: Tables) -> DataFrame:
    """Vectors as rows of one attention matrix a label."""
    name = F.concat(F.lit("model.layers."), "label", F.lit(".self_attn.q_proj.weight"))
    row = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return t.embeddings.select(name.alias("tensor"), row.cast("bigint").alias("row"), F.col("embedding").alias("values"))


@query(f"""WITH {WEIGHTS}, s AS (SELECT * FROM weights JOIN (SELECT tensor, greatest(1, (max(row) + 1) // 16) AS stride FROM weights GROUP BY ALL) USING (tensor) WHERE row % stride = 0)
SELECT tensor, CAST(label AS INTEGER) AS layer, 'q_proj' AS component, src, dst, 'A' AS relation_type, round(sim, 6) AS weight FROM (SELECT a.tensor, a.label, a.row AS src, b.row AS dst, list_cosine_similarity(a.v, b.v) AS sim,
row_number() OVER (PARTITION BY a.tensor, a.row ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.row) AS rank FROM s a JOIN s b ON a.tensor = b.tensor AND a.row <> b.row) WHERE rank <= 8 AND sim >= 0.1 AND src < dst""")
def rx3_attention_edges(t: Tables) -> DataFrame:
    """Edges within each label's matrix; about 16 rows of each, so that small tables have strides too."""
    return extraction.attention_edges(weights(t), most=16).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {WEIGHTS}, p AS (SELECT e.vec_id, w.label, list(list_inner_product(e.v, w.v) ORDER BY w.row) AS v FROM vec e JOIN weights w ON w.label < 2 GROUP BY ALL)
SELECT 'L' || label || '/q' AS component, src, dst, round(sim, 6) AS weight FROM (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS sim,
row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 5 AND sim >= 0.4""")
def rx4_projection_edges(t: Tables) -> DataFrame:
    """All vectors projected by the matrices of the first two layers (the operator's own limit), and their neighbours there."""
    edges = extraction.projection_edges(t.embeddings, weights(t), 64, least=0.4, least_rows=8)
    return edges.withColumn("weight", F.round("weight", 6))


def _modality(name: str, case: str, tokens: str, doc: str):
    sql = f"""WITH {VEC}, s AS (SELECT *, {case} AS component FROM vec) SELECT component, src, dst, 'C' AS relation_type, round(sim, 6) AS weight FROM (SELECT a.component, a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS sim,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM s a JOIN vec b ON a.component IS NOT NULL AND b.{tokens}) WHERE rank <= 15 AND sim >= 0.25"""

    def run(t: Tables) -> DataFrame:
        rows = t.embeddings.withColumn("component", F.expr(case)).filter("component IS NOT NULL")
        return extraction.modality_edges(rows, t.embeddings.filter(tokens), least=0.25).withColumn("weight", F.round("weight", 6))

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


_modality("rx7_object_query_edges", "CASE WHEN label = 0 THEN 'OBJECT_QUERY' END", "label > 4", "Object queries (label 0) to the tokens (labels above 4) nearest.")
_modality("rx8_router_edges", "CASE label WHEN 1 THEN 'POSITIONAL' WHEN 2 THEN 'MOE_ROUTER' WHEN 3 THEN 'CLASS_HEAD' END", "label > 4", "Positional, router and class-head rows to tokens.")
_modality("rx9_modality_edges", "CASE label WHEN 4 THEN 'CHEMICAL' WHEN 0 THEN 'DNA' END", "label > 4", "Rows of named modalities to tokens.")
