"""Relations, ratings, graph, scoring, retrieval, maintenance and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.functions import geometry as G
from glyphsphere.operators import graph, maintenance, ordered, relations, scoring, topk
from glyphsphere.plans.registry import Tables, query
from glyphsphere.plans.text_queries import PAIRS, PMI, TOK, bigrams, pair_counts, pmi, unigrams
from glyphsphere.plans.vector_queries import PTS, D, points, r6

OBS = "obs AS (SELECT user_id AS src, event_type AS dst, event_id % 3 AS model, ts, event_id, greatest(-1.0, least(1.0, value / 100 - 0.5)) AS w FROM events)"
ELO = f"""WITH RECURSIVE {OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY src, dst, model ORDER BY ts, event_id) AS k FROM obs),
f AS (SELECT src, dst, model, k, greatest(0.0, least(3000.0, 1500.0 + 32.0 * ((w + 1) / 2 - 0.5))) AS r FROM o WHERE k = 1 UNION ALL
SELECT o.src, o.dst, o.model, o.k, greatest(0.0, least(3000.0, r + greatest(32.0 * power(0.95, f.k), 4.0) * ((w + 1) / 2 - 1 / (1 + exp(-(r - 1500) / 400))))) FROM f JOIN o ON o.src = f.src AND o.dst = f.dst AND o.model = f.model AND o.k = f.k + 1),
rated AS (SELECT src, dst, model, arg_max(r, k) AS rating, max(k) AS observations FROM f GROUP BY ALL)"""


def observations(t: Tables) -> DataFrame:
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 100 - 0.5))
    return t.events.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), (F.col("event_id") % 3).alias("model"), "ts", "event_id", w.alias("w"))


def rated(t: Tables) -> DataFrame:
    return relations.elo_fold(observations(t), ["src", "dst", "model"], ["ts", "event_id"], "w")


@query(f"{ELO} SELECT src, dst, model, round(rating, 6) AS rating, observations FROM rated")
def a7_m1_elo_ratings(t: Tables) -> DataFrame:
    return rated(t).withColumn("rating", F.round("rating", 6))


@query(f"""{ELO}, c AS (SELECT src, dst, avg(rating) AS a, stddev_samp(rating) AS s, stddev_pop(rating) AS p, count(*) AS num_models, sum(observations) AS n FROM rated GROUP BY ALL)
SELECT src, dst, round(a, 6) AS avg_rating, round(tanh((a - 1500) / 400), 6) AS consensus_weight, round(1 / (1 + coalesce(s, 0) / 400), 6) AS confidence, round(p, 6) AS spread, num_models, CAST(n AS BIGINT) AS total FROM c""")
def a5_a6_consensus(t: Tables) -> DataFrame:
    r = rated(t)
    pop = relations.consensus(r, ["src", "dst"], population=True).select("src", "dst", r6(F.col("rating_stddev"), "spread"))
    out = relations.consensus(r, ["src", "dst"]).select("src", "dst", r6(F.col("avg_rating"), "avg_rating"), r6(F.col("consensus_weight"), "consensus_weight"), r6(F.col("confidence"), "confidence"), "num_models", F.col("total_observations").alias("total"))
    return out.join(pop, ["src", "dst"])


@query(f"WITH {OBS} SELECT src, dst, round(avg(w), 6) AS mean_weight, round(max(w), 6) AS max_weight, count(*) AS source_count FROM obs GROUP BY ALL")
def a8_a9_a10_merged_relations(t: Tables) -> DataFrame:
    o = observations(t).select("src", "dst", F.col("w").alias("weight"))
    top = relations.merged(o, ["src", "dst"], "max").select("src", "dst", r6(F.col("weight"), "max_weight"))
    return relations.merged(o, ["src", "dst"]).select("src", "dst", r6(F.col("weight"), "mean_weight"), "source_count").join(top, ["src", "dst"])


@query(f"""{ELO} SELECT model, count(*) AS n, round(avg(rating), 6) AS avg_rating, count(*) FILTER (rating > 1500) AS above, count(DISTINCT dst) AS targets FROM rated GROUP BY model""")
def a34_a15_a13_rating_stats(t: Tables) -> DataFrame:
    return rated(t).groupBy("model").agg(F.count("*").alias("n"), r6(F.avg("rating"), "avg_rating"), F.count_if(F.col("rating") > 1500).alias("above"), F.count_distinct("dst").alias("targets"))


@query("SELECT count(*) AS atoms, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, min(n_chars) AS least, max(n_chars) AS most, array_to_string(list_sort(list(DISTINCT lang)), ',') AS names FROM documents")
def a13_a14_table_stats(t: Tables) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("names")
    return t.documents.agg(F.count("*").alias("atoms"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), names)


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(min(v), 6) AS least, round(max(v), 6) AS most, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (isnan(v)) AS nans FROM x GROUP BY vec_id""")
def a33_tensor_health(t: Tables) -> DataFrame:
    x = t.embeddings.select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    return x.groupBy("vec_id").agg(r6(F.avg("v"), "mean"), r6(F.var_pop("v"), "variance"), r6(F.min("v"), "least"), r6(F.max("v"), "most"), F.count_if(F.col("v") == 0).alias("zeros"), F.count_if(F.isnan("v")).alias("nans"))


@query("SELECT p_type AS category, p_brand AS dtype, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 20")
def a32_catalog_counts(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("dtype")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "dtype").limit(20)


@query("SELECT source, max(n_chars) AS best, rank() OVER (ORDER BY max(n_chars) DESC, source) AS place FROM documents GROUP BY source")
def a31_leaderboard(t: Tables) -> DataFrame:
    best = t.documents.groupBy("source").agg(F.max("n_chars").alias("best"))
    return best.withColumn("place", F.rank().over(Window.orderBy(F.desc("best"), "source")).cast("bigint"))


REL0 = "rel0 AS (SELECT value AS weight FROM events)"
PROJ = """proj AS (SELECT p_partkey AS id, p_brand AS model, ['embeddings', 'attention', 'ffn', 'other'][1 + p_partkey % 4] AS role, ['FP32', 'BF16', 'FP16', 'FP8', 'I8'][1 + p_partkey % 5] AS dtype,
p_size * 16 AS dim, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0 END AS variance, p_partkey % 6 <> 0 AS converged FROM part),
q AS (SELECT *, log10(dim) + CASE dtype WHEN 'FP32' THEN 2.0 WHEN 'BF16' THEN 1.5 WHEN 'FP16' THEN 1.0 WHEN 'FP8' THEN 0.5 ELSE 0 END + CASE role WHEN 'embeddings' THEN 2.0 WHEN 'attention' THEN 1.5 WHEN 'ffn' THEN 1.0 ELSE 0.5 END + coalesce(variance * 2.0, 0) AS score FROM proj)"""


def projections(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    p = t.part.select(
        k.alias("id"), F.col("p_brand").alias("model"), pick(["embeddings", "attention", "ffn", "other"], 4).alias("role"), pick(["FP32", "BF16", "FP16", "FP8", "I8"], 5).alias("dtype"),
        (F.col("p_size") * 16).alias("dim"), F.when(k % 7 != 0, (k % 100) / 100.0).alias("variance"), (k % 6 != 0).alias("converged"),
    )
    return p.withColumn("score", scoring.projection_quality(F.col("role"), F.col("dtype"), F.col("dim"), F.col("variance")))


@query(f"WITH {PROJ} SELECT id, role, dtype, round(score, 6) AS score FROM q")
def r10_projection_quality(t: Tables) -> DataFrame:
    return projections(t).select("id", "role", "dtype", r6(F.col("score"), "score"))


@query(f"""WITH {PROJ} SELECT role, model, round(s, 6) AS score, place FROM (SELECT role, model, s, row_number() OVER (PARTITION BY role ORDER BY s DESC, model) AS place FROM (SELECT role, model, max(score) AS s FROM q WHERE converged AND variance > 0.3 GROUP BY role, model)) WHERE place <= 3""")
def a12_l13_champions(t: Tables) -> DataFrame:
    return scoring.champions(projections(t)).select("role", "model", r6(F.col("score"), "score"), F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {PROJ}, {REL0}, a AS (SELECT * FROM q WHERE NOT (score < 2 OR NOT converged) OR score IS NULL), ch AS (SELECT role, model FROM (SELECT role, model, row_number() OVER (PARTITION BY role ORDER BY s DESC, model) AS place FROM (SELECT role, model, max(score) AS s FROM a WHERE converged AND variance > 0.3 GROUP BY role, model)) WHERE place <= 3)
SELECT (SELECT count(*) FROM q) AS before, (SELECT count(*) FROM a) AS after_quality, (SELECT count(*) FROM a JOIN ch USING (role, model)) AS after_champions, (SELECT count(*) FROM rel0) AS edges_before, (SELECT count(*) FROM rel0 WHERE weight IS NULL OR weight >= 10) AS edges_after""")
def m2_m3_m4_m5_pruned(t: Tables) -> DataFrame:
    return maintenance.prune_counts(projections(t), edges(t), 10.0)


REL = "rel AS (SELECT user_id AS src, event_id % 200 AS dst, value AS weight FROM events)"


def edges(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("src"), (F.col("event_id") % 200).alias("dst"), F.col("value").alias("weight"))


@query(f"""WITH {REL} SELECT node, round(weight, 6) AS weight FROM (SELECT dst AS node, weight FROM rel WHERE src = 7 UNION SELECT src, weight FROM rel WHERE dst = 7) ORDER BY weight DESC, node LIMIT 10""")
def d9_d10_j15_neighbours(t: Tables) -> DataFrame:
    return relations.neighbours(edges(t), 7, 10).select("node", F.round("weight", 6).alias("weight"))


@query(f"""WITH RECURSIVE {REL}, e AS (SELECT DISTINCT src, dst FROM rel), b AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM b JOIN e ON e.src = b.node WHERE hops < 4) SELECT node, min(hops) AS hops FROM b GROUP BY node""")
def d7_shortest_paths(t: Tables) -> DataFrame:
    return graph.shortest_paths(edges(t).select("src", "dst").distinct(), 1, 4).select("node", "hops")


@query(f"""WITH {REL}, e AS (SELECT src, dst, max(weight) AS weight FROM rel GROUP BY ALL), h1 AS (SELECT dst FROM e WHERE src = 3 AND dst <> 3 ORDER BY weight DESC, dst LIMIT 5),
h2 AS (SELECT DISTINCT dst FROM (SELECT e.dst, row_number() OVER (PARTITION BY e.src ORDER BY e.weight DESC, e.dst) AS k FROM e JOIN h1 ON e.src = h1.dst WHERE e.dst <> 3 AND e.dst NOT IN (SELECT dst FROM h1)) WHERE k <= 5)
SELECT CAST(3 AS BIGINT) AS node, 0 AS hop UNION ALL SELECT dst, 1 FROM h1 UNION ALL SELECT dst, 2 FROM h2""")
def d11_multi_hop(t: Tables) -> DataFrame:
    e = relations.merged(edges(t), ["src", "dst"], "max")
    return graph.expanded(e, t.spark.range(3, 4).select(F.col("id").alias("node")), 2, 5)


@query(f"""WITH RECURSIVE {REL}, e AS (SELECT src + 1000 AS a, dst AS b FROM rel WHERE weight > 90), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node""")
def d13_components(t: Tables) -> DataFrame:
    """Components of the relations that reach a weight of 90 (the operator's threshold)."""
    e = edges(t).filter("weight > 90").select((F.col("src") + 1000).alias("src"), "dst")
    return graph.components(e)


@query(f"""WITH RECURSIVE {REL}, e AS (SELECT src + 1000 AS a, dst AS b FROM rel WHERE weight > 99.5), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node), d AS (SELECT a AS node, count(*) AS degree FROM s GROUP BY a), t AS (SELECT component, count(*) AS size, first(node ORDER BY degree DESC, node) AS node FROM c JOIN d USING (node) GROUP BY component),
h AS (SELECT component, node FROM t ORDER BY size DESC, component LIMIT 1) SELECT h.node AS src, t.node AS dst FROM t, h WHERE t.component <> h.component""")
def d13_bridge_edges(t: Tables) -> DataFrame:
    """Edges that join the components of the relations over a weight of 99.5, between their nodes of highest degree."""
    return graph.bridges(edges(t).filter("weight > 99.5").select((F.col("src") + 1000).alias("src"), "dst"))


@query(f"""WITH {REL}, e AS (SELECT src, dst + 1000 AS dst, max(weight) AS weight FROM rel GROUP BY ALL), b AS (SELECT src AS i, dst AS j, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT i, i AS j, round(sum(weight), 6) AS value FROM b GROUP BY i UNION ALL SELECT i, j, round(-weight, 6) FROM b""")
def d14_laplacian(t: Tables) -> DataFrame:
    e = relations.merged(edges(t), ["src", "dst"], "max").withColumn("dst", F.col("dst") + 1000)
    return graph.laplacian(e).withColumn("value", F.round("value", 6))


@query()
def d6_walks(t: Tables) -> DataFrame:
    e = relations.merged(edges(t), ["src", "dst"], "max")
    return graph.walks(e, t.spark.range(0, 20).select(F.col("id").alias("start")), 5)


@query()
def d15_d16_d17_spectral(t: Tables) -> DataFrame:
    """Laplacian coordinates of the vectors' neighbour graph, scaled to the quantised range, with Hilbert keys."""
    from glyphsphere.functions.hilbert import with_key

    e = t.embeddings
    k = topk.batch_knn(e, e, 8).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.greatest("score", F.lit(0.01)).alias("weight")).dropDuplicates(["src", "dst"])
    c = graph.spectral_coordinates(k)
    lim = c.agg(*(F.min(f"c{i}").alias(f"lo{i}") for i in range(4)), *(F.max(f"c{i}").alias(f"hi{i}") for i in range(4)))
    scaled = c.crossJoin(F.broadcast(lim)).select("node", *(F.floor((F.col(f"c{i}") - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}")) * G.U32 + 0.5).cast("bigint").alias(a) for i, a in enumerate(G.AXES)))
    return with_key(scaled, G.AXES).select("node", *G.AXES, F.col("hi").cast("string").alias("hi"), F.col("lo").cast("string").alias("lo"))


@query(f"""WITH {REL}, s AS (SELECT DISTINCT src AS a, dst AS b FROM rel UNION SELECT dst, src FROM rel), p AS (SELECT range AS a, range + 1 AS b FROM range(0, 40)),
c AS (SELECT p.a, p.b, (SELECT count(*) FROM s x JOIN s y ON x.b = y.b WHERE x.a = p.a AND y.a = p.b) AS i, (SELECT count(*) FROM s WHERE a = p.a) AS na, (SELECT count(*) FROM s WHERE s.a = p.b) AS nb FROM p)
SELECT a, b, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE i / (na + nb - i) END, 6) AS jaccard FROM c""")
def a27_neighbour_jaccard(t: Tables) -> DataFrame:
    pairs = t.spark.range(0, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return relations.jaccard(edges(t), pairs).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {PTS}, {REL}, ctx AS (SELECT x, y, z, m FROM pts WHERE vec_id = 3), att AS (SELECT dst, sum(weight / 100) AS a FROM rel WHERE src IN (1, 2, 3) GROUP BY dst), pmi AS (SELECT dst, max(weight / 100) AS p FROM rel WHERE src = 3 GROUP BY dst)
SELECT vec_id, round(0.4 * s + 0.3 * p + 0.3 * a, 6) AS score, round(s, 6) AS centroid, round(p, 6) AS pmi, round(a, 6) AS attention FROM (SELECT b.vec_id, 1 / (1 + {D}) AS s, coalesce(p, 0) AS p, coalesce(a, 0) AS a FROM ctx a, pts b LEFT JOIN att ON att.dst = b.vec_id LEFT JOIN pmi ON pmi.dst = b.vec_id WHERE b.vec_id NOT IN (1, 2, 3))
ORDER BY 0.4 * s + 0.3 * p + 0.3 * a DESC, vec_id LIMIT 50""")
def r1_a11_j3_j5_candidates(t: Tables) -> DataFrame:
    e = edges(t).withColumn("weight", F.col("weight") / 100)
    out = scoring.candidates(points(t), e, [1, 2, 3], 50)
    return out.select("vec_id", r6(F.col("score"), "score"), r6(F.col("centroid"), "centroid"), r6(F.col("pmi"), "pmi"), r6(F.col("attention"), "attention"))


#: A word's place for the nearness part: three numbers of its characters and its length, in both engines.
_PLACE = "[unicode(word) / 1000.0, unicode(reverse(word)) / 1000.0, length(word) / 10.0, 0.0]"
_NEAR = "1 / (1 + sqrt(list_sum(list_transform(range(1, 5), lambda i: (c.v[i] - q.v[i]) ** 2))))"
#: What the parts of a next word's score need: words with place and frequency, PMI over its largest value, the weight of the
#: pair in the other order as attention.
NEXT = f"""{PMI}, mx AS (SELECT max(pmi) AS m FROM pm), wd AS MATERIALIZED (SELECT word, n, {_PLACE} AS v FROM uni),
lk AS MATERIALIZED (SELECT a, b, pmi / m AS p FROM pm, mx), hd AS MATERIALIZED (SELECT b AS a, a AS b, n / 1000.0 AS w FROM bi),
sc AS (SELECT q.word AS src, c.word, {_NEAR} AS centroid, coalesce(p, 0) AS pmi, coalesce(w, 0) AS attention, ln(1 + c.n) / 10 AS global
FROM wd q JOIN wd c ON q.word <> c.word LEFT JOIN lk ON lk.a = q.word AND lk.b = c.word LEFT JOIN hd ON hd.a = q.word AND hd.b = c.word WHERE q.word = 'the')"""


def language_model(t: Tables) -> scoring.Words:
    pairs = pair_counts(t)
    place = F.array(F.ascii("word") / 1000.0, F.ascii(F.reverse("word")) / 1000.0, F.length("word") / 10.0, F.lit(0.0))
    attention = bigrams(pairs).select(F.col("b").alias("src"), F.col("a").alias("dst"), (F.col("n") / 1000.0).alias("weight"))
    links = pmi(pairs).select(F.col("a").alias("src"), F.col("b").alias("dst"), "pmi")
    return scoring.Words(unigrams(pairs).withColumn("place", place), links, attention)


@query(f"""{NEXT} SELECT word, round(0.4 * centroid + 0.3 * pmi + 0.2 * attention + 0.1 * global, 6) AS total, round(centroid, 6) AS centroid, round(pmi, 6) AS pmi, round(attention, 6) AS attention, round(global, 6) AS global
FROM sc WHERE src = 'the' ORDER BY 0.4 * centroid + 0.3 * pmi + 0.2 * attention + 0.1 * global DESC, word LIMIT 20""")
def r2_next_words(t: Tables) -> DataFrame:
    """The twenty likeliest words after one, with the four parts of their score."""
    found = scoring.next_words(language_model(t), "the", 20)
    return found.select("word", *(r6(F.col(c), c) for c in ("total", "centroid", "pmi", "attention", "global")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {float(c.centroid)}::DOUBLE, {float(c.pmi)}::DOUBLE, {float(c.attention)}::DOUBLE, {float(c.frequency)}::DOUBLE, {c.greedy}, {c.temperature}::DOUBLE)" for n, c in [
    ("attention_only", scoring.Config(0, 0, 1, 0)), ("balanced", scoring.Config(0.25, 0.25, 0.25, 0.25)), ("centroid_only", scoring.Config(1, 0, 0, 0)), ("creative", scoring.Config(0.4, 0.3, 0.2, 0.1, False, 1.5)),
    ("focused", scoring.Config(0.5, 0.3, 0.2, 0.0, True, 0.5)), ("pmi_only", scoring.Config(0, 1, 0, 0))]) + ") v(preset, centroid, pmi, attention, frequency, greedy, temperature)")
def r7_presets(t: Tables) -> DataFrame:
    rows = [(n, float(c.centroid), float(c.pmi), float(c.attention), float(c.frequency), c.greedy, c.temperature) for n, c in scoring.PRESETS.items()]
    return t.spark.createDataFrame(rows, "preset string, centroid double, pmi double, attention double, frequency double, greedy boolean, temperature double")


@query()
def r6_walked(t: Tables) -> DataFrame:
    """Greedy continuation of a word; only the current word is left out of the candidates."""
    return scoring.generate(language_model(t), "the", 5)


@query()
def r5_generated(t: Tables) -> DataFrame:
    """Greedy continuation that leaves out every word of the context."""
    return scoring.generate(language_model(t), "the", 5, again=False)


@query()
def r4_sampled(t: Tables) -> DataFrame:
    return scoring.sample(scoring.next_words(language_model(t), "the", 20), "total", temperature=0.7, seed=1, id_col="word")


@query("""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lang = 'en')
SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM l GROUP BY doc_id ORDER BY sum(1.0 / (60 + r)) DESC, doc_id LIMIT 30""")
def r11_rank_fusion(t: Tables) -> DataFrame:
    d = t.documents
    lists = [(d.filter("lang = 'en'"), [F.desc("n_chars"), F.col("doc_id")]), (d.filter("source = 'src1'"), [F.col("n_chars"), F.col("doc_id")]), (d.filter("lang = 'en'"), [F.col("doc_id")])]
    return scoring.rank_fusion(lists, "doc_id", 30).withColumn("score", F.round("score", 6))


@query(f"""WITH {PTS}, seed AS (SELECT b.vec_id, {D} AS d FROM pts a JOIN pts b ON a.vec_id = 0 ORDER BY d, b.vec_id LIMIT 10), {REL}, ex AS (SELECT DISTINCT dst FROM (SELECT dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM (SELECT src, dst, max(weight) AS weight FROM rel GROUP BY ALL) r JOIN (SELECT vec_id FROM seed ORDER BY d, vec_id LIMIT 5) s ON r.src = s.vec_id) WHERE k <= 2)
SELECT vec_id AS id, 'seed' AS origin FROM seed UNION ALL SELECT dst, 'related' FROM ex WHERE dst NOT IN (SELECT vec_id FROM seed)""")
def r12_retrieval(t: Tables) -> DataFrame:
    p = points(t)
    rows = topk.with_query(p, p.filter("vec_id = 0"))
    seed = topk.nearest(rows, G.distance(G.point("q_"), G.point()), 10, "vec_id").select("vec_id", "dist")
    return scoring.retrieve(seed, relations.merged(edges(t), ["src", "dst"], "max"), 5, 2)


@query("""SELECT l_orderkey, l_linenumber, round(0.5 * l_quantity - 0.25 * l_discount + 0.1 * l_tax + 1, 6) AS y FROM lineitem""")
def r15_linear_model(t: Tables) -> DataFrame:
    y = scoring.linear({"l_quantity": 0.5, "l_discount": -0.25, "l_tax": 0.1}, 1.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(y, "y"))


@query(f"""WITH {REL} SELECT 'pairs' AS cache, count(*) AS n FROM (SELECT src, dst FROM rel WHERE weight > 30 GROUP BY ALL) UNION ALL SELECT 'attention', count(*) FROM (SELECT src, dst FROM rel WHERE abs(weight) > 10 GROUP BY ALL)""")
def r8_r9_cache_stats(t: Tables) -> DataFrame:
    e = edges(t)
    count = lambda least, name: relations.merged(e.filter(F.abs("weight") > least), ["src", "dst"], "max").agg(F.lit(name).alias("cache"), F.count("*").alias("n"))
    return count(30, "pairs").unionByName(count(10, "attention"))


@query("""SELECT check_name, bad FROM (SELECT 'orphan_lines' AS check_name, count(*) AS bad FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) UNION ALL
SELECT 'count_mismatch', count(*) FROM (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1) WHERE n <> m UNION ALL SELECT 'null_keys', count(*) FROM lineitem WHERE l_orderkey IS NULL)""")
def m6_a21_integrity(t: Tables) -> DataFrame:
    return maintenance.integrity(t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("ordinal")), t.orders.select(F.col("o_orderkey").alias("id")))


@query("""SELECT 'customer' AS branch, count(*) AS orphans, (SELECT count(*) FROM orders) - count(*) AS kept FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) UNION ALL
SELECT 'order', count(*), (SELECT count(*) FROM lineitem) - count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000) UNION ALL
SELECT 'part', count(*), (SELECT count(*) FROM lineitem) - count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice >= 1000)""")
def m7_orphans(t: Tables) -> DataFrame:
    """Rows of three branches whose parent is missing once poor customers, cheap orders and cheap parts are gone, and what stays
    when they are deleted."""
    branches = {
        "customer": (t.orders, "o_custkey", t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))),
        "order": (t.lineitem, "l_orderkey", t.orders.filter("o_totalprice >= 100000").select(F.col("o_orderkey").alias("id"))),
        "part": (t.lineitem, "l_partkey", t.part.filter("p_retailprice >= 1000").select(F.col("p_partkey").alias("id"))),
    }
    return maintenance.orphan_report(branches)


@query("""WITH gone AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT l_orderkey AS id, count(*) AS child_count FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey AS id, count(*) AS k FROM gone GROUP BY 1)
SELECT id, child_count - coalesce(k, 0) AS child_count FROM n LEFT JOIN g USING (id)""")
def m8_child_counts(t: Tables) -> DataFrame:
    """Children counted per order, lowered by those that are deleted; never under 0."""
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("child_count"))
    return maintenance.counts_after_delete(counts, t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))


@query(f"""WITH {PTS}, a AS (SELECT vec_id AS id, label AS codepoint, CASE WHEN vec_id % 50 <> 3 THEN x END AS x FROM pts) SELECT 'leaves_have_codepoints' AS check_name, count(*) FILTER (codepoint IS NULL) = 0 AS passed, count(*) FILTER (codepoint IS NULL) AS bad FROM a UNION ALL
SELECT 'ids_unique', count(*) = count(DISTINCT id), count(*) - count(DISTINCT id) FROM a UNION ALL SELECT 'valid_geometry', count(*) FILTER (x IS NULL) = 0, count(*) FILTER (x IS NULL) FROM a UNION ALL SELECT 'keys_set', count(*) FILTER (id IS NULL) = 0, count(*) FILTER (id IS NULL) FROM a""")
def m9_atom_report(t: Tables) -> DataFrame:
    """Four checks of an atom table in one pass; the geometry of every fiftieth vector is taken away beforehand."""
    p = points(t).select(F.col("vec_id").alias("id"), F.col("label").alias("codepoint"), F.when(F.col("vec_id") % 50 != 3, F.col("x")).alias("x"))
    return maintenance.atom_report(p, "id", "codepoint", ["x"], ["id"])


@query("""WITH o AS (SELECT o_custkey AS id, o_totalprice AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1), n AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer)
SELECT coalesce(o.id, n.id) AS id, round(coalesce(o.v, n.v), 6) AS v FROM o FULL OUTER JOIN n ON o.id = n.id""")
def snk3_conditional_upsert(t: Tables) -> DataFrame:
    old = topk.first_per_group(t.orders, ["o_custkey"], [F.col("o_orderkey")]).select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"))
    return maintenance.upsert_missing(old, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")), "id", "v").withColumn("v", F.round("v", 6))


@query("""SELECT doc_id, n FROM (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k > (SELECT count(*) + 1 FROM documents x, (SELECT n_chars, doc_id FROM documents WHERE doc_id = 5) c WHERE x.n_chars > c.n_chars OR (x.n_chars = c.n_chars AND x.doc_id < c.doc_id)) ORDER BY n DESC, doc_id LIMIT 20""")
def l16_page_after(t: Tables) -> DataFrame:
    """Twenty rows after the cursor's, by falling length: a comparison with the cursor's key, no rank over the table."""
    return topk.page(t.documents.select("doc_id", F.col("n_chars").alias("n")), "n", "doc_id", after=5).drop("has_more")


@query("""WITH d AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents), c AS (SELECT k FROM d WHERE doc_id = 100) SELECT doc_id, n, (SELECT c.k > 21 FROM c) AS has_more FROM d, c WHERE d.k < c.k AND d.k >= c.k - 20""")
def l16_page_before(t: Tables) -> DataFrame:
    """The twenty rows before the cursor's, and whether there are more."""
    return topk.page(t.documents.select("doc_id", F.col("n_chars").alias("n")), "n", "doc_id", before=100)


_TWO = """one AS (SELECT vec_id, x, y, z, m FROM pts WHERE vec_id % 2 = 0), two AS (SELECT vec_id, 2 * x AS x, 2 * y AS y, 2 * z AS z, 2 * m AS m FROM pts WHERE vec_id % 3 = 0),
loc AS (SELECT vec_id, coalesce(one.x, two.x) AS x, coalesce(one.y, two.y) AS y, coalesce(one.z, two.z) AS z, coalesce(one.m, two.m) AS m FROM (SELECT vec_id FROM pts) LEFT JOIN one USING (vec_id) LEFT JOIN two USING (vec_id))"""


def located(t: Tables) -> DataFrame:
    """(vec_id, x, y, z, m): from the atoms (even ids), else from the compositions (multiples of three), else null."""
    p = points(t)
    one, two = p.filter("vec_id % 2 = 0").drop("label"), p.filter("vec_id % 3 = 0").select("vec_id", *((2 * F.col(a)).alias(a) for a in G.AXES))
    return topk.with_fallback(p.select("vec_id"), one, two, "vec_id", G.AXES)


@query(f"""WITH {PTS}, {_TWO} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(m, 6) AS m, CASE WHEN x IS NOT NULL THEN array_to_string(list_transform([x, y, z, m], lambda v: printf('%.4f', v)), ',') END AS joined FROM loc""")
def l5_l6_l10_centroid_lookup(t: Tables) -> DataFrame:
    """A centroid with fallback, as four columns and as one array (shown as text)."""
    four = F.array_join(F.array(*(F.format_string("%.4f", a) for a in G.AXES)), ",")
    return located(t).select("vec_id", *(r6(F.col(a), a) for a in G.AXES), F.when(F.col("x").isNotNull(), four).alias("joined"))


@query(f"""WITH {PTS}, {_TWO} SELECT a.vec_id AS a, b.vec_id AS b, round({D}, 6) AS dist FROM loc a JOIN loc b ON b.vec_id = a.vec_id + 1""")
def g3_distance_of_two(t: Tables) -> DataFrame:
    """Distance of each id to the next one, both with fallback; null where either is nowhere."""
    p = located(t)
    other = p.select(F.col("vec_id").alias("b"), *(F.col(a).alias("q_" + a) for a in G.AXES))
    both = p.join(other, F.col("b") == F.col("vec_id") + 1)
    return both.select(F.col("vec_id").alias("a"), "b", r6(G.distance(G.point(), G.point("q_")), "dist"))


@query("SELECT p_brand AS label, min(p_partkey) AS id, count(*) AS n FROM part WHERE p_name IS NOT NULL AND NOT starts_with(p_name, '[') GROUP BY p_brand")
def l7_l14_label_lookup(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").isNotNull() & ~F.col("p_name").startswith("[")).groupBy(F.col("p_brand").alias("label")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def l12_payload_filter(t: Tables) -> DataFrame:
    return topk.matching(t.documents, {"lang": "en", "source": "src1"}).select("doc_id")


@query("SELECT o_custkey AS id, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS orders FROM orders GROUP BY 1")
def a20_ordered_lists(t: Tables) -> DataFrame:
    """Each customer's orders by date, as an array (shown as text)."""
    rows = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.transform(rows, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query(f"""WITH {REL}, lab AS (SELECT range AS id, 'node-' || range AS label FROM range(0, 200000)) SELECT a.label AS source, b.label AS target, round(max(weight), 6) AS weight, count(*) AS n FROM rel JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE a.label = 'node-7' AND b.label = 'node-99' GROUP BY ALL""")
def j13_label_pair(t: Tables) -> DataFrame:
    """The relation between two labels: both are looked up first, then one pair of ids is read."""
    labels = t.spark.range(0, 200000).select("id", F.concat(F.lit("node-"), "id").alias("label"))
    a, b = labels.filter("label = 'node-7'").select(F.col("id").alias("src"), F.col("label").alias("source")), labels.filter("label = 'node-99'").select(F.col("id").alias("dst"), F.col("label").alias("target"))
    return edges(t).join(a, "src").join(b, "dst").groupBy("source", "target").agg(F.round(F.max("weight"), 6).alias("weight"), F.count("*").alias("n"))


@query(f"""WITH {PTS}, seed AS (SELECT doc_id FROM documents JOIN pts ON vec_id = doc_id WHERE text ILIKE '%license%' ORDER BY doc_id LIMIT 1) SELECT b.vec_id, round({D}, 6) AS dist FROM pts a JOIN seed ON a.vec_id = doc_id JOIN pts b ON b.vec_id <> a.vec_id ORDER BY {D}, b.vec_id LIMIT 10""")
def k17_near_text_match(t: Tables) -> DataFrame:
    """The points nearest to that of the first text that holds a phrase."""
    p = points(t)
    hit = t.documents.filter(F.col("text").ilike("%license%")).select(F.col("doc_id").alias("vec_id")).join(p, "vec_id").orderBy("vec_id").limit(1)
    rows = topk.with_query(p, hit).filter("vec_id <> q_vec_id")
    return topk.nearest(rows, G.distance(G.point("q_"), G.point()), 10, "vec_id").select("vec_id", r6(F.col("dist"), "dist"))


@query(f"""WITH {PTS} SELECT b.vec_id, round({D}, 6) AS dist, text FROM pts a JOIN pts b ON a.vec_id = 0 AND b.vec_id <> 0 JOIN documents ON doc_id = b.vec_id ORDER BY {D}, b.vec_id LIMIT 10""")
def k5_near_with_text(t: Tables) -> DataFrame:
    """The nearest points that have a text, with it."""
    p = points(t)
    rows = topk.with_query(p, p.filter("vec_id = 0")).filter("vec_id <> 0").join(t.documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = topk.nearest(rows, G.distance(G.point("q_"), G.point()), 10, "vec_id")
    return near.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("vec_id", r6(F.col("dist"), "dist"), "text")


@query("""SELECT doc_id, CAST(i AS BIGINT) AS place, round(1.0 - 0.1 * i, 6) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents WHERE text ILIKE '%license%') WHERE i < 10""")
def r14_rank_decay(t: Tables) -> DataFrame:
    top = t.documents.filter(F.col("text").ilike("%license%")).orderBy(F.desc("n_chars"), "doc_id").limit(10)
    return scoring.rank_decayed(top, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "place", F.round("score", 6).alias("score"))


@query(f"""WITH q AS (SELECT ['the', 'of', 'license'] AS w), c AS (SELECT doc_id, list_distinct({TOK}) AS l FROM documents WHERE text ILIKE '%license%' ORDER BY n_chars DESC, doc_id LIMIT 50)
SELECT doc_id, round(len(list_intersect(l, w)) / 3.0, 6) AS relevance FROM c, q ORDER BY len(list_intersect(l, w)) DESC, doc_id LIMIT 10""")
def r13_reranked(t: Tables) -> DataFrame:
    """Fifty hits ordered anew by a model of relevance: any column will do, here the share of the question's words."""
    hits = t.documents.filter(F.col("text").ilike("%license%")).orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return scoring.reranked(hits, scoring.word_overlap(F.col("text"), "the of license"), 10, "doc_id").select("doc_id", r6(F.col("relevance"), "relevance"))


RUNS = """runs AS (SELECT user_id % 20 AS experiment, user_id AS run, event_id, ts, event_type, value FROM events),
m AS (SELECT experiment, run, min(ts) AS started, count(*) AS metrics, max(value) AS best, arg_max(value, (ts, event_id)) AS last FROM runs GROUP BY ALL)"""


@query(f"""WITH {RUNS}, v AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY started, run) AS version FROM m WHERE best >= 90)
SELECT experiment, run, metrics, round(best, 6) AS best, round(last, 6) AS last, v.version, CASE WHEN v.version IS NULL THEN 'rejected' WHEN v.version = max(v.version) OVER (PARTITION BY experiment) THEN 'deployed' ELSE 'approved' END AS stage FROM m LEFT JOIN v USING (experiment, run, metrics, best, last)""")
def m11_registry(t: Tables) -> DataFrame:
    """Runs of experiments with their metrics; good ones become numbered versions, the newest of each is deployed."""
    log = t.events.select((F.col("user_id") % 20).alias("experiment"), F.col("user_id").alias("run"), "event_id", "ts", "value")
    out = maintenance.registry(log, least=90.0)
    return out.select("experiment", "run", "metrics", r6(F.col("best"), "best"), r6(F.col("last"), "last"), F.col("version").cast("bigint").alias("version"), "stage")


@query("SELECT o.o_orderkey, count(*) AS lines FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def src1_j1_j6_semi_join(t: Tables) -> DataFrame:
    building = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = t.orders.join(building, "o_custkey", "left_semi")
    return o.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extra_event_windows(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""SELECT p.event_id, v.ts AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def extra_as_of_join(t: Tables) -> DataFrame:
    """The last view of the same user at or before each purchase."""
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    bought, seen = e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'").withColumn("viewed", F.col("ts"))
    return ordered.as_of(bought, seen, ["user_id"], "ts", ["viewed"], "7 days").select("event_id", "viewed")


@query("""SELECT p.event_id, count(v.event_id) AS views FROM events p LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts WHERE p.event_type = 'purchase' GROUP BY ALL""")
def extra_interval_join(t: Tables) -> DataFrame:
    """Views of the same user in the day before each purchase, counted over a range of time in place of joined pairs."""
    e = t.events.select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    day = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return e.withColumn("views", F.count_if(F.col("event_type") == "view").over(day)).filter("event_type = 'purchase'").select("event_id", "views")


@query("""SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def extra_set_operations(t: Tables) -> DataFrame:
    """Nations with customers and suppliers, but without a customer of a large balance."""
    c, s = t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")
    keys = c.intersect(s).exceptAll(t.customer.filter("c_acctbal > 9900").select("c_nationkey").distinct())
    return t.nation.join(keys, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_nationkey")


@query("""SELECT o_orderkey, rank() OVER w AS place, o_totalprice - lag(o_totalprice) OVER c AS change, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 4) AS recent
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC), c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def extra_rank_lag(t: Tables) -> DataFrame:
    """Each order's place by price, its change from the order before and the mean of three, by customer."""
    one = Window.partitionBy("o_custkey")
    by_time = one.orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.rank().over(one.orderBy(price.desc())).cast("bigint").alias("place"), (price - F.lag(price).over(by_time)).alias("change"),
        F.round(F.avg(price).over(by_time.rowsBetween(-2, 0)), 4).alias("recent"),
    )
