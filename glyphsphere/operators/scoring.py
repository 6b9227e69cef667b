"""Scores, ranks and greedy or sampled choice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.functions import geometry as G
from glyphsphere.functions.text import STOP_TOKENS, tokens
from glyphsphere.operators.topk import first_per_group, placed, with_query
from glyphsphere.sources.storage import cut

# Bonuses of data types and roles.
DTYPES = {"FP32": 2.0, "F32": 2.0, "BF16": 1.5, "FP16": 1.0, "F16": 1.0, "FP8": 0.5, "F8_E4M3": 0.5}
ROLES = {"embeddings": 2.0, "attention": 1.5, "ffn": 1.0}


def _bonus(c: Column, table: dict[str, float], other: float) -> Column:
    return reduce(lambda a, kv: a.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(other)


def projection_quality(role: Column, dtype: Column, dim: Column, variance: Column) -> Column:
    return F.log10(dim.cast("double")) + _bonus(dtype, DTYPES, 0.0) + _bonus(role, ROLES, 0.5) + F.coalesce(variance * 2.0, F.lit(0.0))


def champions(projections: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """(role, model, score, place): the best models of each role among the good projections."""
    good = projections.filter(F.col("converged") & (F.col("variance") > least)).groupBy("role", "model").agg(F.max("score").alias("score"))
    return first_per_group(good, ["role"], [F.desc("score"), F.col("model")], k, "place")


def candidates(points: DataFrame, edges: DataFrame, context: list, k: int, id_col: str = "vec_id") -> DataFrame:
    """Points outside the context by 0.4 nearness to its last, 0.3 weight from its last, 0.3 weight from all of it."""
    attention = edges.filter(F.col("src").isin(context)).groupBy(F.col("dst").alias(id_col)).agg(F.sum("weight").alias("attention"))
    pmi = edges.filter(F.col("src") == context[-1]).groupBy(F.col("dst").alias(id_col)).agg(F.max("weight").alias("pmi"))
    rows = with_query(points.filter(~F.col(id_col).isin(context)), points.filter(F.col(id_col) == context[-1]))
    rows = rows.join(attention, id_col, "left").join(pmi, id_col, "left").fillna(0.0, ["attention", "pmi"]).withColumn("centroid", G.similarity(G.point(), G.point("q_")))
    return rows.withColumn("score", 0.4 * F.col("centroid") + 0.3 * F.col("pmi") + 0.3 * F.col("attention")).orderBy(F.desc("score"), id_col).limit(k)


@dataclass(frozen=True)
class Config:
    """Weights of the four parts of a next word's score, and how one is chosen."""

    centroid: float = 0.4
    pmi: float = 0.3
    attention: float = 0.2
    frequency: float = 0.1
    greedy: bool = True
    temperature: float = 1.0


# Presets by name.
PRESETS = {
    "centroid_only": Config(1.0, 0.0, 0.0, 0.0), "pmi_only": Config(0.0, 1.0, 0.0, 0.0), "attention_only": Config(0.0, 0.0, 1.0, 0.0), "balanced": Config(0.25, 0.25, 0.25, 0.25),
    "creative": Config(0.4, 0.3, 0.2, 0.1, False, 1.5), "focused": Config(0.5, 0.3, 0.2, 0.0, True, 0.5),
}


@dataclass(frozen=True)
class Words:
    """What a score needs: words (word, n, place), an array of four numbers each; links (src, dst, pmi); attention (src, dst, weight)."""

    words: DataFrame
    links: DataFrame
    attention: DataFrame


def next_words(model: Words, last: str, k: int, config: Config = Config(), without: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(word, total, centroid, pmi, attention, global): the ``k`` likeliest words after ``last``.

    Nearness of the places; PMI over the largest PMI of all links; attention; log(1 + frequency) / 10. Null places count 0.
    """
    here = model.words.filter(F.col("word") == last).select(F.col("place").alias("q")).limit(1)
    after = model.links.filter(F.col("src") == last).select(F.col("dst").alias("word"), F.col("pmi").alias("p"))
    best = model.links.agg(F.max("pmi").alias("best"))
    heed = model.attention.filter(F.col("src") == last).groupBy(F.col("dst").alias("word")).agg(F.max("weight").alias("w"))
    rows = model.words.filter(~F.col("word").isin(last, *without)).join(after, "word", "left").join(heed, "word", "left").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(here))  # one row each
    near = F.sqrt(F.aggregate(F.zip_with("place", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    parts = {"centroid": F.coalesce(1.0 / (1.0 + near), F.lit(0.0)), "pmi": F.coalesce(F.col("p") / F.col("best"), F.lit(0.0)), "attention": F.coalesce("w", F.lit(0.0)), "global": F.log1p(F.col("n").cast("double")) / 10}
    rows = rows.select("word", *(c.alias(n) for n, c in parts.items()))
    total = config.centroid * F.col("centroid") + config.pmi * F.col("pmi") + config.attention * F.col("attention") + config.frequency * F.col("global")
    return rows.withColumn("total", total).orderBy(F.desc("total"), "word").limit(k)


# What ends a walk.
WALK_STOPS = [".", "!", "?", "\n"]


def generate(model: Words, start: str, steps: int, config: Config = Config(), again: bool = True, seed: int = 1) -> DataFrame:  # noqa: B008
    """(position, word): a continuation word by word, a bounded loop of small jobs over written inputs.

    ``again``: a walk, which leaves out the current word only and ends at ``. ! ?`` or a line break; else no word of the
    context comes again, and ``. ! ? [SEP] [EOS]`` end it. Greedy, or drawn by the configuration's temperature. A start
    that is no word gives no rows.
    """
    model = Words(cut(model.words), cut(model.links), cut(model.attention))
    spark, path = model.words.sparkSession, [start]
    if not model.words.filter(F.col("word") == start).limit(1).count():
        return spark.createDataFrame([], "position int, word string")
    for step in range(steps):
        found = next_words(model, path[-1], 1 if config.greedy else 40, config, () if again else tuple(path[:-1]))
        best = (found if config.greedy else sample(found, "total", config.temperature, seed + step, "word")).first()
        if best is None:
            break
        path.append(best["word"])
        if best["word"] in (WALK_STOPS if again else STOP_TOKENS):
            break
    return spark.createDataFrame(list(enumerate(path)), "position int, word string")


def rank_decayed(top: DataFrame, order: list) -> DataFrame:
    """A short list's rows with ``place`` from 0 and a score that falls by a tenth from row to row, from 1."""
    ranked = top.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    return ranked.withColumn("score", 1.0 - 0.1 * F.col("place"))


def word_overlap(text: Column, question: str) -> Column:
    """Share of the question's distinct words that a text holds."""
    wanted = sorted({w for w in question.lower().split() if w})
    return F.size(F.array_intersect(F.array_distinct(tokens(text)), F.array(*map(F.lit, wanted)))) / F.lit(max(1, len(wanted)))


def reranked(hits: DataFrame, relevance: Column, k: int, id_col: str) -> DataFrame:
    """The ``k`` best of a list of hits by a model's relevance (any column, a pandas UDF too)."""
    return hits.withColumn("relevance", relevance).orderBy(F.desc("relevance"), id_col).limit(k)


def sample(options: DataFrame, score: str, temperature: float, seed: int, id_col: str) -> DataFrame:
    """One row drawn by softmax of score over temperature: the largest score plus Gumbel noise from a hash, repeatable."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return options.withColumn("key", F.col(score) / temperature - F.log(-F.log(u))).orderBy(F.desc("key"), id_col).limit(1)


def rank_fusion(lists: list[tuple[DataFrame, list]], id_col: str, k: int, damp: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ordered lists (rows, order)."""
    ranked = [placed(df, order).select(id_col, (1.0 / (damp + F.col("place"))).alias("s")) for df, order in lists]
    both = reduce(DataFrame.unionByName, ranked)
    return both.groupBy(id_col).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def retrieve(seed: DataFrame, edges: DataFrame, expand: int, each: int) -> DataFrame:
    """(id, origin): seed rows (vec_id, dist), and the heaviest relations of the nearest of them that aren't seeds."""
    top = seed.orderBy("dist", "vec_id").limit(expand).select(F.col("vec_id").alias("src"))
    near = first_per_group(edges.join(F.broadcast(top), "src"), ["src"], [F.desc("weight"), F.col("dst")], each)
    new = near.select(F.col("dst").alias("id")).distinct().join(F.broadcast(seed.select(F.col("vec_id").alias("id"))), "id", "left_anti")
    return seed.select(F.col("vec_id").alias("id"), F.lit("seed").alias("origin")).unionByName(new.withColumn("origin", F.lit("related")))


def linear(weights: dict[str, float], bias: float) -> Column:
    return reduce(lambda a, kv: a + F.col(kv[0]) * kv[1], weights.items(), F.lit(bias))
