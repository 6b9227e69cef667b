"""Relations: typed weighted edges, their upserts, ratings and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsphere.operators.topk import batch_knn

# First rating, K factor, its decay and floor, rating scale and ceiling.
FIRST, K, DECAY, FLOOR, SCALE, TOP = 1500.0, 32.0, 0.95, 4.0, 400.0, 3000.0


def knn_edges(df: DataFrame, k: int, least: float, kind: str, quality: float = 1.0) -> DataFrame:
    """(src, dst, relation_type, weight): the k nearest by cosine that reach a threshold; weight times quality."""
    return batch_knn(df, df, k, least=least).select("src", "dst", F.lit(kind).alias("relation_type"), (F.col("score") * quality).alias("weight"))


def elo_step(rating: Column, weight: Column, seen: Column, mode: str = "max") -> Column:
    """One update of a rating by a weight in [-1, 1]. ``mode`` min: the K factor is at most the floor, without clamp."""
    k = F.lit(K) * F.pow(F.lit(DECAY), seen)
    k = F.greatest(k, F.lit(FLOOR)) if mode == "max" else F.least(k, F.lit(FLOOR))
    new = rating + k * ((weight + 1.0) / 2.0 - 1.0 / (1.0 + F.exp(-(rating - FIRST) / SCALE)))
    return F.greatest(F.lit(0.0), F.least(F.lit(TOP), new)) if mode == "max" else new


def elo_fold(obs: DataFrame, keys: list[str], order: list[str], weight: str, mode: str = "max") -> DataFrame:
    """(keys, rating, observations): ratings after all observations of a key, in order. The order matters, so a key's weights
    come together, as a sorted array of (order, weight)."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(weight).cast("double").alias("__w"))))
    start = F.struct(F.lit(FIRST).alias("r"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(elo_step(a["r"], x["__w"], a["n"], mode).alias("r"), (a["n"] + 1).alias("n"))
    return obs.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("e")).select(*keys, F.col("e.r").alias("rating"), F.col("e.n").cast("bigint").alias("observations"))


def consensus(evidence: DataFrame, keys: list[str], rating: str = "rating", seen: str = "observations", population: bool = False) -> DataFrame:
    """Mean rating, spread, weight and confidence over the models of a key; a single model has full confidence."""
    spread = F.stddev_pop(rating) if population else F.stddev_samp(rating)
    out = evidence.groupBy(*keys).agg(F.avg(rating).alias("avg_rating"), spread.alias("rating_stddev"), F.count("*").alias("num_models"), F.sum(seen).alias("total_observations"))
    return out.withColumns({"consensus_weight": F.tanh((F.col("avg_rating") - FIRST) / SCALE), "confidence": 1.0 / (1.0 + F.coalesce("rating_stddev", F.lit(0.0)) / SCALE)})


def merged(edges: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """One row per key with ``weight`` (mean or max of all) and ``source_count``."""
    w = F.avg("weight") if how == "mean" else F.max("weight")
    return edges.groupBy(*keys).agg(w.alias("weight"), F.count("*").alias("source_count"))


def loaded(new: DataFrame, old: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) once the edges ``new`` (src, dst, weight) are loaded into ``old`` (with source_count) and ``nodes`` (node).

    Each new edge counts once, with its largest weight, as one more source of the running mean; endpoints that are missing
    become nodes.
    """
    once = new.groupBy("src", "dst").agg(F.max("weight").alias("__new"))
    n = F.coalesce("source_count", F.lit(0)).cast("bigint")
    more = F.col("__new").isNotNull()
    mean = F.when(~more, F.col("weight")).when(n > 0, (F.col("weight") * n + F.col("__new")) / (n + 1)).otherwise(F.col("__new"))
    edges = old.select("src", "dst", "weight", "source_count").join(once, ["src", "dst"], "full").select("src", "dst", mean.alias("weight"), (n + more.cast("bigint")).alias("source_count"))
    ends = once.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return edges, nodes.unionByName(ends.join(nodes, "node", "left_anti"))


def scores_of(scores: DataFrame, model: str, tensors: DataFrame) -> DataFrame:
    """(tensor, score): the best known score of each of a model's listed tensors."""
    known = scores.filter((F.col("model") == model) & F.col("score").isNotNull())
    return known.join(tensors.select("tensor").distinct(), "tensor", "left_semi").groupBy("tensor").agg(F.max("score").alias("score"))


def neighbours(edges: DataFrame, node, k: int) -> DataFrame:
    """The k heaviest neighbours in both directions, each once."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("node"), "weight")
    into = edges.filter(F.col("dst") == node).select(F.col("src").alias("node"), "weight")
    return out.unionByName(into).distinct().orderBy(F.desc("weight"), "node").limit(k)


def jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the neighbour sets of given pairs; 0 if either has none."""
    sets = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src").agg(F.collect_set("dst").alias("s"))
    j = pairs.join(sets.select(F.col("src").alias("a"), F.col("s").alias("sa")), "a", "left").join(sets.select(F.col("src").alias("b"), F.col("s").alias("sb")), "b", "left")
    both, either = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return j.select("a", "b", F.when(F.col("sa").isNull() | F.col("sb").isNull(), 0.0).otherwise(both / either).alias("jaccard"))
