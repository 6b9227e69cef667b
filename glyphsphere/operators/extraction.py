"""Edges out of a model's tensors: rows of attention weights, projected embeddings, rows of other modalities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsphere.operators.topk import batch_knn, group_knn

# Parts of tensor names that tell attention weights and projections, and the letters of the latter.
ATTENTION = r"attn\.(q_proj|k_proj|v_proj|o_proj)\.weight"
PROJECTIONS = {"q_proj": "q", "k_proj": "k", "v_proj": "v", "fc1": "up", "up_proj": "up"}
# Fixed value: vectors of a smaller norm are left out.
LEAST_NORM = 0.01

#: Bytes of a weight matrix that a pass over the embeddings holds at once.
SLICE_BYTES = 32 << 20


def layer(name: Column) -> Column:
    """Number after ``layers.`` (or ``layer.``) in a tensor's name, else -1."""
    n = F.regexp_extract(name, r"layers?\.(\d+)", 1)
    return F.when(n == "", -1).otherwise(n.cast("int"))


def attention_edges(rows: DataFrame, k: int = 8, least: float = 0.1, most: int = 512) -> DataFrame:
    """(tensor, layer, component, src, dst, relation_type, weight) between rows of attention weights (tensor, row, values).

    Of a tensor of n rows every max(1, n div ``most``)-th one counts, about ``most`` of them: the sampling is the operator's own.
    Each row's k nearest by cosine give an edge where they reach ``least`` and come after it.
    """
    found = rows.filter(F.col("tensor").rlike(ATTENTION))
    strides = found.groupBy("tensor").agg(F.greatest(F.lit(1), F.floor((F.max("row") + 1) / most)).alias("stride"))
    taken = found.join(strides, "tensor").filter(F.col("row") % F.col("stride") == 0)
    near = group_knn(taken, k, "tensor", id_col="row", vec_col="values").filter((F.col("score") >= least) & (F.col("src") < F.col("dst")))
    return near.select("tensor", layer(F.col("tensor")).alias("layer"), F.regexp_extract("tensor", ATTENTION, 1).alias("component"), "src", "dst", F.lit("A").alias("relation_type"), F.col("score").alias("weight"))


def chosen_projections(rows: DataFrame, width: int, least_rows: int = 64, most: int = 2) -> list[tuple[str, int, str, int]]:
    """(tensor, layer, kind, rows) of the first projection of each layer and kind by name that takes vectors of ``width`` and has
    ``least_rows`` rows; the first ``most`` of these. A model names its tensors in thousands at most."""
    kind = F.coalesce(*(F.when(F.col("tensor").contains(part), letter) for part, letter in PROJECTIONS.items()))
    named = rows.filter(F.size("values") == width).groupBy("tensor").agg((F.max("row") + 1).alias("n"))
    named = named.withColumns({"kind": kind, "layer": layer(F.col("tensor"))}).filter(F.col("kind").isNotNull() & (F.col("n") >= least_rows))
    first = named.groupBy("layer", "kind").agg(F.min(F.struct("tensor", "n")).alias("t")).select("t.tensor", "layer", "kind", "t.n").orderBy("tensor").limit(most)
    return [tuple(r) for r in first.collect()]


def projected(embeddings: DataFrame, rows: DataFrame, tensor: str, n: int, width: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, values): each vector's products with the ``n`` rows of a weight matrix, in their order.

    The matrix is taken in slices of 32 MB, each one matrix product a batch; a row that the matrix lacks counts as zeros.
    """
    out = _unprojected(embeddings, width, id_col, vec_col)
    step = max(1, SLICE_BYTES // (8 * width))
    for first in range(0, n, step):
        part = rows.filter((F.col("tensor") == tensor) & F.col("row").between(first, min(n, first + step) - 1)).select("row", F.col("values").cast("array<double>")).collect()
        w = np.zeros((min(step, n - first), width))
        for at, values in part:
            w[at - first] = values
        out = out.mapInArrow(_times(w), PRODUCTS)
    return out.select(F.col("id").alias(id_col), F.col("p").alias("values"))


PRODUCTS = "id long, v array<double>, p array<double>"


def _unprojected(embeddings: DataFrame, width: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, p) of the vectors of a width, without any product."""
    return embeddings.filter(F.size(vec_col) == width).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.array().cast("array<double>").alias("p"))


def _times(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                old = part.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                p = np.concatenate([old, v @ w.T], axis=1)
                ends = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["id", "v", "p"])

    return run


def triangle(rows: DataFrame, tensor: str, width: int) -> np.ndarray:
    """R of the QR decomposition of a weight matrix W with rows of ``width``: R'R = W'W, so the vectors R v have the same lengths and
    inner products as W v, in ``width`` numbers. Each task reduces its rows to one triangle, and one task these to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            step = max(width, SLICE_BYTES // (8 * width))
            for at in range(0, len(v), step):
                r = np.linalg.qr(np.concatenate([r, v[at : at + step]]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["values"])

    part = rows.filter((F.col("tensor") == tensor) & (F.size("values") == width)).select(F.col("values").cast("array<double>").alias("values"))
    found = part.mapInArrow(run, "values array<double>").repartition(1).mapInArrow(run, "values array<double>").collect()
    return np.array([r[0] for r in found]).reshape(-1, width)


def projection_edges(embeddings: DataFrame, rows: DataFrame, width: int, k: int = 5, least: float = 0.7, least_rows: int = 64, most: int = 2) -> DataFrame:
    """(component, src, dst, weight): k nearest by cosine of the vectors once projected, for each chosen projection apart.

    A matrix of more rows than ``width`` is replaced by its triangle, which leaves all cosines and norms as they are, so that no
    vector gets longer than the embeddings are."""
    out = None
    for tensor, number, kind, n in chosen_projections(rows, width, least_rows, most):
        if n > width:
            p = _unprojected(embeddings, width).mapInArrow(_times(triangle(rows, tensor, width)), PRODUCTS)
            p = p.select(F.col("id").alias("vec_id"), F.col("p").alias("values"))
        else:
            p = projected(embeddings, rows, tensor, n, width)
        p = p.filter(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x) >= LEAST_NORM**2)
        edges = batch_knn(p, p, k, vec_col="values", least=least)
        edges = edges.select(F.lit(f"L{number}/{kind}").alias("component"), "src", "dst", F.col("score").alias("weight"))
        out = edges if out is None else out.unionByName(edges)
    return embeddings.sparkSession.createDataFrame([], "component string, src long, dst long, weight double") if out is None else out


def modality_edges(rows: DataFrame, tokens: DataFrame, k: int = 15, least: float = 0.5) -> DataFrame:
    """(component, src, dst, relation_type, weight) from rows (component, vec_id, embedding) of other modalities, such as POSITIONAL,
    MOE_ROUTER or a modality's name, to the k tokens (vec_id, embedding) nearest by cosine; norms under 0.01 don't count."""
    long = lambda df: df.filter(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x) >= LEAST_NORM**2)
    near = batch_knn(long(rows), long(tokens), k, least=least, itself=True)
    return near.join(rows.select(F.col("vec_id").alias("src"), "component"), "src").select("component", "src", "dst", F.lit("C").alias("relation_type"), F.col("score").alias("weight"))
