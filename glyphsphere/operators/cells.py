"""Approximate nearest neighbours: vectors in cells around centres, of which a query searches the nearest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.operators.topk import _best_first, first_per_group, knn_within

#: Rows that centres and probes are fitted on, at most, and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Most cells, and fitted rows a cell at least.
MOST_CELLS, ROWS_A_CELL = 4096, 16


@dataclass(frozen=True)
class Cells:
    """Unit centres and the number of cells that a query has to search."""

    centres: np.ndarray
    probes: int


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _centres(v: np.ndarray, n: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    centres = v[np.random.default_rng(seed).choice(len(v), n, replace=False)]
    for _ in range(rounds):
        cell = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    whole = ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    some = F.exists(v, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & whole & some).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def fit(df: DataFrame, k: int = 10, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> Cells:
    """Centres by k-means on a sample, and as many probes as find ``recall`` of the sample's true neighbours.

    The sample is the rows whose ids hash lowest: 20,000 rows and 64 MB at most, whatever the table. Neighbours in the whole
    table are nearer than those in the sample, so they share cells at least as often. Vectors of the most frequent dimension
    count. An empty table gives no cells.
    """
    rows = _usable(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return Cells(np.zeros((0, 0)), 0)
    d, total = sizes[0]
    most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    sample = rows.filter(F.size("v") == d).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    v = _unit(np.array([r["v"] for r in sample], dtype=np.float64))
    centres = _centres(v, max(1, min(int(total**0.5), MOST_CELLS, len(v) // ROWS_A_CELL)))
    cell = (v @ centres.T).argmax(1)
    asked = v[:512]
    near = asked @ v.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(v) - 1)]
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(turn, cell[best], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1
    return Cells(centres, probes)


def _in_cells(rows: DataFrame, cells: Cells, n: int) -> DataFrame:
    """(grp, id, v): each vector once for each of its n nearest cells."""
    centres, d = cells.centres, cells.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)
                far = -(v @ centres.T)
                near = far.argmin(1)[:, None] if n == 1 else np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n]
                groups = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), groups], ["id", "v", "cells"])

    placed = rows.filter(F.size("v") == d).mapInArrow(run, "id long, v array<double>, cells array<int>")
    return placed.select(F.explode(F.col("cells").cast("array<string>")).alias("grp"), "id", "v")


def approximate_knn(queries: DataFrame, base: DataFrame, k: int, cells: Cells, id_col: str = "vec_id", vec_col: str = "embedding", itself: bool = False) -> DataFrame:
    """(src, dst, score, rank): about the k best of ``base`` by cosine for each query; every row of ``base`` is in one cell.

    Scores are exact; what a query's cells don't hold is missed. Cells of any size are searched in shares of a block. Vectors
    that are null, all zero, of another dimension or hold no number are left out; without cells there are no rows. Ties go to
    the smaller id.
    """
    if not len(cells.centres):
        none = base.sparkSession.createDataFrame([], "src long, dst long, score double, rank int")
        return none
    q, b = _in_cells(_usable(queries, id_col, vec_col), cells, cells.probes), _in_cells(_usable(base, id_col, vec_col), cells, 1)
    return first_per_group(knn_within(q, b, k, itself=itself).drop("grp"), ["src"], _best_first("cosine"), k)
