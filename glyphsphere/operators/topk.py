"""Top-k shapes: one query against a table, one query per row, and set-at-a-time joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.sources.storage import cut


def nearest(df: DataFrame, score: Column, k: int, id_col: str, ascending: bool = True, name: str = "dist") -> DataFrame:
    """The ``k`` rows with the least (or largest) score, ties by id: a heap of k rows a task, no shuffle of the table."""
    s = F.col(name).asc() if ascending else F.col(name).desc()
    return df.withColumn(name, score).orderBy(s, id_col).limit(k)


def first_per_group(df: DataFrame, keys: list[str], order: list, k: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def with_query(df: DataFrame, query: DataFrame, prefix: str = "q_") -> DataFrame:
    """Each row beside the one row of ``query``, its columns prefixed."""
    return df.crossJoin(F.broadcast(query.limit(1).select(*(F.col(c).alias(prefix + c) for c in query.columns))))


def with_fallback(ids: DataFrame, one: DataFrame, two: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """``ids`` with values from ``one``, else from ``two``, else null."""
    first = one.select(key, F.struct(*values).alias("__one"))
    second = two.select(key, F.struct(*values).alias("__two"))
    both = ids.join(first, key, "left").join(second, key, "left").withColumn("__v", F.coalesce("__one", "__two"))
    return both.select(*ids.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def matching(df: DataFrame, payload: dict) -> DataFrame:
    """Rows whose columns equal all of the given values; the scan gets each as a filter."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), payload.items(), df)


def page(df: DataFrame, by: str, id_col: str, size: int = 20, after=None, before=None) -> DataFrame:
    """``size`` rows (100 at most) by falling ``by``, after or before the row with a given id, with ``has_more``: one row more
    than asked for is read. Without a cursor: the first page."""
    size = min(size, 100)
    cursor = after if before is None else before
    rows = df if cursor is None else with_query(df, df.filter(F.col(id_col) == cursor))
    falling = before is None
    if cursor is not None:
        key, mark = F.struct(-F.col(by), id_col), F.struct(-F.col(f"q_{by}"), f"q_{id_col}")
        rows = rows.filter(key > mark if falling else key < mark)
    order = [F.desc(by), F.asc(id_col)] if falling else [F.asc(by), F.desc(id_col)]
    found = rows.select(*df.columns).orderBy(*order).limit(size + 1).withColumn("__place", F.row_number().over(Window.orderBy(*order)))  # 101 rows at most
    return found.withColumn("has_more", F.max("__place").over(Window.partitionBy()) > size).filter(F.col("__place") <= size).drop("__place")


def placed(df: DataFrame, order: list, name: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place from 1 in a total order. Ranges of the order are ranked apart and shifted by the rows of the
    ranges before them, one number each on the driver; no task gets the whole table."""
    spread = df.repartitionByRange(*([parts] if parts else []), *order).withColumn("__range", F.spark_partition_id())
    spread = cut(spread)
    rows = sorted((r[0], r[1]) for r in spread.groupBy("__range").count().collect())
    before, total = [], 0
    for k, n in rows:
        before.append((k, total))
        total += n
    if not rows:
        return spread.drop("__range").withColumn(name, F.lit(0).cast("bigint"))
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before for x in kv]), F.col("__range"))
    return spread.withColumn(name, (F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + shift).cast("bigint")).drop("__range")


#: Vectors of a tile at most, and their bytes as doubles: a tile of queries is held, and a tile of the base streams past it.
BLOCK, TILE_BYTES = 32_768, 32 << 20
#: Queries and base rows of one matrix product.
ROWS, COLUMNS = 1024, 4096
#: Tiles of a table that has some thousands of rows, at least, so that all cores have work.
LEAST_TILES = 6
#: Rows of an output batch, and bytes of the vectors whose scores are computed at once.
OUT_ROWS, PAIR_BYTES = 1 << 16, 16 << 20


def batch_knn(queries: DataFrame, base: DataFrame, k: int | None, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None, itself: bool = False) -> DataFrame:
    """(src, dst, score): exact ``k`` best of ``base`` for each row of ``queries``; ``cosine`` falls, ``l2`` rises.

    Both sides are cut into tiles; a task holds one tile of queries with the best so far and the tile of the base streams past it
    in matrix products, so memory is a tile's, whatever the table. All pairs are looked at, but what is shuffled is each side
    once a tile of the other, and k candidates a query and tile of the base. Ties go to the smaller id. Only scores of ``least`` or
    more count. Without ``k`` all pairs that reach ``least`` come out.
    """
    q, b = (df.select(F.lit("").alias("grp"), F.col(id_col).cast("long").alias("id"), _vector(df, vec_col)) for df in (queries, base))
    shares = _tiles(b)
    parts = shares if queries is base else _tiles(q)
    found = _compared(*_dealt(q, b, F.lit(parts), F.lit(shares)), k, metric, least, itself, parts * shares).drop("grp")
    if k is None:
        return found
    return first_per_group(found, ["src"], _best_first(metric), k)


def _best_first(metric: str) -> list[Column]:
    order = F.round("score", 12)
    return [order.desc() if metric == "cosine" else order.asc(), F.col("dst")]


def _vector(df: DataFrame, name: str) -> Column:
    """Floats stay floats, which halves what is shuffled; anything else becomes doubles."""
    return (F.col(name) if df.schema[name].dataType.simpleString() == "array<float>" else F.col(name).cast("array<double>")).alias("v")


def _tiles(rows: DataFrame) -> int:
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return max(1, -(-n // _tile_rows(max(1, d or 1))), min(LEAST_TILES, -(-n // 2048)))


def _tile_rows(d: int) -> int:
    return max(1, min(BLOCK, TILE_BYTES // (8 * d)))


def _dealt(q: DataFrame, b: DataFrame, parts: Column, shares: Column) -> tuple[DataFrame, DataFrame]:
    """Queries and base (grp, id, v) with ``part`` and ``share``: each query is in its part of every share, each row of the base in its
    share of every part."""
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    q = q.select("grp", own(parts).alias("part"), every(shares).alias("share"), "id", "v")
    return q, b.select("grp", every(parts).alias("part"), own(shares).alias("share"), "id", "v")


def _compared(q: DataFrame, b: DataFrame, k: int | None, metric: str, least: float | None, itself: bool, units: int | None = None) -> DataFrame:
    """(grp, src, dst, score): the k best base rows of each (grp, part, share) for each of its queries."""
    side = lambda df, n: df.select("grp", "part", "share", F.lit(n).alias("side"), "id", "v")
    if q.schema["v"].dataType != b.schema["v"].dataType:
        q, b = (df.withColumn("v", F.col("v").cast("array<double>")) for df in (q, b))
    unit = ["grp", "part", "share"]
    both = side(q, 0).unionByName(side(b, 1))
    both = both.repartition(units, *unit) if units else both.repartition(*unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            for key, asks, ids, v in _pieces(batch):
                if key != now:
                    if tile:
                        yield from tile.end()
                    now, tile = key, _Tile(key[0], k, metric, least, itself)
                if asks:
                    tile.ask(ids, v)
                else:
                    yield from tile.meet(ids, v)
        if tile:
            yield from tile.end()

    return both.sortWithinPartitions(*unit, "side", "id").mapInArrow(run, "grp string, src long, dst long, score double")


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """((grp, part, share), whether it is queries, ids, vectors) of the runs of a batch that is sorted by them."""
    grp, part, share, side, ids, v = batch.columns
    codes = [grp.dictionary_encode().indices.to_numpy(), *(c.to_numpy() for c in (part, share, side))]
    ends = np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in codes))) + 1
    for a, z in zip([0, *ends], [*ends, len(batch)], strict=True):
        if z > a:
            rows = v.slice(a, z - a)
            yield (grp[int(a)].as_py(), int(codes[1][a]), int(codes[2][a])), codes[3][a] == 0, ids.slice(a, z - a).to_numpy(), rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


class _Tile:
    """A tile of queries, each with its best of the base rows that came so far, in order of id.

    A product of matrices only chooses which pairs may count, with a margin for its rounding errors: for ``cosine`` of unit vectors in single
    precision, for ``l2`` of (q, 1) and (b, -b.b/2), whose order is that of the distances. The scores of the chosen pairs are
    then computed one by one in doubles, so they don't depend on tiles, and equal vectors are at distance 0.
    """

    def __init__(self, group: str, k: int | None, metric: str, least: float | None, itself: bool):
        self.group, self.k, self.cosine, self.least, self.itself = group, k, metric == "cosine", least, itself
        self.asked, self.held, self.n, self.ids = [], [], 0, None

    def ask(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.asked.append((ids, v))

    def meet(self, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.asked and self.ids is None:
            return
        self.held.append((ids, v))
        self.n += len(ids)
        if self.n >= COLUMNS:
            yield from self._flush()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from self._flush()
        if self.k and self.ids is not None:
            for at in range(0, len(self.ids), ROWS):
                rows, cols = np.nonzero(self.best[at : at + ROWS] > -np.inf)
                yield from self._batches(self.ids[at + rows], self.dst[at + rows, cols], self.score[at + rows, cols])

    def _batches(self, src: np.ndarray, dst: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(src), OUT_ROWS):
            cut_ = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([self.group] * len(src[cut_]), pa.string()), *map(pa.array, (src[cut_], dst[cut_], score[cut_]))], ["grp", "src", "dst", "score"])

    def _sized(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and the vectors as factors of a product: unit vectors for ``cosine``, where a vector without a direction is zero."""
        wide = v.astype(np.float64)
        with np.errstate(all="ignore"):
            norm = np.linalg.norm(wide, axis=1)
            if not self.cosine:
                return norm, wide
            return norm, np.where(np.isfinite(norm) & (norm > 0), 1, 0)[:, None] * np.nan_to_num(wide / norm[:, None], posinf=0, neginf=0).astype(np.float32)

    def _flush(self) -> Iterator[pa.RecordBatch]:
        if self.ids is None:
            self.ids, self.v = (np.concatenate(x) for x in zip(*self.asked, strict=True))
            self.asked = []
            self.norm, self.left = self._sized(self.v)
            if not self.cosine:
                self.left = np.hstack([self.left, np.ones((len(self.left), 1))])
            self.left = self.left.astype(np.float32 if self.cosine else np.float64)
            if self.k:
                self.best, self.dst, self.score = np.full((len(self.ids), self.k), -np.inf), np.zeros((len(self.ids), self.k), np.int64), np.zeros((len(self.ids), self.k))
        ids, v = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        for at in range(0, len(ids), COLUMNS):
            yield from self._block(ids[at : at + COLUMNS], v[at : at + COLUMNS])

    def _block(self, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        norm, right = self._sized(v)
        with np.errstate(all="ignore"):
            right = right.astype(np.float32) if self.cosine else np.hstack([right, -(norm**2)[:, None] / 2])
        most = float(np.max(norm, initial=0, where=np.isfinite(norm)))
        for at in range(0, len(self.ids), ROWS):
            some = slice(at, at + ROWS)
            with np.errstate(all="ignore"):
                t = self.left[some] @ right.T
            if not self.itself:
                first, end = np.searchsorted(ids, self.ids[some]), np.searchsorted(ids, self.ids[some], "right")
                while len(own := np.flatnonzero(first < end)):
                    t[own, first[own]] = -np.inf
                    first[own] += 1
            bound = self._bound(t, some, most, v.shape[1])
            places = np.flatnonzero(t > bound[:, None].astype(t.dtype))
            if len(places):
                rows, cols = np.divmod(places, t.shape[1])
                yield from self._chosen(at, rows, cols, ids, v, norm)

    def _bound(self, t: np.ndarray, some: slice, most: float, d: int) -> np.ndarray:
        """What a product must exceed to count, for each query: less than that of the k-th best so far, by more than errors may be."""
        norm = np.where(np.isfinite(self.norm[some]), self.norm[some], 0)
        if self.cosine:
            margin = np.full(len(t), (d + 8) * 1.2e-7)
        else:
            margin = (d + 8) * 2.3e-16 * (norm + most) ** 2
        lowest = -np.inf if self.least is None or not self.cosine else self.least - margin[0]
        if not self.k:
            return np.full(len(t), lowest)
        worst = self.best[some, -1]
        with np.errstate(all="ignore"):
            bound = worst - margin if self.cosine else (norm**2 - worst**2) / 2 - 2 * margin
        new = worst == -np.inf
        bound[new] = -np.inf
        seen = min(t.shape[1], max(512, 4 * self.k))
        if lowest == -np.inf and seen > self.k and new.any():
            with np.errstate(all="ignore"):
                bound[new] = np.partition(np.nan_to_num(t[new, :seen], nan=-np.inf, neginf=-np.inf), seen - self.k, axis=1)[:, seen - self.k] - 4 * margin[new]
        return np.maximum(bound, lowest)

    def _chosen(self, at: int, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Puts the chosen pairs among the best of their queries, or gives them out."""
        s, step = np.empty(len(rows)), max(1, PAIR_BYTES // (8 * v.shape[1]))
        for a in range(0, len(rows), step):
            r, c = at + rows[a : a + step], cols[a : a + step]
            left, right = self.v[r].astype(np.float64), v[c].astype(np.float64)
            with np.errstate(all="ignore"):
                s[a : a + step] = np.nan_to_num(np.einsum("ij,ij->i", left, right) / (self.norm[r] * norm[c])) if self.cosine else np.sqrt(((left - right) ** 2).sum(1))
        good = np.isfinite(s) if self.least is None else s >= self.least
        if not self.itself:
            good &= self.ids[at + rows] != ids[cols]
        if not self.k:
            yield from self._batches(self.ids[at + rows[good]], ids[cols[good]], s[good])
            return
        key = np.round(s, 12) * (1 if self.cosine else -1)
        good &= key > self.best[at + rows, -1]  # an equal one has a larger id
        rows, key, dst, s = at + rows[good], key[good], ids[cols[good]], s[good]
        if not len(rows):
            return
        touched = np.unique(rows)
        old = self.best[touched] > -np.inf
        rows = np.concatenate([np.repeat(touched, old.sum(1)), rows])
        key, dst, s = (np.concatenate([x[touched][old], y]) for x, y in ((self.best, key), (self.dst, dst), (self.score, s)))
        order = np.lexsort((-key, rows))  # stable: of equal ones those with smaller ids come first
        rows, key, dst, s = rows[order], key[order], dst[order], s[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        for x, y in ((self.best, key), (self.dst, dst), (self.score, s)):
            x[rows[kept], place[kept]] = y[kept]


def knn_within(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", least: float | None = None, itself: bool = False) -> DataFrame:
    """(grp, src, dst, score): the k best rows of ``base`` for each query in each group (grp, id, v) that both have, group by group
    and tile by tile; not yet ranked over the tiles of a group.

    A group of any size is dealt into tiles of queries and of base rows, and each tile of queries meets every one of the base, so that
    no task holds a large group.
    """
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(TILE_BYTES) / (8 * F.greatest(F.lit(1), F.max(F.size("v")))))))
    size = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    groups = size(base, "shares").join(size(queries, "parts"), "grp")
    q, b = queries.join(groups, "grp"), base.join(groups, "grp")
    return _compared(*_dealt(q, b, F.col("parts"), F.col("shares")), k, metric, least, itself)


def group_knn(df: DataFrame, k: int, group: str, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None) -> DataFrame:
    """(group, src, dst, score, rank): exact k best for each row among the others of its group; ties go to the smaller id."""
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return first_per_group(knn_within(rows, rows, k, metric, least), ["grp", "src"], _best_first(metric), k).withColumnRenamed("grp", group)
