"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glyphsphere.llm.common import broadcast_checked, code_points, text_slices

#: Labelled documents learned from, about, at most.
SAMPLE_ROWS = 20_000

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _BANG, _SYMBOL, _BAR, _OTHER = range(10)


def _classes() -> np.ndarray:
    import unicodedata

    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        kind, x = unicodedata.category(chr(c)), chr(c)
        if x == "\n":
            out[c] = _LINE
        elif x.isspace():
            out[c] = _SPACE
        elif kind[0] == "L":
            out[c] = _UPPER if kind == "Lu" else _LOWER
        elif kind[0] == "N":
            out[c] = _DIGIT
        else:
            out[c] = _STOP if x in ".,;:" else _BANG if x in "!?" else _SYMBOL if x in "#$%&*@^~<>=+\\_{}[]" else _BAR if x == "|" else _OTHER
    return out


_CLASS = _classes()
FEATURES = [
    *(f"share_{x}" for x in ("lower", "upper", "digit", "space", "line", "stop", "bang", "symbol", "bar", "other")), "beyond_latin", "log_chars", "log_words", "word_length",
    "line_length", "distinct_words", "distinct_lines", "longest_word", "stops_per_line", "capital_words", "symbols_per_word",
]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text (null: empty)."""
    out = np.zeros((len(column), len(FEATURES)))
    for lo, hi in text_slices(column):
        part = column.slice(lo, hi - lo)
        cps, starts = code_points(part)
        rows, size = hi - lo, np.diff(starts)
        some = np.maximum(size, 1)
        x = out[lo:hi]
        if len(cps):
            cls = _CLASS[np.minimum(cps, 0x24F)]
            cls = np.where(cps >= 0x250, _LOWER, cls)
            row = np.repeat(np.arange(rows, dtype=np.int64), size)
            counts = np.bincount(row * 10 + cls, minlength=rows * 10).reshape(rows, 10)
            x[:, :10] = counts / some[:, None]
            x[:, 10] = np.bincount(row[cps >= 0x250], minlength=rows) / some
            stops = counts[:, _STOP]
            for i, text in enumerate(part.to_pylist()):
                words, lines = (text or "").split(), (text or "").split("\n")
                n = max(1, len(words))
                x[i, 12] = np.log1p(len(words))
                x[i, 13] = (size[i] - counts[i, _SPACE] - counts[i, _LINE]) / n
                x[i, 14] = size[i] / len(lines)
                x[i, 15] = len(set(words)) / n
                x[i, 16] = len(set(lines)) / len(lines)
                x[i, 17] = max(map(len, words), default=0)
                x[i, 18] = stops[i] / len(lines)
                x[i, 19] = sum(map(str.istitle, words)) / n
                x[i, 20] = (counts[i, _SYMBOL] + counts[i, _BANG] + counts[i, _BAR]) / n
        x[:, 11] = np.log1p(size)
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: ``feature`` and ``threshold`` of the inner nodes, ``leaf`` values, a row a tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all rows go down a tree together."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting with logistic loss over histograms of at most ``bins`` bins a feature. No rows: a constant score of one half;
    one label: a constant score near it."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, ends = 2**depth - 1, 2**depth
    features, thresholds, leaves = [], [], []
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, ends)))
    cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])  # bin b: up to cut b
    total, many = np.full(len(y), base), len(y)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node, f, t = np.zeros(many, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            wide = 2**d
            place = node - (wide - 1)
            best, where = np.zeros(wide), np.full((wide, 2), -1)
            for k, b in enumerate(binned):
                key = place * bins + b
                gs, hs = (np.bincount(key, v, wide * bins).reshape(wide, bins).cumsum(1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (ga - gs) ** 2 / (ha - hs + penalty) - ga**2 / (ha + penalty)
                gain[(hs < least) | (ha - hs < least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                better = top > best + 1e-9
                best[better], where[better] = top[better], np.stack((np.full(wide, k), at), 1)[better]
            for i in np.flatnonzero(where[:, 0] >= 0):
                f[wide - 1 + i], t[wide - 1 + i] = where[i, 0], cuts[where[i, 0]][where[i, 1]]
            node = 2 * node + 1 + (x[np.arange(many), f[node]] > t[node])
        place = node - inner
        v = -rate * np.bincount(place, g, ends) / (np.bincount(place, h, ends) + penalty)
        total += v[place]
        features.append(f)
        thresholds.append(t)
        leaves.append(v)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS, **kw) -> Trees:
    """Trees fitted on the documents that have a label. About ``sample`` labelled rows at most, chosen by a hash of their id,
    are joined and go to the driver as statistics. Rows with a null id or label are left out; of several labels of an id the
    largest counts, and each row under a repeated id is learned from. Empty tables: a constant score of one half."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    many = labels.count()
    share = F.lit(int(1e6 * min(1, sample / max(1, many))))
    chosen = labels.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(broadcast_checked(chosen), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    got = sorted(rows.mapInArrow(run, "id long, label int, x array<double>").collect())
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], float), **kw)


def scored(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) of each whole text; null counts as empty and is scored too. Repeated rows
    are scored each; a column ``quality_score`` of ``docs`` is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    docs = docs.drop("quality_score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))
