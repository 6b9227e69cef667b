"""Language ID by rank-order profiles: a text's most frequent n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from glyphsphere.llm.common import code_points, fold_table, text_slices

#: N-grams of a profile (of 1 to 3 characters); documents learned from, about, per language.
PROFILE, SAMPLE_DOCS = 300, 2000
UNKNOWN = "und"


def _tables(cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Of every code point: is it a letter; its lower case (where that is one code point)."""
    if not cache:
        cache["letter"] = fold_table(str.isalpha, bool)
        cache["lower"] = fold_table(lambda c: ord(low) if len(low := c.lower()) == 1 else ord(c))
    return cache["letter"], cache["lower"]


def _grams(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text, packed in 21 bits a character, and their counts. Whatever is no letter is one space
    between words; n-grams lie within a padded word."""
    letter, lower = _tables()
    is_letter = letter[cps]
    a = np.zeros(len(cps) + 2, np.uint64)
    a[1:-1] = np.where(is_letter, lower[cps], 0)
    a = a[np.r_[True, (a[1:] != 0) | (a[:-1] != 0)]]
    two = a[:-1] << np.uint64(21) | a[1:]
    three = two[:-1] << np.uint64(21) | a[2:]
    all_ = np.concatenate((a[a != 0], two | np.uint64(1) << np.uint64(62), three[a[1:-1] != 0] | np.uint64(1) << np.uint64(63)))
    all_.sort()
    at = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]])
    return all_[at], np.diff(np.r_[at, len(all_)])


def _top(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, ties by the n-gram."""
    if len(grams) > k:  # only what can be among them
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:k]]


@dataclass
class Profiles:
    """``rank[l, u]``: the place of n-gram ``grams[u]`` in language ``l``'s profile, or ``size``."""

    langs: list[str]
    grams: np.ndarray
    rank: np.ndarray
    size: int

    def closest(self, cps: np.ndarray) -> tuple[str, float]:
        """The language with the least out-of-place distance (ties: first by name) and 1 - distance / largest possible."""
        if not self.langs or not _tables()[0][cps].any():
            return UNKNOWN, 0.0
        own = _top(*_grams(cps), self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        place = np.where(known, self.rank[:, at], self.size)
        off = np.where(place < self.size, np.abs(place - np.arange(len(own))), self.size).sum(1)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (self.size * len(own)))


def learn(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE_DOCS) -> Profiles:
    """Profiles from labelled rows. Each language is learned from about ``sample`` of its documents at most, chosen by a
    hash of the id. On the driver: a count and ``size`` n-grams per language."""
    train = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    if not counts:
        return Profiles([], np.zeros(0, np.uint64), np.zeros((0, 0), np.int64), size)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(1e6 * min(1, sample / n)))]), F.col(lang_col))
    chosen = train.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            for lang in np.unique(langs):
                grams: list[np.ndarray] = []
                ns: list[np.ndarray] = []
                column = batch.column(1).filter(pa.array(langs == lang))
                for lo, hi in text_slices(column):
                    cps, starts = code_points(column.slice(lo, hi - lo))
                    for a, b in zip(starts[:-1], starts[1:], strict=True):
                        g, n = _grams(cps[a:b])
                        grams.append(g)
                        ns.append(n)
                g, back = np.unique(np.concatenate(grams), return_inverse=True)
                n = np.bincount(back, np.concatenate(ns)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    total = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # negative numbers are the three-character n-grams: they come last, as unsigned
    w = Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("gram") < 0).asc(), "gram")
    rows = total.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= size).collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))
    rank = np.full((len(langs), len(grams)), size, np.int64)
    for r in rows:
        rank[langs.index(r["lang"]), np.searchsorted(grams, np.array([r["gram"]], np.int64).view(np.uint64)[0])] = r["place"] - 1
    return Profiles(langs, grams, rank, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) of each whole text; ``und`` and 0 for a null text or one without
    a letter. Repeated rows and other columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, found = batch.column(at), []
            for lo, hi in text_slices(column):
                cps, starts = code_points(column.slice(lo, hi - lo))
                found += [model.value.closest(cps[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            out = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)
