"""Substring dedup: suffix automata of reference shards give matching statistics; long repeated spans are removed.

A window is 20 consecutive words. A word goes if a window over it also starts at an earlier place of the corpus. The
reference of a document is everything before it, which no broadcast can hold. So the reference is cut into shards that
documents can be routed to: equal windows have equal minimizers (the 6-word gram with the smallest hash, leftmost), and
the windows of one minimizer's occurrence are consecutive, a *piece* of 20 to 34 words. Only pieces whose minimizer
occurs twice or more go on. A shard holds the pieces of one minimizer (of a very frequent one: those with a window in
one class of window hashes). In it, pieces stream in order of place past the automaton of the pieces before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphsphere.llm.common import code_points, materialize, release, text_slices
from glyphsphere.llm.near_dedup import _A, _mix, _powers

#: Words of a window and of a minimizer gram; occurrences of a minimizer above which its shard is split.
WINDOW, GRAM, SHARD = 20, 6, 2000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Generalized suffix automaton over words. Each state keeps where its strings first ended."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]

    def _state(self, length: int, link: int, end: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The state of word-moves into ``q`` from ``p`` up, apart from the longer strings of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.end[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str], at: int) -> None:
        """One more text; its words are numbered from ``at``."""
        last = 0
        for end, word in enumerate(words, at):
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
                continue
            new, p = self._state(self.length[last] + 1, 0, end, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def matches(self, words: list[str], least: int) -> list[int]:
        """For each word that ends a match of ``least`` words or more: where those ``least`` words first ended; else -1."""
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            at = state
            if size >= least:
                while self.length[self.link[at]] >= least:
                    at = self.link[at]
            out.append(self.end[at] if size >= least else -1)
        return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def matching_spans(text: str | None, automaton: SuffixAutomaton, least: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans (first word, end) of a text whose every word lies in a match of ``least`` words with the reference."""
    spans: list[tuple[int, int]] = []
    for i, end in enumerate(automaton.matches(words_of(text), least)):
        if end >= 0:
            a, b = i - least + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def pieces(cps: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, minimizer hash, first window, last window) of the pieces of a batch of texts; windows count words from 0."""
    inside = ~((cps == 32) | ((cps >= 9) & (cps <= 13)))
    begin, end = inside.copy(), inside.copy()
    inner = starts[(starts > 0) & (starts < len(cps))]
    begin[1:] &= ~inside[:-1]
    begin[inner] = inside[inner]
    end[:-1] &= ~inside[1:]
    end[inner - 1] = inside[inner - 1]
    at, to = np.flatnonzero(begin), np.flatnonzero(end) + 1
    many = len(at) - window + 1
    if many < 1:
        return (np.zeros(0, np.int64),) * 4
    power, inverse = _powers(len(cps))
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * power[: len(cps)], out=sums[1:])
    word = _mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64))
    grams = np.zeros(len(word) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * _A + word[k : k + len(grams)]
    grams = _mix(grams)
    least, where = grams[:many].copy(), np.zeros(many, np.int64)
    for k in range(1, window - gram + 1):
        smaller = grams[k : k + many] < least
        least = np.where(smaller, grams[k : k + many], least)
        where[smaller] = k
    bound = np.searchsorted(at, starts)
    row = np.searchsorted(bound, np.arange(len(word)), "right") - 1
    valid = row[:many] == row[window - 1 :]
    start = np.flatnonzero(valid)
    anchor = start + where[start]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]])]) if len(start) else start
    last = np.r_[first[1:], len(start)] - 1
    r = row[start[first]]
    return r, least[start[first]].view(np.int64), start[first] - bound[r], start[last] - bound[r]


def _keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())


def _occurrences(rows: DataFrame) -> DataFrame:
    """(h, doc, version, first, last): every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(2)):
                r, h, first, last = pieces(*code_points(batch.column(2).slice(lo, hi - lo)))
                r = pa.array(r + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), batch.column(0).take(r), batch.column(1).take(r), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["h", "doc", "version", "first", "last"]
                )

    return rows.mapInArrow(run, "h long, doc long, version long, first int, last int")


def _class(words: list[str], classes: int) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little") % classes


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, part, parts, piece, place, n), sorted by (h, part, place), to (h, part, piece hash, segments): for each run of
    windows of a piece, where the same windows first start."""
    key, automaton, index, owner = None, SuffixAutomaton(), 0, []
    names = ["h", "part", "p", "q", "from", "to", "doc", "version", "start"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    for batch in batches:
        out = []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "part", "parts", "piece", "p", "q", "doc", "version", "start", "n")]
        for h, part, parts, piece, p, q, doc, version, start, n in zip(*columns, strict=True):
            if (h, part) != key:
                key, automaton, index, owner = (h, part), SuffixAutomaton(), 0, []
            words = piece.split(" ")
            ends = automaton.matches(words, WINDOW)[WINDOW - 1 :]
            runs: list[list] = []
            new = False
            for i, end in enumerate(ends):
                if parts > 1 and _class(words[i : i + WINDOW], parts) != part:
                    continue
                if end < 0:
                    new, source = True, (doc, version, start + i)
                    if n == 1:
                        continue
                else:
                    d, v, s, at = owner[end]
                    source = (d, v, s + at - WINDOW + 1)
                if runs and runs[-1][1] == i - 1 and runs[-1][2:4] == [*source[:2]] and runs[-1][4] + i - runs[-1][0] == source[2]:
                    runs[-1][1] = i
                else:
                    runs.append([i, i, *source])
            if new:
                automaton.add(words, index)
                owner += [(doc, version, start, k) for k in range(len(words))]
                index += len(words)
            out += [(h, part, p, q, *r) for r in runs]
        for lo in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 20_000], strict=True), kinds, strict=True)], names)


def repeated_spans(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, spans): spans (first word, end) of the windows that start earlier too, per text with any.

    Places are ordered by (doc_id, hash of the text, first word), null ids first; rows equal in id and text are one place.
    Equal pieces are one row of a shard, whatever their number: the shuffle combines them before it sends them.
    """
    rows = _keyed(docs, doc_col, text_col)
    spark = docs.sparkSession
    often = materialize(_occurrences(rows).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "frequent", tidy=True)
    found = materialize(_occurrences(rows).join(often, "h"), "minimizers", tidy=True)
    release(spark, often)
    by_doc = found.groupBy("doc", "version").agg(F.collect_list(F.struct("h", "n", "first", "last")).alias("pieces"))
    by_doc = materialize(by_doc, "candidates", tidy=True)
    release(spark, found)
    own = by_doc.select(F.col("doc").alias("d"), F.col("version").alias("v"), "pieces")
    with_text = rows.join(own, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc", "version", "text", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "n", "doc", "version", "start", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            for doc, version, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = words_of(text)
                out += [(x["h"], x["n"], doc, version, x["first"], " ".join(words[x["first"] : x["last"] + WINDOW])) for x in own]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    cuts = with_text.mapInArrow(cut, "h long, n long, doc long, version long, start int, piece string")
    cuts = materialize(cuts.withColumns({"p": F.xxhash64("piece"), "q": F.hash("piece")}), "pieces", tidy=True)
    release(spark, by_doc)

    @F.pandas_udf("array<int>")
    def parts_of(piece, parts):
        def of(text: str, k: int) -> list[int]:
            if k == 1:
                return [0]
            w = text.split(" ")
            return sorted({_class(w[i : i + WINDOW], k) for i in range(len(w) - WINDOW + 1)})

        return pd.Series([of(text, k) for text, k in zip(piece, parts, strict=True)])

    parts = F.ceil(F.col("n") / SHARD).cast("int")
    combined = cuts.groupBy("h", "piece", parts.alias("parts"), "p", "q").agg(F.min(F.struct("doc", "version", "start")).alias("place"), F.count("*").alias("n"))
    dealt = combined.filter("parts = 1").withColumn("part", F.lit(0)).unionByName(combined.filter("parts > 1").withColumn("part", F.explode(parts_of("piece", "parts"))))
    dealt = dealt.select("h", "part", "parts", "piece", "p", "q", "place.*", "n").repartition("h", "part").sortWithinPartitions("h", "part", "doc", "version", "start")
    kind = "h long, part int, p long, q int, from int, to int, doc long, version long, start int"
    segments = materialize(dealt.mapInArrow(_resolved, kind), "segments", tidy=True)
    release(spark)
    source = F.struct(F.col("s.doc").alias("doc"), F.col("s.version").alias("version"), (F.col("s.start") - F.col("s.from")).alias("start"))
    late = cuts.select("h", "p", "q", "doc", "version", "start").alias("c").join(segments.alias("s"), ["h", "p", "q"])
    late = late.filter(source < F.struct(F.col("c.doc").alias("doc"), F.col("c.version").alias("version"), F.col("c.start").alias("start")))
    span = F.struct((F.col("c.start") + F.col("s.from")).alias("first"), (F.col("c.start") + F.col("s.to") + WINDOW).alias("end"))
    late = late.select(F.col("c.doc").alias("doc"), F.col("c.version").alias("version"), span.alias("span")).groupBy("doc", "version").agg(F.collect_list("span").alias("spans"))
    late = materialize(late, "spans", tidy=True)
    release(spark, cuts, segments)
    return late


def deduplicated(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text's kept words joined by one space, and ``n_words``, ``n_removed``.

    All rows and other columns stay. Null text: null, no words. Texts of fewer than 20 words lose nothing.
    """
    spans = repeated_spans(docs, doc_col, text_col).select(F.col("doc").alias("__d"), F.col("version").alias("__v"), F.col("spans").alias("__spans"))
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    keyed = docs.withColumn("__doc", F.col(doc_col).cast("long")).withColumn("__version", F.xxhash64(text_col))
    joined = keyed.join(spans, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__version") == F.col("__v")), "left").select(*names, "__spans")
    at = names.index(text_col)
    fields = [StructField(text_col, StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                words = words_of(text)
                kept = words
                if spans:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, [s["first"] for s in spans], 1)
                    np.add.at(cover, [s["end"] for s in spans], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                texts.append(None if text is None else " ".join(kept))
                total.append(len(words))
                gone.append(len(words) - len(kept))
            cols = [*batch.columns[: len(names)], pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "n_removed"])

    return joined.mapInArrow(run, schema)


def against_reference(docs: DataFrame, reference: list[str], least: int = WINDOW, text_col: str = "text", most_words: int = 2_000_000) -> DataFrame:
    """``docs`` with ``spans`` (first word, end), the maximal spans shared with a bounded reference. Its automaton is broadcast;
    a reference of more than ``most_words`` words is refused: cut it into shards, or use ``deduplicated``."""
    automaton, at = SuffixAutomaton(), 0
    for words in map(words_of, reference):
        automaton.add(words, at)
        at += len(words)
        if at > most_words:
            raise ValueError(f"the reference has more than {most_words} words")
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    spans = F.pandas_udf(lambda s: s.map(lambda t: [list(x) for x in matching_spans(t, shared.value, least)]), "array<array<int>>")
    return docs.withColumn("spans", spans(F.coalesce(F.col(text_col), F.lit(""))))
