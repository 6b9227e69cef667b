"""Line dedup: content-defined chunks of lines that occur earlier in the corpus are removed, then what their boundaries cut.

A rolling hash over line hashes chooses the ends of chunks, so a passage keeps its chunks wherever it stands. Chunks of two
lines and more that occur at an earlier place, byte for byte, go whole. The chunks at both ends of a shared passage also hold
foreign lines, and a short passage may hold no whole chunk; so what is left is looked up by every two adjacent lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphsphere.llm.common import broadcast_checked, materialize, text_slices

#: A chunk ends after a line where the rolling hash over this many line hashes is 0 modulo the divisor. Lines of a chunk, at
#: least (but for a text's last) and at most: equal lines without end give chunks of the largest size.
WINDOW, DIVISOR, LEAST, MOST = 2, 3, 2, 64
_PRIME, _MASK = 0x9E3779B1, (1 << 32) - 1


def chunks(text: str, window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST, most: int = MOST) -> list[list[str]]:
    """The text's lines in content-defined chunks. The hash rolls over the last ``window`` lines, so a boundary depends on
    little before them, and a passage that is moved keeps its boundaries but for the first."""
    out: list[list[str]] = [[]]
    drop = pow(_PRIME, window, 1 << 32)
    hashes, rolling = [], 0
    for line in text.split("\n"):
        h = zlib.crc32(line.encode()) + 1
        hashes.append(h)
        rolling = (rolling * _PRIME + h - (hashes[-1 - window] * drop if len(hashes) > window else 0)) & _MASK
        out[-1].append(line)
        if len(out[-1]) == most or len(out[-1]) >= least and (rolling >> 13) % divisor == 0:
            out.append([])
    return out if out[-1] else out[:-1]


def _chunk_units(text: str, gone: set[int]) -> Iterator[tuple[int, str]]:
    """(first line, text) of each chunk of two lines and more."""
    at = 0
    for lines in chunks(text):
        if len(lines) > 1:
            yield at, "\n".join(lines)
        at += len(lines)


def _pair_units(text: str, gone: set[int]) -> Iterator[tuple[int, str]]:
    """(first line, text) of every two adjacent lines but those inside a chunk that begins at one of ``gone``."""
    lines = text.split("\n")
    inside: set[int] = set()
    if gone:
        at = 0
        for chunk in chunks(text):
            if at in gone:
                inside.update(range(at, at + len(chunk) - 1))
            at += len(chunk)
    for pos in range(len(lines) - 1):
        if pos not in inside:
            yield pos, lines[pos] + "\n" + lines[pos + 1]


def _units(docs: DataFrame, units: Callable[[str, set[int]], Iterable[tuple[int, str]]], texts: bool) -> DataFrame:
    """(h, doc, version, pos, unit) of all units of the texts (doc, version, gone, text); ``unit`` only if ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["h", "doc", "version", "pos", "unit"], [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        out: list[tuple] = []
        for batch in batches:
            for lo, hi in text_slices(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                for doc, version, gone, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    for pos, unit in units(text, set(gone or ())):
                        out.append((hashlib.blake2b(unit.encode(), digest_size=16).digest(), doc, version, pos, unit if texts else None))
                        if len(out) == 10_000:
                            yield packed(out)
                            out = []
        if out:
            yield packed(out)

    return docs.mapInArrow(run, "h binary, doc long, version long, pos int, unit string")


def _late(docs: DataFrame, units: Callable[[str, set[int]], Iterable[tuple[int, str]]], what: str) -> DataFrame:
    """(doc, version, pos) of the units that occur, byte for byte, at an earlier place that shares no line with them.

    Hashes (128 bits) that occur once are left out first; the texts of the others are grouped by their bytes. Only
    counts per hash and each unit's first place are shuffled, so a unit that a third of the rows hold is one row a task.
    """
    often = _units(docs, units, False).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    often = materialize(often, f"repeated-{what}")
    place = F.struct("doc", "version", "pos")
    some = materialize(_units(docs, units, True).join(broadcast_checked(often), "h").select("h", place.alias("place"), "unit"), what)
    first = some.groupBy("h", "unit").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    by_hash = first.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
    by_hash = materialize(by_hash, f"first-{what}")
    # three equal lines hold a pair twice, but the second shares a line with the first; chunks share none
    later = "place > first AND NOT (place.doc <=> first.doc AND place.version = first.version AND place.pos = first.pos + 1)"
    # one text a hash: the bytes are equal, and the hash will do for the join
    late = some.select("h", "place").join(broadcast_checked(by_hash.filter("texts = 1 AND n > 1").select("h", "first")), "h").filter(later).select("place")
    if by_hash.filter("texts > 1").limit(1).count():
        mixed = some.join(by_hash.filter("texts > 1").select("h"), "h", "left_semi")
        late = late.unionByName(mixed.join(first.select("h", "unit", "first"), ["h", "unit"]).filter(later).select("place"))
    return late.distinct().select("place.*")


def _keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())


def repeated_chunks(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, chunks): first lines of the chunks of two lines and more that occur at an earlier place, per text with any.

    Places are ordered by (doc_id, hash of the text, line), null ids first; rows equal in id and text are one place.
    """
    keyed = _keyed(docs, doc_col, text_col).select("doc", "version", F.lit(None).cast("array<int>").alias("gone"), "text")
    return _late(keyed, _chunk_units, "chunks").groupBy("doc", "version").agg(F.sort_array(F.collect_list("pos")).alias("chunks"))


def repeats(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, chunks, pairs): first lines of the chunks and of the two adjacent lines that occur earlier, per text with any.

    Whatever two adjacent lines inside a repeated chunk hold stands earlier too, so its pairs are not looked up again, and
    the first place of a pair is never inside one.
    """
    found = materialize(repeated_chunks(docs, doc_col, text_col), "repeated-chunk-places")
    gone = found.select(F.col("doc").alias("d"), F.col("version").alias("v"), F.col("chunks").alias("gone"))
    keyed = _keyed(docs, doc_col, text_col)
    left = keyed.join(broadcast_checked(gone), F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left").select("doc", "version", "gone", "text")
    pairs = _late(left, _pair_units, "pairs").select("doc", "version", F.lit(None).cast("int").alias("chunk"), F.col("pos").alias("pair"))
    both = found.select("doc", "version", F.explode("chunks").alias("chunk"), F.lit(None).cast("int").alias("pair")).unionByName(pairs)
    return both.groupBy("doc", "version").agg(F.collect_list("chunk").alias("chunks"), F.collect_list("pair").alias("pairs"))


def deduplicated(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of two lines and more cut out of the text, and ``n_lines``, ``n_removed``.

    All rows and columns stay; a text whose lines are all repeated becomes empty, a null text stays null (0 lines). An
    empty text is one empty line. The first place of each line is never cut. Repeated rows (equal id and text) are one
    place and fare alike. Empty table: no rows. Columns ``n_lines`` and ``n_removed`` of ``docs`` are replaced.
    """
    late = materialize(repeats(docs, doc_col, text_col), "line-repeats")
    late = late.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("chunks").alias("__chunks"), F.col("pairs").alias("__pairs"))
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    keyed = docs.withColumn("__key", F.col(doc_col).cast("long")).withColumn("__text_hash", F.xxhash64(text_col))
    same = F.col("__key").eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__version"))
    joined = keyed.join(broadcast_checked(late), same, "left").select(*names, "__chunks", "__pairs")
    at, many = names.index(text_col), len(names)
    fields = [StructField(text_col, StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in text_slices(whole.column(at)):
                batch = whole.slice(lo, hi - lo)
                texts, total, gone = [], [], []
                for text, starts, pairs in zip(*(batch.column(i).to_pylist() for i in (at, many, many + 1)), strict=True):
                    n = text.count("\n") + 1 if text is not None else 0
                    skip = {pos + i for pos in pairs or () for i in (0, 1)}
                    if starts:
                        begin, pos = set(starts), 0
                        for lines in chunks(text):
                            if pos in begin:
                                skip.update(range(pos, pos + len(lines)))
                            pos += len(lines)
                    if skip:
                        text = "\n".join([line for pos, line in enumerate(text.split("\n")) if pos not in skip])
                    texts.append(text)
                    total.append(n)
                    gone.append(len(skip))
                cols = [*batch.columns[:many], pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)
