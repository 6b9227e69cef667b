"""Document fingerprints: Merkle trees over word runs, paragraphs and sections.

Leaves are runs of words: a run ends after a word whose last letter or digit has a code point of 0 or 3 modulo 4, so an
edit moves no run but its own. Lines are paragraphs; a section ends after a blank line or after a paragraph whose digest starts with
a byte divisible by four. Each node is the digest of its children's; the leaves cover the text, so equal roots mean
equal texts. The fingerprint is the whole tree as text: ``root:section=paragraph+leaf+leaf...;paragraph...|section...``, the
root as 32 hexadecimal digits, sections and paragraphs as 16, leaves as 12 (of a million leaves about one in 300 million
equals another by chance).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.llm.ordering import bucket_bounds, bucket_of

_ENDS = "".join(re.escape(chr(c)) for c in range(0x180) if c % 4 in (0, 3) and chr(c).isalnum())
#: The end of a run. Its three parts share no character, so the search is linear in the text.
_END = re.compile(rf"[{_ENDS}][^\w\s]*\s+")
#: Hexadecimal digits of a leaf, and of a section or paragraph.
_LEAF, _NODE = 12, 16


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _runs(paragraph: str) -> list[str]:
    cuts = [0, *(m.end() for m in _END.finditer(paragraph))]
    if cuts[-1] < len(paragraph):
        cuts.append(len(paragraph))
    return [paragraph[i:j] for i, j in pairwise(cuts)]


def fingerprint(text: str | None) -> str:
    """The tree of a text (null: empty)."""
    text = text or ""
    sections: list[tuple[bytes, list[str]]] = []
    digests: list[bytes] = []
    parts: list[str] = []

    def close() -> None:
        node = _digest(b"".join(digests))
        sections.append((node, parts.copy()))
        digests.clear()
        parts.clear()

    for line in text.splitlines(keepends=True):
        leaves = [_digest(x.encode()) for x in _runs(line)]
        node = _digest(b"".join(leaves))
        digests.append(node)
        parts.append(node[: _NODE // 2].hex() + "+" + b"".join([x[: _LEAF // 2] for x in leaves]).hex())
        if node[0] % 4 == 0 or not line.strip():
            close()
    if digests:
        close()
    root = _digest(b"".join([d for d, _ in sections]))
    return root.hex() + ":" + "|".join([d[: _NODE // 2].hex() + "=" + ";".join(p) for d, p in sections])


def _sections(tree: str) -> list[tuple[str, list[str]]]:
    """(digest, paragraphs) of each section; a paragraph is its digest, a plus and its leaves."""
    out = []
    for section in filter(None, tree[33:].split("|")):
        head, _, rest = section.partition("=")
        out.append((head, rest.split(";")))
    return out


def _leaves(paragraph: str) -> list[str]:
    return [paragraph[i : i + _LEAF] for i in range(_NODE + 1, len(paragraph), _LEAF)]


def _unmatched(one: list[str], two: list[str]) -> tuple[list[int], Counter]:
    """Places in ``one`` that find no equal partner in ``two``, and what of ``two`` is left."""
    left = Counter(two)
    places = []
    for i, x in enumerate(one):
        if left[x]:
            left[x] -= 1
        else:
            places.append(i)
    return places, +left


def compared(a: str, b: str) -> tuple[float, list[tuple[int, int]]]:
    """Likeness of two fingerprints, and (section, paragraph) of ``a``, both from 0, that ``b`` lacks.

    From the top: equal roots end the search; equal sections are paired whole, then equal paragraphs of the sections left,
    then equal leaves of the paragraphs left. The likeness is the share of paired leaves in the larger number of leaves
    (two empty texts: 1).
    """
    if a[:32] == b[:32]:
        return 1.0, []
    one, two = _sections(a), _sections(b)
    many = [sum((len(p) - _NODE - 1) // _LEAF for _, ps in t for p in ps) for t in (one, two)]
    differing, left = _unmatched([h for h, _ in one], [h for h, _ in two])
    mine = [(i, j, p) for i in differing for j, p in enumerate(one[i][1])]
    theirs = []
    for head, ps in two:
        if left[head]:
            left[head] -= 1
            theirs += ps
    places, rest = _unmatched([p for _, _, p in mine], theirs)
    leaves = Counter(x for i in places for x in _leaves(mine[i][2]))
    partners = Counter(x for p, n in rest.items() for x in _leaves(p) * n)
    paired = many[0] - leaves.total() + (leaves & partners).total()
    return paired / max(many), [mine[i][:2] for i in places]


def likeness(a: str, b: str) -> float:
    """Share of the leaves that two fingerprints have in common. Equal roots: 1."""
    return compared(a, b)[0]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a``, both from 0, that ``b`` has not: only branches that differ are descended."""
    return compared(a, b)[1]


def fingerprinted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``."""
    return docs.withColumn("fingerprint", F.pandas_udf(lambda s: s.map(lambda t: fingerprint(t or "")), "string")(F.coalesce(F.col(text_col), F.lit(""))))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def edited_and_next(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs) of every row.

    A row's next is the following one by descending id (null ids last, equal ids by text), after the last the first. The
    rows stream through range buckets, one partition each; the first row of a bucket is also sent to the bucket
    before which it ends, so that no task needs another's state. ``edited_paragraphs``: section and paragraph numbers
    that the edited text's tree lacks, as ``section.paragraph`` joined by commas. Null text counts as empty. One row: its
    own next. Repeated rows come one after another. Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = bucket_bounds(docs, "doc_id")

    def first_bucket(keys: pa.Array):  # null ids come last, with the smallest
        return bucket_of(bounds, keys.cast(pa.int64()).fill_null(-(1 << 63)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int | None] = {}
        for batch in batches:
            for b, k in zip(first_bucket(batch.column(0)).tolist(), batch.column(0).to_pylist(), strict=True):
                if b not in best or k is not None and (best[b] is None or k > best[b]):
                    best[b] = k
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["bucket", "top"])

    top = {r[0]: r[1] for r in docs.select("doc_id").mapInArrow(tops, "bucket int, top long").groupBy("bucket").agg(F.max("top")).collect()}
    order = sorted(top)
    target = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}  # whose end the top row of b follows

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, keys = first_bucket(batch.column(0)), batch.column(0).to_pylist()
            edge = [i for i, (b, k) in enumerate(zip(buckets.tolist(), keys, strict=True)) if k == top[b]]
            names = ["bucket", "edge", "doc_id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([False] * len(keys)), batch.column(0), batch.column(1)], names)
            if edge:
                extra = batch.take(pa.array(edge))
                yield pa.RecordBatch.from_arrays([pa.array([target[int(buckets[i])] for i in edge], pa.int32()), pa.array([True] * len(edge)), extra.column(0), extra.column(1)], names)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_paragraphs"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        last, done, bucket = None, False, None
        for batch in batches:
            out = []
            for b, edge, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    last, done, bucket = None, False, b
                if done:
                    continue
                tree = fingerprint(text)
                if last:
                    changed = _edited(last[1], text)
                    other = fingerprint(changed) if changed != last[1] else last[2]
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    near, places = compared(last[2], other)
                    out.append((last[0], len(last[1]), sha, last[2], other, near, likeness(last[2], tree), ",".join([f"{i}.{j}" for i, j in places])))
                last, done = (key, text, tree), edge
                if len(out) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.mapInArrow(dealt, "bucket int, edge boolean, doc_id long, text string").repartitionById(len(bounds) + 1, F.col("bucket"))
    rows = rows.sortWithinPartitions("bucket", "edge", F.col("doc_id").desc_nulls_last(), "text")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs string"
    return rows.mapInArrow(chained, kind)
