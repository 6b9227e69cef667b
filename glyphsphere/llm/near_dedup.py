"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, exact verification, components.

Links join texts whose exact probability Jaccard over their 5-word shingles, weighted by count, is at least 0.8:
``sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)``; with all counts 1 it is the plain Jaccard.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.llm.common import broadcast_checked, code_points, fold_table, materialize, text_slices
from glyphsphere.llm.components import components

#: Words of a shingle, similarity of a link; bands and rows: at 0.8 a link is missed with probability 3e-6.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def _tables(cache: dict = {}) -> np.ndarray:  # noqa: B006
    """Of every code point: its lower case if it is a letter or digit (and one code point there), else 0."""
    if not cache:
        cache["fold"] = fold_table(lambda c: 0 if unicodedata.category(c)[0] not in "LN" else ord(low) if len(low := c.lower()) == 1 else ord(c))
    return cache["fold"]


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("p", ())) <= n:
        n = max(n + 1, 1 << 18)
        inverse = np.uint64(pow(int(_A), -1, 1 << 64))
        cache["p"], cache["i"] = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_A, inverse))
    return cache["p"], cache["i"]


def shingles(column: pa.Array, n: int = WORDS) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, per row: sorted distinct shingle hashes and their counts) for slices of a text column. Fewer than ``n``
    words: one shingle of all of them; none: no shingle."""
    fold = _tables()
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for lo, hi in text_slices(column):
        cps, starts = code_points(column.slice(lo, hi - lo))
        if not len(cps):
            yield lo, [none] * (hi - lo)
            continue
        x = fold[cps].astype(np.uint64)
        inside = x != 0
        begin, end = inside.copy(), inside.copy()
        inner = starts[(starts > 0) & (starts < len(cps))]
        begin[1:] &= ~inside[:-1]
        begin[inner] = inside[inner]
        end[:-1] &= ~inside[1:]
        end[inner - 1] = inside[inner - 1]
        at, to = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, inverse = _powers(len(cps))
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(x * power[: len(cps)], out=sums[1:])
        word = _mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64))
        bound = np.searchsorted(at, starts)
        wide = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            wide = wide * _A + word[k : k + len(wide)]
        wide = _mix(wide)
        out = []
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if b - a >= n:
                h = np.sort(wide[a : b - n + 1])
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                out.append((h[first], np.diff(np.r_[first, len(h)])))
            elif b > a:
                h = np.zeros(1, np.uint64)
                for w in word[a:b]:
                    h = h * _A + w
                out.append((_mix(h + np.uint64(b - a)), np.ones(1, np.int64)))
            else:
                out.append(none)
        yield lo, out


def signatures(rows: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """ProbMinHash: one row of ``m`` registers per text; 0 where the text has no shingle.

    Each shingle sends arrivals of a Poisson process whose rate is its weight, each to one register drawn at random; a
    register keeps the shingle of its first arrival. Times and registers come from the shingle's hash alone. A shingle
    is done once its time exceeds the last of the text's registers' times (early termination); later arrivals are
    drawn several at once, which changes nothing.
    """
    size = np.array([len(h) for h, _ in rows])
    out, first = np.zeros(len(rows) * m, np.uint64), np.full(len(rows) * m, np.inf)
    if not size.sum():
        return out.reshape(-1, m)
    h, w = np.concatenate([x for x, _ in rows]), np.concatenate([c for _, c in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), size)
    time, step, many = np.zeros(len(h)), 0, 1
    while len(h):
        rolls = _mix(h[:, None] + (np.arange(step, step + many, dtype=np.uint64) + np.uint64(1)) * _C)
        wait = -np.log1p(-(rolls >> np.uint64(11)).astype(float) * 2.0**-53) / w[:, None]
        when = time[:, None] + np.cumsum(wait, 1)
        cell = row[:, None] * m + (_mix(rolls + _A) % np.uint64(m)).astype(np.int64)
        flat, at = when.ravel(), cell.ravel()
        sooner = np.flatnonzero(flat < first[at])
        flat, at = flat[sooner], at[sooner]
        np.minimum.at(first, at, flat)
        won = flat == first[at]
        out[at[won]] = h[sooner[won] // many]
        time, step = when[:, -1], step + many
        met = np.flatnonzero(np.bincount(row, minlength=len(rows)))
        last = np.full(len(rows), -1.0)
        last[met] = first.reshape(-1, m)[met].max(1)
        keep = time < last[row]
        h, w, row, time = h[keep], w[keep], row[keep], time[keep]
        many = 1 if step < 2 else min(64, max(1, (1 << 19) // max(1, len(h))))
    return out.reshape(-1, m)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact, of sorted distinct hashes ``a``, ``b`` with weights ``x``, ``y``. Two empty sets: 0."""
    if not len(a) or not len(b):
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    x, y = x.astype(float), y.astype(float)
    p, q = x[i], y[j]
    ratio = p / q
    order = np.argsort(ratio)
    p, q, ratio = p[order], q[order], ratio[order]
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    above = p[::-1].cumsum()[::-1] + only_x  # x_j over all j of at least this ratio
    below = np.r_[0.0, q.cumsum()[:-1]] + only_y
    return float((1 / (above / p + below / q)).sum())


def _keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc, digest, text): 128 bits of the text's SHA-256 (null for a null text)."""
    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.substring(F.unhex(F.sha2(text_col, 256)), 1, 16).alias("digest"), F.col(text_col).alias("text"))


def signed(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, digest, bands): a key per band; none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, own in shingles(batch.column(2)):
                part = batch.slice(lo, len(own))
                keys = signatures(own, bands * rows).reshape(len(own), bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64) * _C
                key = np.broadcast_to(key, keys.shape[:2])
                for k in range(rows):
                    key = _mix(key * _A + keys[:, :, k])
                key = key.view(np.int64)
                some = [len(h) > 0 for h, _ in own]
                cols = [part.column(0), part.column(1), pa.array([k if s else k[:0] for k, s in zip(key, some, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "digest", "bands"])

    return _keyed(docs, doc_col, text_col).mapInArrow(run, "doc long, digest binary, bands array<long>")


def _features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, hashes, counts) of the wanted (doc, digest); counts are null where all are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, own in shingles(batch.column(1)):
                cols = [batch.column(0).slice(lo, len(own)), pa.array([h.view(np.int64) for h, _ in own], pa.list_(pa.int64())), pa.array([c.astype(np.int32) if c.max(initial=1) > 1 else None for _, c in own], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["digest", "hashes", "counts"])

    wanted = broadcast_checked(wanted.select(F.col("doc").alias("d"), "digest"))
    texts = docs.join(wanted, (docs["digest"] == wanted["digest"]) & F.col("doc").eqNullSafe(F.col("d")), "left_semi").select("digest", "text")
    return texts.mapInArrow(run, "digest binary, hashes array<long>, counts array<int>")


def _own_share(features: DataFrame) -> DataFrame:
    """(digest, own): share of a text's weight in shingles that no other row has."""
    ones = F.transform("hashes", lambda h: F.lit(1))
    rows = features.select("digest", F.explode_outer(F.arrays_zip("hashes", F.coalesce("counts", ones).alias("counts"))).alias("s")).select("digest", "s.hashes", "s.counts")
    single = rows.groupBy("hashes").agg(F.count("*").alias("n"), F.first("digest").alias("digest"), F.first("counts").alias("w")).filter("n = 1")
    own = single.groupBy("digest").agg(F.sum("w").alias("w"))
    total = features.select("digest", F.aggregate(F.coalesce("counts", ones), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    return total.join(own, "digest", "left").select("digest", (F.coalesce("w", F.lit(0)) / F.col("total")).alias("own"))


#: Texts of a bucket's rest in a slot, about; members of a task, about.
SLOT, SHARE = 512, 1024


def _streamed_links(index: DataFrame, members: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join all of ``members`` (key, root, digest) with ``index`` (key, slot, root, digest), bucket by bucket.

    The index of a slot goes to each share of its bucket; there it forms an inverted index, and the share's members stream
    past it and are compared exactly. Only links that join two components of the share go on: at most as many rows as
    it has texts, not one per pair, and nothing that joins components is lost.
    """
    share = members.groupBy("key").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    index = index.join(share, "key").select("key", "slot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), "root", "digest")
    slots = index.select("key", "slot").distinct()
    passing = members.join(share, "key").withColumn("share", F.pmod(F.xxhash64("digest"), F.col("shares")).cast("int"))
    passing = passing.join(slots, "key").select("key", "slot", "share", F.lit(1).alias("role"), "root", "digest")
    both = index.unionByName(passing).join(features, "digest").repartition("key", "slot", "share").sortWithinPartitions("key", "slot", "share", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index = None, None
        names = ["key", "slot", "share", "role", "root", "digest", "hashes", "counts"]
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for row in zip(*(batch.column(batch.schema.get_field_index(n)) for n in names), strict=True):
                at = (row[0].as_py(), row[1].as_py(), row[2].as_py())
                if at != group:
                    group, index = at, _Index(similarity)
                h = row[6].values.to_numpy().view(np.uint64)
                w = row[7].values.to_numpy().astype(float) if row[7].is_valid else np.ones(len(h))
                (index.add if row[3].as_py() == 0 else index.passed)(row[4].as_py(), row[5].as_py(), h, w)
                if index.links:
                    out += index.links
                    index.links = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary").distinct()


class _Index:
    """Texts by their shingles, and the components that the links found so far make of the roots met."""

    def __init__(self, similarity: float):
        self.similarity, self.texts, self.table, self.links = similarity, [], None, []
        self.label: dict[bytes, int] = {}

    def add(self, root: bytes, digest: bytes, h: np.ndarray, w: np.ndarray) -> None:
        self.texts.append((self.label.setdefault(root, len(self.label)), digest, h, w))

    def passed(self, root: bytes, digest: bytes, h: np.ndarray, w: np.ndarray) -> None:
        """Links a text to every other component that has a text as similar as asked, likeliest first."""
        if self.table is None:
            flat = np.concatenate([x[2] for x in self.texts])
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(self.texts)), [len(x[2]) for x in self.texts])[order]
            weight = np.concatenate([x[3] for x in self.texts])[order]
            self.table = flat[order], owner, weight, np.array([x[3].sum() for x in self.texts]), np.array([x[0] for x in self.texts])
        flat, owner, weight, totals, label = self.table
        own = self.label.setdefault(root, len(self.label))
        if (label == own).all():
            return
        first, last = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        many = last - first
        place = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        mine = np.bincount(owner[place], np.repeat(w, many), len(self.texts))
        theirs = np.bincount(owner[place], weight[place], len(self.texts))
        # with common shares p and q of the two weights, it is at most 1 / (1 / p + 1 / q - 1); with unit weights just that
        with np.errstate(divide="ignore"):
            bound = np.where((mine > 0) & (label != own), 1 / (w.sum() / mine + totals / theirs - 1), 0)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < self.similarity - 1e-12:
                break
            _, name, g, v = self.texts[k]
            was = label[k]
            if was != own and (w.max() == v.max() == 1 or probability_jaccard(h, w, g, v) >= self.similarity - 1e-12):
                label[label == was] = own
                self.label |= {r: own for r, x in self.label.items() if x == was}
                self.links.append((digest, name))


def _verified(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are as similar as asked."""
    one = features.select(F.col("digest").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    two = features.select(F.col("digest").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weights(value, n: int) -> np.ndarray:
            return np.ones(n, np.int64) if not value.is_valid else value.values.to_numpy()

        for batch in batches:
            good = []
            for ha, ca, hb, cb in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                a, b = ha.values.to_numpy().view(np.uint64), hb.values.to_numpy().view(np.uint64)
                good.append(probability_jaccard(a, weights(ca, len(a)), b, weights(cb, len(b))) >= similarity - 1e-12)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "ha", "ca", "hb", "cb")
    return joined.mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``; class_id is the smallest doc_id of the connected component.

    Equal texts share a class, and so do the ends of a link. Null texts and texts without words have no links; null texts
    are each a class of their own, class_id being their doc_id. Rows with a null id take part; a class of such rows
    alone has a null class_id. Other columns are ignored.

    Copies are one node from the start. A text more than 0.2 of whose shingles' weight no other candidate holds can have
    no link, as the probability Jaccard is at most the common share of either side; such texts leave the buckets. Within
    a band's bucket not all pairs are compared: first every node with one hub (the text with the least weight of its
    own), then, until nothing is left, those that aren't in the hub's component with all nodes of other components, in
    slots. A pair in one component already needs no comparison, so no link that would join two components is lost. Empty
    table: no rows.
    """
    out = _classed(docs, similarity, doc_col, text_col)
    return out.select(F.col("doc").alias(doc_col), F.when(F.col("digest").isNull(), F.col("doc")).otherwise(F.col("class")).alias("class_id"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all columns: the row with the smallest doc_id (of several texts under it, the one with the
    smallest digest; of equal ones, any). Null texts all stay."""
    classed = _classed(docs, similarity, doc_col, text_col)
    stay = classed.filter("digest IS NOT NULL").groupBy("class", "root").agg(F.min(F.struct("doc", "digest")).alias("s"))
    stay = materialize(stay.select(F.col("s.doc").alias("__stay_doc"), F.col("s.digest").alias("__stay_digest")), "kept")
    names = docs.columns
    row = docs.withColumn("__doc", F.col(doc_col).cast("long")).withColumn("__digest", F.substring(F.unhex(F.sha2(text_col, 256)), 1, 16))
    kept = row.join(broadcast_checked(stay), (F.col("__digest") == F.col("__stay_digest")) & F.col("__doc").eqNullSafe(F.col("__stay_doc")), "left_semi")
    if kept.select("__digest").count() > stay.count():  # rows that are repeated
        kept = kept.groupBy("__doc", "__digest").agg(F.any_value(F.struct(*names)).alias("r")).select("r.*")
    return kept.select(names).unionByName(docs.filter(F.col(text_col).isNull()))


def _rest_linked(members: DataFrame, features: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The components ``found`` after the members of each bucket that its hub's component lacks have met all other members.

    That rest is dealt into slots by a hash. A round takes twice as many slots as the one before, so the rounds are about
    logarithmic in the largest bucket; whoever is in the hub's component by then needs no turn, since of two texts in
    different components one is outside the hub's.
    """

    def rooted() -> DataFrame:
        root = broadcast_checked(found.withColumnRenamed("node", "digest"))
        now = members.join(root, "digest", "left").select("key", "hub", "digest", F.coalesce("root", "digest").alias("root"))
        return now.join(broadcast_checked(hubs.join(root.select(F.col("digest").alias("hub"), F.col("root").alias("r")), "hub", "left").select("key", F.coalesce("r", "hub").alias("hub_root"))), "key")

    hubs = materialize(members.select("key", "hub").distinct(), "bucket-hubs")
    slots = materialize(rooted().filter("root <> hub_root").groupBy("key").agg(F.ceil(F.count("*") / SLOT).alias("slots")), "slots")
    lo, many = 0, 1
    while True:
        now = rooted().join(broadcast_checked(slots), "key").withColumn("slot", F.pmod(F.xxhash64("digest", "key"), F.col("slots")))
        now = materialize(now.select("key", "hub", "digest", "root", "slot", (F.col("root") != F.col("hub_root")).alias("rest")), "open")
        least = now.filter(F.col("rest") & (F.col("slot") >= lo)).agg(F.min("slot")).first()[0]
        if least is None:
            return found
        index = now.filter(F.col("rest") & (F.col("slot") >= least) & (F.col("slot") < least + many))
        others = now.filter("digest <> hub").join(index.select("key").distinct(), "key", "left_semi")
        links = materialize(_streamed_links(index.select("key", "slot", "root", "digest"), others.select("key", "root", "digest"), features, similarity), "links")
        if links.limit(1).count():
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        lo, many = least + many, 2 * many


def _classed(docs: DataFrame, similarity: float, doc_col: str, text_col: str) -> DataFrame:
    """(doc, digest, root, class) of each row; root is the component's name, null for a null text."""
    signs = materialize(signed(docs, doc_col, text_col), "signatures")
    nodes = signs.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), F.any_value("bands").alias("bands"))
    nodes = materialize(nodes, "texts")
    placed = nodes.select("digest", F.explode("bands").alias("key"))
    shared = materialize(placed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"), "buckets")
    met = materialize(placed.join(broadcast_checked(shared), "key"), "met")
    wanted = materialize(met.select("digest").distinct().join(nodes.select("digest", "doc"), "digest"), "wanted")
    features = materialize(_features(_keyed(docs, doc_col, text_col), wanted), "shingles")
    if features.count() > wanted.count():  # rows that are repeated
        features = materialize(features.dropDuplicates(["digest"]), "shingles")
    own = materialize(_own_share(features).filter(F.col("own") <= 1 - similarity + 1e-9), "own-shares")
    alive = met.join(broadcast_checked(own), "digest")
    hub = alive.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("own", "digest")).alias("hub")).filter("size > 1")
    hub = materialize(hub.select("key", F.col("hub.digest").alias("hub")), "hubs")
    members = materialize(alive.join(broadcast_checked(hub), "key").select("key", "hub", "digest"), "members")
    pairs = members.filter("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
    links = materialize(_verified(pairs, features, similarity), "links")
    found = _rest_linked(members, features, components(links), similarity)
    least = nodes.join(broadcast_checked(found.withColumnRenamed("node", "digest")), "digest", "left").select("digest", "doc", F.coalesce("root", "digest").alias("root"))
    least = materialize(least, "roots")
    smallest = least.groupBy("root").agg(F.min("doc").alias("class"))
    named = materialize(least.join(smallest, "root").select("digest", "root", "class"), "classes")
    return signs.select("doc", "digest").join(broadcast_checked(named), "digest", "left").select("doc", "digest", "root", "class")
