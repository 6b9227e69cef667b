"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glyphsphere.llm.common import broadcast_checked, materialize, words_of

#: Words of a shingle; share of an item's distinct shingles that a document must hold.
WORDS, CONTAINMENT = 5, 0.8


def _shingled(df: DataFrame, n: Column, shingle, kind: str) -> DataFrame:
    """``df`` with its text replaced by ``s``, the distinct shingles of ``n`` words. The words are a column of their own:
    inside the lambda their expression would be evaluated again for each shingle. Explode it with ``explode_outer``: for
    ``explode`` the optimizer infers a filter on ``s`` and pushes it, with the words put back into the lambda, to the scan."""
    df = df.withColumn("w", words_of(F.col("text"))).drop("text")
    many = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: shingle(F.slice("w", i, n)))
    return df.withColumn("s", F.when((F.size("w") >= n) & (n > 0), F.array_distinct(many)).otherwise(F.array().cast(f"array<{kind}>"))).drop("w")


def _hashes(df: DataFrame, n: Column) -> DataFrame:
    return _shingled(df, n, F.xxhash64, "bigint")


def _texts(df: DataFrame, n: Column) -> DataFrame:
    return _shingled(df, n, lambda w: F.concat_ws(" ", w), "string")


def item_sketches(items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """MinHash sketch of each item: (item, words, size, size_class, sketch).

    ``words`` of a shingle are ``n``, or all words of a shorter item. The sketch is bottom-m: the m smallest shingle hashes,
    where m is one more than the shingles that an item of its size may miss. A document with the stated containment
    therefore always holds one of them (pigeonhole), so the search loses nothing. Items fall into size classes (powers of
    two), each with its own threshold: the largest hash that a sketch of the class has. Items without a word: no row.
    """
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("item IS NOT NULL")
    items = items.withColumn("words", F.least(F.size(words_of(F.col("text"))), F.lit(n)))
    hashes = _hashes(items, F.col("words")).select("item", "words", F.array_sort("s").alias("h")).filter(F.size("h") > 0)
    size = F.size("h")
    misses = size - F.ceil(size * F.lit(containment) - 1e-9).cast("int")
    return hashes.select("item", "words", size.alias("size"), F.floor(F.log2(size)).cast("int").alias("size_class"), F.slice("h", F.lit(1), misses + 1).alias("sketch"))


def contaminated(
    docs: DataFrame, items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT,
    doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found, containment) where a document holds at least ``containment`` of an item's
    distinct ``n``-word shingles (lower-cased runs of letters and digits). An item of fewer words is one shingle of all of
    them: it is found where its words stand one after another.

    Candidates: a document probes each size class with those of its shingle hashes that are at most the class's
    threshold, and whoever meets a sketch of that class is a candidate. Only candidates are verified, by exact comparison
    of shingle texts. Nulls, items without a word, documents of fewer words than the shingle: no pair. Rows without an
    id: no pair. Repeated ids: the row with the largest share counts. Empty tables: no pair. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull())
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("item").isNotNull())
    # items that share an id: each text is an item of its own until the end
    items = items.select("item", "text", F.xxhash64("text").alias("copy")).dropDuplicates(["item", "copy"]).select(F.struct("item", "copy").alias("item"), "text")
    sketches = item_sketches(items, n, containment, "item", "text")
    postings = sketches.select("words", "size_class", F.explode("sketch").alias("h"), "item")
    # one number per size class and shingle length: a few dozen at most
    limits = [tuple(r) for r in sketches.groupBy("words", "size_class").agg(F.max(F.element_at("sketch", -1))).collect()]

    def probes(words: int) -> DataFrame:
        own = sorted(((most, c) for w, c, most in limits if w == words), reverse=True)
        classes = F.slice(F.array(*(F.lit(c) for _, c in own)), 1, F.greatest(F.lit(1), sum((F.col("h") <= F.lit(most)).cast("int") for most, _ in own)))
        found = _hashes(docs, F.lit(words)).select("doc", F.explode_outer(F.filter("s", lambda h: h <= F.lit(own[0][0]))).alias("h"))
        return found.select("doc", F.lit(words).alias("words"), F.explode(classes).alias("size_class"), "h")

    lengths = sorted({w for w, _, _ in limits})
    pairs = [probes(w).join(broadcast_checked(postings), ["words", "size_class", "h"]).select("doc", "item").distinct() for w in lengths]
    spark = docs.sparkSession
    none = spark.createDataFrame([], StructType([StructField("doc", docs.schema["doc"].dataType), StructField("item", items.schema["item"].dataType)]))
    candidates = materialize(reduce(DataFrame.unionByName, pairs, none).distinct(), "candidates")

    items = items.withColumn("words", F.least(F.size(words_of(F.col("text"))), F.lit(n)))
    shingles = _texts(items, F.col("words")).select("item", "words", F.explode_outer("s").alias("shingle"))
    sizes = _texts(items, F.col("words")).select("item", F.size("s").alias("n_shingles"))
    held = docs.join(broadcast_checked(candidates.select("doc").distinct()), "doc", "left_semi").withColumn("version", F.xxhash64("text"))
    if lengths:
        held = reduce(DataFrame.unionByName, [_texts(held.withColumn("words", F.lit(w)), F.lit(w)) for w in lengths])
    else:
        held = _texts(held.withColumn("words", F.lit(n)), F.lit(n))
    held = held.select("doc", "version", "words", F.explode_outer("s").alias("shingle"))
    found = held.join(broadcast_checked(shingles), ["words", "shingle"]).groupBy("doc", "version", "item").agg(F.count_distinct("shingle").alias("n_found"))
    found = found.join(candidates, ["doc", "item"], "left_semi").join(broadcast_checked(sizes), "item")
    best = (
        found.filter(F.col("n_found") >= F.col("n_shingles") * F.lit(containment) - 1e-9)
        .groupBy("doc", F.col("item.item").alias("item"))
        .agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("best"))
    )
    return best.select(
        F.col("doc").alias(doc_col), F.col("item").alias(item_col), F.col("best.n_shingles").cast("long").alias("n_shingles"),
        F.col("best.n_found").cast("long").alias("n_found"), F.round(F.col("best.n_found") / F.col("best.n_shingles"), 6).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The documents that hold no item, with all their columns; rows without an id stay. Repeated rows go or stay together."""
    doc_col = kw.get("doc_col", "doc_id")
    hit = materialize(contaminated(docs, items, **kw).select(F.col(doc_col).alias("__hit")).distinct(), "leaks")
    return docs.join(broadcast_checked(hit), F.col(doc_col) == F.col("__hit"), "left_anti")
