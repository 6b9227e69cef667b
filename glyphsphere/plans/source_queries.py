"""File sources and sinks: each query writes tables as files of a format into the shared folder and reads them back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.functions import text as T
from glyphsphere.operators import relations
from glyphsphere.plans.registry import Tables, query
from glyphsphere.plans.vector_queries import points, r6
from glyphsphere.sources import files, sinks
from glyphsphere.sources.storage import new_path


@query("SELECT n_name AS name, n_name || ' in ' || n_regionkey || chr(10) AS text FROM nation")
def src7_text_files(t: Tables) -> DataFrame:
    """A text file a nation, in a folder of its own, found again by walking the folders."""
    root = new_path(t.spark, "texts")
    t.nation.select("n_name", F.concat("n_name", F.lit(" in "), "n_regionkey").alias("value")).repartition("n_name").write.partitionBy("n_name").text(root)
    found = files.texts(t.spark, root, "*.txt")
    return found.select(F.url_decode(F.regexp_extract("path", "/n_name=([^/]*)/", 1)).alias("name"), "text")


def _model(t: Tables) -> str:
    """A model of one tensor file a region: its nations' keys as a matrix, and one bias; the table has 25 rows at every scale."""
    root = new_path(t.spark, "model")
    rows = t.nation.select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()
    for region in {r[0] for r in rows}:
        keys = np.array([[r[1], r[1] * 0.5, region] for r in rows if r[0] == region], "f4")
        sinks.write_bytes(t.spark, f"{root}/part{region}/model.safetensors", sinks.tensor_file({"keys": keys, "bias": np.array([region], "f4")}))
    return root


def _part():
    return F.regexp_extract("path", "part(\\d+)/", 1).cast("bigint").alias("part")


@query("""WITH c AS (SELECT n_regionkey AS part, count(*) AS n FROM nation GROUP BY ALL) SELECT CAST(part AS BIGINT) AS part, 'keys' AS name, 'F32' AS dtype, n || 'x3' AS shape, CAST(n * 12 AS BIGINT) AS bytes FROM c
UNION ALL SELECT part, 'bias', 'F32', '1', 4 FROM c""")
def src8_tensor_headers(t: Tables) -> DataFrame:
    h = files.tensor_headers(t.spark, _model(t))
    return h.select(_part(), "name", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), (F.col("last") - F.col("first")).alias("bytes"))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS part, 'keys' AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS row, n_nationkey * 1.5 + n_regionkey AS total FROM nation
UNION ALL SELECT DISTINCT n_regionkey, 'bias', 0, n_regionkey FROM nation""")
def src10_tensor_rows(t: Tables) -> DataFrame:
    rows = files.tensor_rows(t.spark, _model(t))
    return rows.select(_part(), "name", "row", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS part, CAST(1 AS BIGINT) AS files FROM nation GROUP BY n_regionkey")
def src13_models(t: Tables) -> DataFrame:
    """Folders that hold tensor files."""
    return files.models(t.spark, _model(t)).select(F.regexp_extract("folder", "part(\\d+)$", 1).cast("bigint").alias("part"), "files")


def _document(t: Tables, rows: DataFrame, json) -> str:
    """Path of one JSON document aggregated from ``rows``, which a vocabulary bounds."""
    path = new_path(t.spark, "document")
    rows.agg(F.to_json(json).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT DISTINCT p_brand AS tensor, 'model-' || right(p_brand, 1) || '.safetensors' AS file FROM part")
def src9_model_index(t: Tables) -> DataFrame:
    kinds = t.part.select("p_brand", F.concat(F.lit("model-"), F.right("p_brand", F.lit(1)), F.lit(".safetensors")).alias("file")).distinct()
    return files.model_index(t.spark, _document(t, kinds, F.struct(F.map_from_entries(F.collect_list(F.struct("p_brand", "file"))).alias("weight_map"))))


def _tokenizer(t: Tables) -> str:
    """A tokenizer file: the types of parts as tokens, by number, and their pairs with brands as merges."""
    types = t.part.select("p_type", "p_brand").distinct()
    vocab = F.array_sort(F.collect_set("p_type"))
    merges = F.array_sort(F.collect_set(F.concat_ws(" ", "p_type", "p_brand")))
    ids = F.map_from_arrays(vocab, F.sequence(F.lit(0), F.size(vocab) - 1))
    return _document(t, types, F.struct(F.struct(ids.alias("vocab"), merges.alias("merges")).alias("model")))


@query("SELECT p_type AS token, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_type FROM part)")
def src11_tokenizer_vocabulary(t: Tables) -> DataFrame:
    return files.tokenizer_vocab(t.spark, _tokenizer(t))


MERGES = "m AS (SELECT l, r, row_number() OVER (ORDER BY l || ' ' || r) - 1 AS rank FROM (SELECT DISTINCT p_type AS l, p_brand AS r FROM part))"


@query(f"WITH {MERGES} SELECT l AS source, l || r AS target, 'M' AS relation_type, CAST(rank AS BIGINT) AS rank FROM m UNION ALL SELECT r, l || r, 'M', rank FROM m")
def t23_merge_edges(t: Tables) -> DataFrame:
    """Edges from both parts of each merge of a tokenizer file to what they make."""
    return T.merge_edges(files.tokenizer_merges(t.spark, _tokenizer(t))).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT n_name AS token, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def src11_vocabulary_lines(t: Tables) -> DataFrame:
    """A vocabulary of one token a line, the line's number its id."""
    path = new_path(t.spark, "vocab")
    t.nation.repartition(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return files.vocab_lines(t.spark, path)


@query("SELECT 'names.' || r_regionkey AS key, r_name AS value FROM region UNION ALL SELECT 'sizes.regions', CAST(count(*) AS VARCHAR) FROM region")
def src12_flattened_config(t: Tables) -> DataFrame:
    """Keys of a nested configuration as dotted paths."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"])
    return files.flattened_config(t.spark, _document(t, t.region, F.struct(names.alias("names"), F.struct(F.count("*").alias("regions")).alias("sizes"))))


@query(f"""WITH {MERGES} SELECT 'vocab' AS source, p_type AS target, 'V' AS relation_type FROM (SELECT DISTINCT p_type FROM part) UNION SELECT l, l || r, 'M' FROM m UNION SELECT r, l || r, 'M' FROM m""")
def rx14_metadata_edges(t: Tables) -> DataFrame:
    """All relations of a tokenizer file: its vocabulary's and its merges'."""
    path = _tokenizer(t)
    vocab = files.tokenizer_vocab(t.spark, path).select(F.lit("vocab").alias("source"), F.col("token").alias("target"), F.lit("V").alias("relation_type"))
    return vocab.unionByName(T.merge_edges(files.tokenizer_merges(t.spark, path)).drop("rank")).distinct()


@query("SELECT CAST(doc_id AS VARCHAR) AS custom_id, md5(text) AS body_md5 FROM documents WHERE n_chars % 2 = 0")
def src14_batch_requests(t: Tables) -> DataFrame:
    """Documents as request lines; the lines of those with an odd number of characters are broken and must be left out."""
    path = new_path(t.spark, "requests")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.col("text").alias("body")))
    t.documents.select(F.when(F.col("n_chars") % 2 == 0, line).otherwise(F.left(line, F.length(line) - 1))).write.text(path)
    return files.batch_requests(t.spark, path).select("custom_id", F.md5("body").alias("body_md5"))


@query("SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def snk2_exported_chunks(t: Tables) -> DataFrame:
    """Documents through delimited files of 500 rows at most, texts with quotes and line ends among them."""
    path, rows = new_path(t.spark, "export"), t.documents.select("doc_id", "text", "lang")
    sinks.export(rows, path, 500)
    return sinks.exported(t.spark, path, rows.schema).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query()
def snk5_ewkb_points(t: Tables) -> DataFrame:
    """Every vector's point as EWKB (hex); tests hold it against the format's layout."""
    return sinks.with_ewkb(points(t)).select("vec_id", F.hex("ewkb").alias("ewkb"))


@query("""SELECT vec_id, CASE WHEN label IN (1, 2) THEN label + 100 ELSE label END AS label FROM embeddings WHERE label <> 3 UNION ALL SELECT -1, 7""")
def snk6_collection(t: Tables) -> DataFrame:
    """A collection made anew, then rows replaced and added, then the rows of one label deleted."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")
    store = sinks.Collection(t.spark, new_path(t.spark, "collection"))
    store.recreate(e)
    changed = e.filter("label IN (1, 2)").withColumn("label", F.col("label") + 100)
    store.upsert(changed.unionByName(e.filter("id = 0").withColumns({"id": F.lit(-1).cast("bigint"), "label": F.lit(7)})))
    store.delete(e.filter("label = 3").select("id"))
    return store.read().select(F.col("id").alias("vec_id"), "label")


@query("SELECT 'loaded' AS state, count(*) AS vectors, CAST(max(len(embedding)) AS INTEGER) AS dims FROM embeddings UNION ALL SELECT 'cleared', 0, NULL")
def v9_embedding_cache(t: Tables) -> DataFrame:
    """Count and dimension of a stored collection of vectors once loaded and once cleared."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    full, empty = (sinks.Collection(t.spark, new_path(t.spark, "cache")) for _ in range(2))
    full.recreate(e)
    empty.recreate(e)
    empty.delete(e.select("id"))
    sizes = [(c.read().agg(F.lit(s).alias("state"), F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))) for s, c in (("loaded", full), ("cleared", empty))]
    return sizes[0].unionByName(sizes[1])


@query("""WITH e AS (SELECT user_id AS src, event_type AS dst, max(value) AS w FROM events GROUP BY ALL), o AS (SELECT user_id AS src, event_type AS dst, avg(value) AS w, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT 'edge' AS kind, CAST(e.src AS VARCHAR) || '-' || e.dst AS name, round(coalesce((o.w * o.n + e.w) / (o.n + 1), e.w), 6) AS weight, CAST(coalesce(o.n, 0) + 1 AS BIGINT) AS source_count FROM e LEFT JOIN o USING (src, dst)
UNION ALL SELECT 'node', n, NULL, NULL FROM (SELECT CAST(src AS VARCHAR) AS n FROM e UNION SELECT dst FROM e)""")
def rx10_rx11_loaded_edges(t: Tables) -> DataFrame:
    """Edges of all events, each once, merged with those known (of one type), and the endpoints that weren't there."""
    e = t.events.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("weight"))
    old = relations.merged(e.filter("dst = 'view'"), ["src", "dst"])
    nodes = old.select(F.col("src").alias("node")).distinct()
    edges, all_nodes = relations.loaded(e, old, nodes)
    rows = edges.select(F.lit("edge").alias("kind"), F.concat_ws("-", "src", "dst").alias("name"), r6(F.col("weight"), "weight"), "source_count")
    return rows.unionByName(all_nodes.select(F.lit("node").alias("kind"), F.col("node").alias("name"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("bigint").alias("source_count")))


@query("SELECT p_type AS tensor, max(p_retailprice) AS score FROM part WHERE p_brand = 'Brand#12' AND p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size = 1) AND p_retailprice IS NOT NULL GROUP BY p_type")
def rx12_quality_lookup(t: Tables) -> DataFrame:
    """Best score of each tensor of a list, for one model."""
    scores = t.part.select(F.col("p_brand").alias("model"), F.col("p_type").alias("tensor"), F.col("p_retailprice").alias("score"))
    return relations.scores_of(scores, "Brand#12", t.part.filter("p_size = 1").select(F.col("p_type").alias("tensor")))
