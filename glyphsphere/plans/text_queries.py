"""Text, tokens, compositions, search, prompts and configuration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.functions import text as T
from glyphsphere.operators import graph, learners, topk
from glyphsphere.plans.registry import Tables, query
from glyphsphere.sources.storage import cut

SEP = r"[\s,.!?;:''\"()\[\]{}]+"
TOK = f"list_filter(regexp_split_to_array(lower(text), '{SEP}'), lambda w: w <> '')"
TOKS = f"toks AS (SELECT doc_id, unnest({TOK}) AS word, unnest(range(0, len({TOK}))) AS pos FROM documents)"


def words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))


@query(f"WITH {TOKS}, v AS (SELECT word, count(*) AS n FROM toks GROUP BY word) SELECT doc_id, CAST(pos AS BIGINT) AS pos, word, n >= 100 AS has_centroid FROM toks JOIN v USING (word)")
def t3_prompt_tokens(t: Tables) -> DataFrame:
    v = words(t).groupBy("word").agg(F.count("*").alias("n"))
    return words(t).join(v, "word").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word", (F.col("n") >= 100).alias("has_centroid"))


@query(f"SELECT doc_id, CAST(len(list_distinct(l)) AS BIGINT) AS total, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 4 / 3) AS BIGINT) AS estimate FROM (SELECT doc_id, text, {TOK} AS l FROM documents)")
def t4_t5_token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.distinct_tokens(F.col("text"), 1 << 30)).cast("bigint").alias("total"), T.estimated_tokens(F.col("text")).alias("estimate"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS ends, CAST(len(regexp_extract_all(text, '[ \\n\\t]')) AS BIGINT) AS blanks FROM documents")
def t6_character_classes(t: Tables) -> DataFrame:
    cls = lambda m: F.size(F.filter(F.split("text", ""), lambda c: T.in_class(c, m))).cast("bigint")
    return t.documents.select("doc_id", cls(T.SENTENCE_END).alias("ends"), cls(T.WHITE_SPACE).alias("blanks"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) AS BIGINT) AS unicode, CAST(len(regexp_extract_all(text, '\\S')) AS BIGINT) AS per_character,
CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS whitespace FROM documents""")
def t7_presets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(F.size(T.preset_tokens(F.col("text"), p)).cast("bigint").alias(p) for p in T.PRESETS))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 462)) AS s FROM documents) SELECT doc_id, CAST(s // 462 AS BIGINT) AS chunk, substr(text, s + 1, 512) AS body FROM c""")
def t15_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(T.char_chunks(F.col("text"))).alias("chunk", "body")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query()
def t14_paragraph_chunks(t: Tables) -> DataFrame:
    return learners.paragraph_chunks(t.documents.select("doc_id", "text"), 500, 2000)


@query("""SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS atom_count, 3 AS depth, round(1.5 + length(text) * 0.1, 6) AS score FROM documents WHERE regexp_matches(text, '(?i)tion|license') AND length(text) > 3 ORDER BY length(text) DESC, doc_id LIMIT 50""")
def t16_keyword_search(t: Tables) -> DataFrame:
    found = learners.keyword_search(t.documents.select(F.col("doc_id").alias("id"), "text", F.lit(3).alias("depth")), "of tion license", 50)
    return found.select("id", "atom_count", "depth", F.round("score", 6).alias("score"))


@query("""WITH hits AS (SELECT doc_id, text, 1.5 + length(text) * 0.1 AS score FROM documents WHERE regexp_matches(text, '(?i)license') AND length(text) > 3 ORDER BY length(text) DESC, doc_id LIMIT 100),
u AS (SELECT text, max(score) AS score FROM hits WHERE length(text) > 5 GROUP BY text ORDER BY text LIMIT 20), r AS (SELECT trim(text) AS b, row_number() OVER (ORDER BY score DESC, text) AS k FROM u)
SELECT 'Based on the text, I found:' || chr(10) || chr(10) || string_agg('  - ' || b || chr(10), '' ORDER BY k) AS answer FROM r WHERE k <= 10""")
def t17_answer(t: Tables) -> DataFrame:
    return learners.answer(t.documents.select(F.col("doc_id").alias("id"), "text", F.lit(3).alias("depth")), "what is the license")


@query("SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%under the%' ORDER BY n_chars DESC, doc_id LIMIT 20")
def t18_l11_phrase_search(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("text").ilike("%under the%")).orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars")


@query("SELECT doc_id, " + ", ".join("(" + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + f") AS {k}" for k, ws in T.MODERATION.items()) + ", (" + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for ws in T.MODERATION.values() for w in ws) + ") AS flagged FROM documents")
def t19_moderation(t: Tables) -> DataFrame:
    return T.moderated(t.documents.select("doc_id", "text"))


@query("SELECT tok, replace(replace(tok, 'Ġ', ' '), 'Ċ', chr(10)) AS decoded, CASE WHEN tok IN ('<s>', '[CLS]', '<bos>') THEN 'bos' WHEN tok IN ('</s>', '[SEP]', '<eos>') THEN 'eos' WHEN tok IN ('<pad>', '[PAD]') THEN 'pad' WHEN tok IN ('<unk>', '[UNK]') THEN 'unk' WHEN tok IN ('<mask>', '[MASK]') THEN 'mask' ELSE 'special' END AS role FROM (VALUES ('Ġthe'), ('[CLS]'), ('</s>'), ('Ċ'), ('<mask>'), ('[PAD]'), ('<unk>')) v(tok)")
def t20_t21_special_tokens(t: Tables) -> DataFrame:
    toks = t.spark.createDataFrame([(x,) for x in ("Ġthe", "[CLS]", "</s>", "Ċ", "<mask>", "[PAD]", "<unk>")], "tok string")
    return toks.select("tok", T.bpe_decoded(F.col("tok")).alias("decoded"), T.special_role(F.col("tok")).alias("role"))


@query("""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages), h AS (SELECT s, unnest(range(1, len(s))) AS n FROM p)
SELECT DISTINCT array_to_string(s[1:n], '/') AS parent, array_to_string(s[1:n+1], '/') AS child FROM h""")
def t22_path_hierarchy(t: Tables) -> DataFrame:
    paths = t.pages.select(T.path_prefixes(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("p"))
    return paths.select(F.explode(F.arrays_zip(F.expr("slice(p, 1, size(p) - 1)").alias("parent"), F.expr("slice(p, 2, size(p) - 1)").alias("child"))).alias("e")).select("e.*").distinct()


@query("""SELECT event_id, k AS key, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def src12_t24_flattened_json(t: Tables) -> DataFrame:
    """One row per top-level key of a JSON text."""
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


TENSORS = [("layers.0.attention.q_proj", [768, 768]), ("layers.0.attn.k_proj", [768, 768]), ("layers.1.attention.value", [768, 768]), ("layers.1.attention.output", [768, 768]),
           ("layers.2.mlp.up", [768, 3072]), ("layers.2.mlp.down", [3072, 768]), ("router", [8, 768]), ("positions", [1024, 768]), ("norm", [768]), ("tokens", [30000, 512]), ("odd", [3, 4, 5])]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for (n, _), c in zip(TENSORS, ["attention_query", "attention_key", "attention_value", "attention_output", "mlp_up", "mlp_down", "router_weights", "position_embeddings", "layer_norm", "token_embeddings", "unknown"], strict=True)) + ") v(name, category)")
def t25_tensor_categories(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(TENSORS, "name string, shape array<bigint>").select("name", T.tensor_category(F.col("name"), F.col("shape")).alias("category"))


@query("""SELECT source, CASE WHEN count(*) > 0 THEN 'You are a helpful assistant. Use the following context to answer the user''s question accurately.' || chr(10) || chr(10) || string_agg('Context ' || k || ':' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) END AS prompt
FROM (SELECT source, text AS body, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY source""")
def t26_rag_prompts(t: Tables) -> DataFrame:
    top = topk.first_per_group(t.documents.select("source", "doc_id", F.col("text").alias("body")), ["source"], [F.col("doc_id")], 3)
    docs = top.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]).alias("d"))
    return docs.select("source", T.rag_prompt(F.col("d")).alias("prompt"))


@query("""SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn, text) || chr(10) || 'Assistant:' AS prompt FROM conversations GROUP BY conv_id""")
def t27_conversation_prompts(t: Tables) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("turn", "text", T.message_line(F.col("role"), F.col("text")).alias("line"))))
    return t.conversations.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\nAssistant:")).alias("prompt"))


PAIRS = f"WITH {TOKS}, pr AS (SELECT word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM toks), bi AS (SELECT a, b, count(*) AS n FROM pr WHERE b IS NOT NULL GROUP BY ALL), uni AS (SELECT word, count(*) AS n FROM toks GROUP BY word)"


def pair_counts(t: Tables) -> DataFrame:
    """(a, b, n): each word before each following one, null at the end of a text: the counts of words and of pairs are sums of it."""
    return cut(word_pairs(t).groupBy("a", "b").agg(F.count("*").alias("n")))


def word_pairs(t: Tables) -> DataFrame:
    """(a, b) of each word and the following one, null at the end of a text. The pairs are made inside the row, so no text is shuffled."""
    w = t.documents.select(T.tokens(F.col("text")).alias("w"))
    both = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return w.select(F.explode(both).alias("p")).select("p.a", "p.b")


def unigrams(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))


def bigrams(pairs: DataFrame) -> DataFrame:
    return pairs.filter("b IS NOT NULL")


@query(f"{PAIRS} SELECT a, b, n FROM bi")
def a24_j9_bigrams(t: Tables) -> DataFrame:
    return bigrams(pair_counts(t))


@query(f"{PAIRS} SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM (SELECT a AS src, b AS dst FROM bi UNION ALL SELECT b, a FROM bi)")
def d8_pair_edges(t: Tables) -> DataFrame:
    """Edges of weight 1 in both directions between words that stand side by side."""
    return graph.both_ways(bigrams(word_pairs(t)).select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumn("weight", F.lit(1.0))


def pmi(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, pmi): log2 of a pair's share over the product of its words' shares, of pairs that occur ``least`` times."""
    uni, bi = unigrams(pairs), bigrams(pairs)
    tot = pairs.agg(F.sum("n").alias("nu"), F.sum(F.when(F.col("b").isNotNull(), F.col("n"))).alias("nb"))
    j = bi.filter(F.col("n") >= least).join(uni.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(uni.select(F.col("word").alias("b"), F.col("n").alias("nbb")), "b")
    j = j.crossJoin(F.broadcast(tot))  # one row
    return j.select("a", "b", "n", F.log2((F.col("n") / F.col("nb")) / ((F.col("na") / F.col("nu")) * (F.col("nbb") / F.col("nu")))).alias("pmi"))


PMI = f"""{PAIRS}, tot AS (SELECT (SELECT sum(n) FROM uni) AS nu, (SELECT sum(n) FROM bi) AS nb), pm AS (SELECT bi.a, bi.b, bi.n, log2((bi.n / nb) / ((x.n / nu) * (y.n / nu))) AS pmi FROM bi JOIN uni x ON bi.a = x.word JOIN uni y ON bi.b = y.word, tot WHERE bi.n >= 2)"""


@query(f"{PMI} SELECT a, b, n, round(pmi, 6) AS pmi FROM pm")
def a25_pmi(t: Tables) -> DataFrame:
    """At least two occurrences, as the operator asks for."""
    return pmi(pair_counts(t)).withColumn("pmi", F.round("pmi", 6))


@query(f"{PAIRS} SELECT a, b, n FROM bi ORDER BY n DESC, a, b LIMIT 1")
def a26_best_pair(t: Tables) -> DataFrame:
    return bigrams(pair_counts(t)).orderBy(F.desc("n"), "a", "b").limit(1)


@query()
def t10_merges(t: Tables) -> DataFrame:
    """Pair merges learned per document; each step merges the most frequent pair, ties by the pair."""
    return learners.pair_merges(t.documents.select("doc_id", "text"))


@query()
def t10_pair_trees(t: Tables) -> DataFrame:
    """The merges of each document followed by the closing pairs of what they leave, up to one root."""
    return learners.pair_trees(t.documents.select("doc_id", "text"))


@query()
def t12_grammar(t: Tables) -> DataFrame:
    """Digram-unique grammars per document (rules used twice or more)."""
    return learners.grammars(t.documents.select("doc_id", "text"))


@query()
def t13_longest_matches(t: Tables) -> DataFrame:
    """Greedy longest matches in every text of the words that occur fifty times (a parameter: the vocabulary is broadcast)."""
    vocab = words(t).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 50").select("word")
    return learners.longest_matches(t.documents.select("doc_id", "text"), vocab)


@query()
def t9_token_compositions(t: Tables) -> DataFrame:
    """Words as compositions of atoms: content hash, length, depth."""
    from glyphsphere.functions.hashing import text_hash_hex

    v = words(t).groupBy("word").agg(F.count("*").alias("n"))
    return v.select("word", text_hash_hex("word").alias("id"), F.length("word").cast("bigint").alias("atom_count"), F.lit(1).alias("depth"), "n")
