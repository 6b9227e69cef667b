"""Text expressions: tokenisers, chunks, keyword flags, prompts, name rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of prompts, stop words of questions, sentence ends, white space, stop tokens.
SEPARATORS = r"[\s,.!?;:'\"()\[\]{}]+"
STOP_WORDS = ["what", "who", "where", "when", "why", "how", "the", "is", "are", "was", "were", "did", "does", "can", "could", "would", "should", "will"]
SENTENCE_END = ".!?\u3002\uff01\uff1f\uff0e\u06d4\u061f\u0964\u0965\u0589\u055c\u055e\u037e\u1362\u1367\u1368\u104a\u104b\u0f0d\u0f0e\u10fb"
WHITE_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\u2028\u2029"
STOP_TOKENS = [".", "!", "?", "[SEP]", "[EOS]"]
# Moderation keywords by category.
MODERATION = {
    "sexual": ["sex", "porn", "nude", "naked", "erotic", "sexual", "fuck", "pornography", "adult", "xxx", "nsfw", "lust", "orgasm", "penis", "vagina", "breast"],
    "hate": ["hate", "racist", "nazi", "supremacist", "bigot", "intolerant", "discrimination", "prejudice", "xenophobia", "homophobia", "antisemitism", "islamophobia"],
    "harassment": ["harass", "bully", "intimidate", "threaten", "abuse", "stalk", "cyberbully", "troll", "insult", "mock", "ridicule"],
    "self_harm": ["suicide", "kill myself", "self-harm", "cut myself", "overdose", "hang myself"],
    "sexual_minors": ["child porn", "pedophile", "underage", "minor sex", "child abuse", "loli", "shota"],
    "hate_threatening": ["kill all", "exterminate", "genocide", "ethnic cleansing", "hate crime"],
    "violence_graphic": ["murder", "rape", "torture", "blood", "gore", "mutilation", "dismember", "decapitation", "cannibalism"],
    "self_harm_intent": ["i want to die", "i'm going to kill myself", "planning suicide"],
    "self_harm_instructions": ["how to commit suicide", "suicide methods", "ways to self-harm"],
    "harassment_threatening": ["i'll kill you", "i'm coming for you", "death threat", "bomb threat"],
    "violence": ["kill", "murder", "attack", "assault", "violent", "fight", "weapon", "gun", "knife", "bomb", "explosion", "terrorism"],
}


def tokens(text: Column) -> Column:
    """Lower-cased words between separators."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def distinct_tokens(text: Column, most: int = 100) -> Column:
    """The first distinct words."""
    return F.slice(F.array_distinct(tokens(text)), 1, most)


def estimated_tokens(text: Column) -> Column:
    """Words that white space separates, times four thirds, rounded up."""
    return F.ceil(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 4 / 3).cast("bigint")


#: Tokeniser presets by name: patterns of a token.
PRESETS = {"unicode": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", "per_character": r"\S", "whitespace": r"\S+"}


def preset_tokens(text: Column, preset: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PRESETS[preset]), F.lit(0))


def in_class(char: Column, members: str) -> Column:
    return char.isin(*members)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, f"(?<=[{SENTENCE_END}])"), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n+"), lambda s: F.trim(s) != "")


def char_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Chunks of ``size`` characters, each ``overlap`` characters into the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def moderated(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the text but with one flag per category, and ``flagged``. The lower-cased text is a column of its own, and
    ``flagged`` comes from the flags, so no text is searched twice for a word of a category."""
    keep = [c for c in df.columns if c != text_col]
    low = df.select(*keep, F.lower(text_col).alias("__low"))
    flags = low.select(*keep, *(reduce(lambda a, b: a | b, [F.contains("__low", F.lit(w)) for w in words]).alias(k) for k, words in MODERATION.items()))
    return flags.withColumn("flagged", reduce(lambda a, b: a | b, [F.col(k) for k in MODERATION]))


def bpe_decoded(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "Ġ", " "), "Ċ", "\n")


def special_role(token: Column) -> Column:
    """Role of a special token by its content."""
    roles = {"bos": ["<s>", "[CLS]", "<bos>"], "eos": ["</s>", "[SEP]", "<eos>"], "pad": ["<pad>", "[PAD]"], "unk": ["<unk>", "[UNK]"], "mask": ["<mask>", "[MASK]"]}
    return reduce(lambda c, kv: c.when(token.isin(kv[1]), kv[0]), roles.items(), F.when(F.lit(False), "")).otherwise("special")


def path_prefixes(path: Column, sep: str = ".") -> Column:
    """All ancestors of a path and itself, shortest first."""
    parts = F.split(path, rf"\Q{sep}\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def merge_edges(merges: DataFrame) -> DataFrame:
    """(source, target, relation_type, rank): from both parts of each merge (rank, left, right) to what they make."""
    made = F.concat("left", "right").alias("target")
    return merges.select(F.explode(F.array("left", "right")).alias("source"), made, F.lit("M").alias("relation_type"), "rank")


def layer_of(path: Column) -> Column:
    found = F.regexp_extract(path, r"layers?\.(\d+)\.", 1)
    return F.when(found != "", found.cast("int"))


def tensor_category(name: Column, shape: Column, hidden: int = 768, vocab: int = 50000, seq: int = 2048) -> Column:
    """Role of a tensor by its shape, refined by its path."""
    d0, d1, two = F.get(shape, 0), F.get(shape, 1), F.size(shape) == 2
    attention = name.contains("attention") | name.contains("attn")
    square = (
        F.when(attention & (name.contains("query") | name.contains("q_proj")), "attention_query")
        .when(attention & (name.contains("key") | name.contains("k_proj")), "attention_key")
        .when(attention & (name.contains("value") | name.contains("v_proj")), "attention_value")
        .when(attention & (name.contains("output") | name.contains("o_proj")), "attention_output")
        .otherwise("attention_query")
    )
    embedding = ((d0 > 1000) & (d1 > 64) & (d1 < 10000)) | ((d0 < 10000) & (d1 == hidden) & (d0 <= 2 * seq))
    return (
        F.when(two & (d0 == d1) & (d0 > 64), square)
        .when(two & (d0 == hidden) & (d1 > 2 * d0), "mlp_up")
        .when(two & (d1 == hidden) & (d0 > 2 * d1), "mlp_down")
        .when(two & (d0 == hidden) & (d1 == vocab), "output_projection")
        .when(two & (d1 == hidden) & (d0 > 1) & (d0 < 100), "router_weights")
        .when(two & embedding & (d0 > vocab // 2), "token_embeddings")
        .when(two & embedding, "position_embeddings")
        .when((F.size(shape) == 1) & (d0 == hidden), "layer_norm")
        .otherwise("unknown")
    )


def rag_prompt(contexts: Column) -> Column:
    """System message with the numbered contexts; null without any."""
    body = F.array_join(F.transform(contexts, lambda d, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), d)), "\n\n---\n\n")
    head = "You are a helpful assistant. Use the following context to answer the user's question accurately.\n\n"
    return F.when(F.size(contexts) > 0, F.concat(F.lit(head), body))


def message_line(role: Column, text: Column) -> Column:
    return F.concat(F.initcap(role), F.lit(": "), text)
