"""Near-duplicates, substrings, token files, decontamination, packing and the pipeline against brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glyphsphere.llm import common, decontamination, near_dedup, ordering, packing, queries, substring_dedup, token_files, tokenization
from glyphsphere.llm.components import components

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "1234 !! 's don't <|endoftext|> 中文 İ"), (None, "no id here"), (7, "same"), (7, "same"), (7, "other"), (9, "x" * 60_000), (10, "ein wort " * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, class_id int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def set_classes(texts, similarity=0.8):
    """Smallest id of each component of the exact similarity graph."""
    own = [r for _, rows in near_dedup.shingles(pa.array([t for _, t in texts])) for r in rows]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i][1] is not None and (texts[i][1] == texts[j][1] or near_dedup.probability_jaccard(*own[i], *own[j]) >= similarity):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i, (k, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(texts)}


def near_copies(rng, many, words=120, edits=(0, 14)):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(many):
        w = base.copy()
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_finds_exactly_the_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SLOT", 8)
    monkeypatch.setattr(near_dedup, "SHARE", 16)
    rng = random.Random(5)
    texts = near_copies(rng, 90) + near_copies(rng, 30, 60, (0, 3)) + near_copies(rng, 6, 40) * 2 + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts += ["a b c d e f g " * 30, "a b c d e f g " * 31, "tiny", "tiny", "", "two words"]
    rng.shuffle(texts)
    rows = [(i * 7 + 1, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set_classes(rows)


def test_probability_jaccard_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = rng.integers(0, 4, 12), rng.integers(0, 4, 12)
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(12)) for i in range(12) if x[i] and y[i])
        ids = np.arange(12, dtype=np.uint64)
        assert abs(near_dedup.probability_jaccard(ids[x > 0], x[x > 0], ids[y > 0], y[y > 0]) - want) < 1e-9


def test_signatures_estimate_it():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.integers(1, 5, 300)
    a, b = (h[:240], w[:240]), (h[40:], w[40:] + (np.arange(260) % 2))
    s = near_dedup.signatures([a, b], 4096)
    assert abs((s[0] == s[1]).mean() - near_dedup.probability_jaccard(*a, *b)) < 0.03
    assert (near_dedup.signatures([a], 64) == near_dedup.signatures([b, a], 64)[1]).all()


def test_near_dedup_odd_rows(odd, nothing):
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(ODD) and near_dedup.classes(nothing).count() == 0
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.filter("text = 'same'").count() == 1 and kept.filter("text IS NULL").count() == 1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert len(set(got.values())) == 2 and got[0] == got[40] != got[100] == got[102]


def brute_windows(rows, n=20):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), (doc, i)) != (doc, i):
                gone[i : i + n] = [True] * n
        out[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("shard", [2000, 3])
def test_substring_dedup_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rng = random.Random(shard)
    words = [f"v{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((i, "  ".join(w)))
    rows += [(100, "a " * 70), (101, "a b " * 40), (102, rows[3][1]), (103, ""), (104, None)]
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"] or "") for r in got} == brute_windows(rows)


def test_suffix_automaton_against_search():
    rng = random.Random(1)
    texts = [[rng.choice("abc") for _ in range(40)] for _ in range(4)]
    automaton, at = substring_dedup.SuffixAutomaton(), 0
    for t in texts:
        automaton.add(t, at)
        at += len(t)
    query = [rng.choice("abc") for _ in range(60)]
    ends = automaton.matches(query, 5)
    flat = [w for t in texts for w in t]
    for i, end in enumerate(ends):
        want = i >= 4 and any(query[i - 4 : i + 1] == t[k : k + 5] for t in texts for k in range(len(t) - 4))
        assert (end >= 0) == want and (not want or flat[end - 4 : end + 1] == query[i - 4 : i + 1])


def test_substring_against_reference(spark, odd, nothing):
    ref = " ".join(f"r{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"r{i}" for i in range(5, 35)) + " z"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: [list(s) for s in r["spans"]] for r in substring_dedup.against_reference(docs, [ref]).collect()}
    assert got == {1: [[2, 32]], 2: []}
    assert substring_dedup.deduplicated(odd).count() == len(ODD) and substring_dedup.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = tokenization.public_tokenizer(name)
    tok, own = Tokenizer.from_file(path), tokenization.Encoder(open(path).read(), 2)
    rng = random.Random(2)
    chars = "ab 's'tre ve'll'd  \n\t\r.,!09²éÀ'ÉŒ'<|中İ \x85\xa0 ſß"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", "don't I'M we'RE <|endoftext|>"]
    got = [r for _, rows in own.encode(pa.array(texts)) for r in rows]
    assert all(list(g) == [*tok.encode(t or "", add_special_tokens=False).ids, 2] for t, g in zip(texts, got, strict=True))


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        r = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint64).astype(np.uint32)
        assert (token_files.decode_ranks(*token_files.encode_ranks(r), n) == r).all()


def ordered_ids(rows, name):
    tok = Tokenizer.from_file(tokenization.public_tokenizer(name))
    out = [(k, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<u2").tobytes()))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("rows_a_bucket", [8192, 3])
def test_token_files_against_brute_force(spark, odd, nothing, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(ordering.bucket_bounds, "__defaults__", (rows_a_bucket,))
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    want, start = [], 0
    for k, ids in ordered_ids(ODD, "byte_bpe_50k.json"):
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in token_files.round_trip(odd).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.round_trip(nothing).count() == 0


@pytest.mark.parametrize("rows_a_bucket", [8192, 3])
def test_packing_against_brute_force(spark, odd, nothing, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(ordering.bucket_bounds, "__defaults__", (rows_a_bucket,))
    want, place = [], 0
    for k, ids in ordered_ids(ODD, "word_bpe_49k.json"):
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, 4096 - place % 4096)
            want.append((k, at, n, crc(ids[at : at + n]), len(ids), place // 4096, place % 4096))
            at, place = at + n, place + n
    got = [tuple(r) for r in packing.pieces(odd).collect()]
    assert sorted(got, key=lambda r: r[5:]) == want
    assert packing.pieces(nothing).count() == 0


def brute_leaks(docs, items, share=0.8):
    """By definition: all shingles of five words, or of all of a shorter item's, looked up one by one."""

    def shingles(t, n):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    lengths = {i: min(5, len([x for x in re.split(r"[\W_]+", (t or "").lower()) if x])) for i, t in items}
    own = {i: shingles(t, lengths[i]) for i, t in items}
    found = {(d, n): shingles(t, n) for d, t in docs for n in {*lengths.values()}}
    return {(d, i) for d, _ in docs for i, q in own.items() if q and len(q & found[d, lengths[i]]) >= share * len(q) - 1e-9}


def test_decontamination_against_brute_force(spark, odd, nothing):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(n))) for i, n in enumerate([3, 5, 6, 9, 20, 40, 90, 200])]
    items += [(90, "q7"), (91, "Q1 q2!"), (92, "q3 q3 q3 q3"), (93, ""), (94, "!?"), (95, None)]
    docs = []
    for i in range(80):
        w = [f"q{rng.randrange(500)}" for _ in range(rng.randint(0, 400))]
        p = rng.choice(items[:8])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            p[rng.randrange(len(p))] = "changed"
        at = rng.randint(0, len(w))
        docs.append((i, " ".join([*w[:at], *p, *w[at:]]).upper()))
    docs += [(800, "q3 q3 q3, q3"), (801, "q3 q3 q3"), (802, "q1 and q2"), (803, None), (804, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()}
    assert got == brute_leaks(docs, items) and got
    kept = {r["doc_id"] for r in decontamination.clean(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(odd, b).count() == 0 and decontamination.contaminated(d, none).count() == 0 and decontamination.contaminated(nothing, b).count() == 0
    assert decontamination.clean(odd, b).count() == len(ODD)


def test_decontamination_uses_no_python(spark):
    plan = queries.op9_decontamination(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = got
        got = stage(spark, got, DATA).cache()
        kept.append((name, got.count()))
        assert got.columns == docs.columns and got.select("doc_id").subtract(before.select("doc_id")).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(set(set_classes(rows).values())) == len(rows)  # no near-duplicates are left
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert not brute_leaks(rows, items)
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in rows}
    ids = dict(ordered_ids(rows, "word_bpe_49k.json"))
    assert all(crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in out)
    ends = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert [s * 4096 + o for s, o, _ in ends] == [0, *np.cumsum([n for *_, n in ends])[:-1]]


def test_pipeline_bounds_what_a_worker_gets_at_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = spark.range(0, 2000, numPartitions=1).selectExpr("repeat('x', 4096) AS text")  # 8 MB
    sizes = lambda: [r[0] for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    whole = {}
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, DATA)
            if name != "decontamination":  # no Python there
                assert sum(sizes()) > 8e6 and max(sizes()) < common.BATCH_BYTES + 10_000, name
        for most in ("64m", "4k"):  # wherever batches are cut, the result is the same; a lower setting stays
            spark.conf.set(key, most)
            whole[most] = sorted(corpus_pipeline.run(spark, DATA).collect())
        assert whole["64m"] == whole["4k"] and spark.conf.get(key).startswith("4")
    finally:
        spark.conf.unset(key)
