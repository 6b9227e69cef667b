import hashlib
import json
import math
import os
import random
import re
import struct
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphsphere.functions import hashing, hilbert
from glyphsphere.operators import cells, compositions, contraction, extraction, graph, layout, learners, maintenance, ordered, relations, scoring, topk
from glyphsphere.plans import catalog
from glyphsphere.sources import atoms, files, sinks
from glyphsphere.streaming import ratings

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canon(df):
    def one(x):
        if x is None or x != x:
            return None
        if isinstance(x, (float, np.floating)):
            return round(float(x), 5) + 0.0
        return int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else str(x)

    df = df.astype(object).where(df.notna(), None)
    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert canon(catalog.QUERIES[name](spark, DATA).toPandas()) == canon(con.sql(catalog.SQL[name]).df())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_blake3_vectors():
    v = bytes(i % 251 for i in range(2049))
    assert hashing.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3(v[:1025]).hex().startswith("d00278ae47eb27b3") and hashing.blake3(v).hex().startswith("5f4d72f40d7a5f82")
    many = [v[:n] for n in (0, 1, 3, 63, 64, 65, 500, 1023, 1024, 1025, 2049)]
    assert hashing.blake3_many(many) == [hashing.blake3(m) for m in many]
    assert hashing.text_hash("") is None and hashing.text_hash("A") == hashing.blake3(b"A")


def test_hilbert_round_trip():
    p = np.random.default_rng(1).integers(0, 2**32, (500, 4), dtype=np.uint64).astype(np.uint32)
    hi, lo = hilbert.encode(p)
    assert (hilbert.decode(hi, lo) == p).all()
    assert len({(int(h), int(x)) for h, x in zip(hi, lo, strict=True)}) == 500
    hi, lo = hilbert.encode(np.array([[2**31] * 4], np.uint32))
    assert hi[0] == lo[0] == 0


def test_atoms_on_sphere(spark):
    a = {r["codepoint"]: (r["x"], r["y"], r["z"], r["m"]) for r in atoms.points(spark).filter("codepoint < 200").collect()}
    assert all(abs(sum(v * v for v in p) - 1) < 1e-5 for p in a.values())
    d = lambda i, j: math.dist(a[ord(i)], a[ord(j)])
    assert d("A", "a") < d("A", "Z")
    assert atoms.codepoints(spark).count() == 1_112_064


def test_frechet_is_a_symmetric_bound_of_the_ends(spark):
    words = ["hello", "hallo", "world"]
    d = {(r["a"], r["b"]): r["distance"] for r in atoms.frechet_pairs(spark.createDataFrame([(w,) for w in words], "text string")).collect()}
    p = {r["codepoint"]: (r["x"], r["y"], r["z"], r["m"]) for r in atoms.points(spark).filter("codepoint < 200").collect()}
    for (a, b), v in d.items():
        ends = max(math.dist(p[ord(a[0])], p[ord(b[0])]), math.dist(p[ord(a[-1])], p[ord(b[-1])]))
        assert v == d[b, a] and v >= ends - 1e-6
    assert abs(d["hello", "hallo"] - math.dist(p[ord("e")], p[ord("a")])) < 1e-5 or d["hello", "hallo"] < math.dist(p[ord("e")], p[ord("a")])


def test_seed_is_idempotent(spark, tmp_path, monkeypatch):
    few = atoms.generate(spark).filter("codepoint BETWEEN 48 AND 57")
    monkeypatch.setattr(atoms, "generate", lambda _: few)
    assert atoms.seed(spark, f"file://{tmp_path}/atoms") == 10 and atoms.seed(spark, f"file://{tmp_path}/atoms") == 0


def test_reconstruct_and_traverse(spark):
    text = ["Hello", "Mississippi", "Banana", "世界"]
    kids = spark.createDataFrame([(w, i, c) for w in text for i, c in enumerate(w)], "parent string, ordinal long, child string")
    labels = kids.selectExpr("child AS node", "child AS label").distinct()
    got = {r["node"]: r["label"] for r in compositions.reconstructed(kids, labels).collect()}
    assert {w: got[w] for w in text} == {w: w for w in text}
    below = graph.descendants(kids, spark.createDataFrame([("Banana",)], "root string"), 3)
    assert below.count() == 7


def test_compositions_of_several_levels_share_nodes(spark):
    rows = [("doc", 0, "w1"), ("doc", 1, "w2"), ("doc", 2, "w1"), ("w1", 0, "a"), ("w1", 1, "b"), ("w2", 0, "c"), ("top", 0, "doc"), ("top", 1, "w2"), ("lost", 0, "nowhere")]
    kids = spark.createDataFrame(rows, "parent string, ordinal long, child string")
    atoms = spark.createDataFrame([(x, x) for x in "abc"], "node string, label string")
    got = {r["node"]: (r["label"], r["level"]) for r in compositions.reconstructed(kids, atoms).collect()}
    assert got["doc"] == ("abcab", 2) and got["top"] == ("abcabc", 3) and got["w2"] == ("c", 1) and "lost" not in got
    stats = compositions.statistics(kids, atoms)
    assert {r["node"]: (r["atom_count"], r["child_count"]) for r in stats.collect()} == {"a": (1, 0), "b": (1, 0), "c": (1, 0), "w1": (2, 2), "w2": (1, 1), "doc": (5, 3), "top": (6, 2)}
    bad = {r["check_name"]: r["bad"] for r in compositions.checked(kids, atoms, stats).collect()}
    assert bad == {"orphan_children": 1, "leaves_with_children": 0, "atom_count": 0, "child_count": 0, "ordinal_gaps": 0}
    worse = kids.unionByName(spark.createDataFrame([("a", 0, "b"), ("w2", 5, "c")], kids.schema))
    bad = {r["check_name"]: r["bad"] for r in compositions.checked(worse, atoms, stats).collect()}
    assert bad["leaves_with_children"] == 1 and bad["ordinal_gaps"] == 1 and bad["child_count"] == 2 and bad["atom_count"] == 1


def test_centroids_round_halves_up(spark, tmp_path):
    texts = ["Nd inerha.\n", "Ha erorer.\n", "Èqueleé une. ", "Hain erater.\n", "Enverte beö. ", "Shwhble the.\n"]  # each a half at the seventh decimal
    spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.node: r.x for r in catalog.QUERIES["a3_a4_hierarchical_centroids"](spark, str(tmp_path)).collect()}
    mean = lambda xs: sum(xs, Fraction(0)) / len(xs)
    for s in texts:
        words = re.findall(r"\S+\s*", s)
        x = mean([mean([Fraction(ord(c), 1000) for c in w]) for w in words]) * 10**6
        assert x % 1 == Fraction(1, 2)
        assert found[hashlib.md5(s.encode()).hexdigest()] == float((x + Fraction(1, 2)) / 10**6)


def test_ingested_texts_round_trip(spark):
    texts = ["One two. Three!\n\nFour", "Four", "x", "", None, "  lead and trail \n", "same same. same same. ", "a.b.c"]
    kids, atoms = compositions.ingested(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r["node"]: r["label"] for r in compositions.reconstructed(kids, atoms).collect()}
    for t in filter(None, texts):
        assert got[hashlib.md5(t.encode()).hexdigest()] == t
    assert kids.count() == kids.dropDuplicates(["parent", "ordinal"]).count() and kids.filter("parent = child").count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in catalog.SQL if catalog.QUERIES[n].__closure__[0].cell_contents.__module__.endswith("composition_queries")))
def test_compositions_write_no_edges(spark, monkeypatch, name):
    """Only nodes are shuffled: no query over all documents writes or shuffles (parent, ordinal, child)."""
    monkeypatch.setattr(compositions, "ingested", None)
    monkeypatch.setattr(compositions, "cut", None)
    found = catalog.QUERIES[name](spark, DATA)
    assert "ordinal#" not in found._jdf.queryExecution().executedPlan().toString()


def test_folded_texts_equal_the_edge_tables(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab .!\n") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "a", "ab", "aa. aa."]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    children, leaves = compositions.ingested(df)
    want = {tuple(r) for r in compositions.statistics(children, leaves).select("node", "level", "child_count", "atom_count").collect()}
    assert {tuple(r) for r in compositions.counted(df).collect()} == want
    edges = [tuple(r) for r in children.select("parent", "child").collect()]
    got = {r["node"]: r["parents"] for r in compositions.parent_counts(df).collect()}
    assert got == dict(Counter(c for _, c in set(edges)))
    assert {r["node"] for r in compositions.whole_texts(df, 2, 400).collect()} == {p for p, _ in edges} - {c for _, c in edges}
    below = {(r["root"], r["node"]) for r in graph.descendants(children, df.filter("text <> ''").select(F.md5("text").alias("root")).distinct(), 8).filter("depth > 0").collect()}
    mine = {n for r, n in below if r == hashlib.md5(b"aa. aa.").hexdigest()}
    shared = Counter(r for r, n in below if n in mine and r != hashlib.md5(b"aa. aa.").hexdigest())
    assert dict(map(tuple, compositions.shared_parts(df, "aa. aa.").collect())) == dict(shared)


def test_checks_of_nodes_find_planted_faults(spark):
    def row(name, *rest):
        return (name.encode(), *rest)

    good = [row("a", False, True, 0, -1, 1, 1), row("ab", False, False, 2, 1, 2, 2), row("b", False, True, 0, -1, 1, 1), row("a", True, *[None] * 5), row("b", True, *[None] * 5)]
    bad = {
        "orphan_children": [row("x", True, *[None] * 5)], "leaves_with_children": [row("c", False, True, 1, 0, 1, 1)], "atom_count": [row("d", False, False, 2, 1, 3, 2)],
        "child_count": [row("ab", False, False, 3, 2, 2, 2)], "ordinal_gaps": [row("e", False, False, 2, 2, 2, 2)],
    }
    check = lambda rows: dict(map(tuple, compositions.checked_nodes(spark.createDataFrame(rows, compositions.CHECKED)).collect()))
    assert check(good) == dict.fromkeys(bad, 0)
    for name, rows in bad.items():
        assert check(good + rows) == dict.fromkeys(bad, 0) | {name: 1}


def test_places_in_a_total_order(spark):
    df = spark.createDataFrame([((i * 37) % 101, i % 5) for i in range(101)], "a long, b long")
    got = [(r["a"], r["place"]) for r in topk.placed(df, [F.desc("a")], parts=6).orderBy("place").collect()]
    assert got == [(100 - i, i + 1) for i in range(101)]
    assert topk.placed(df.filter("false"), [F.col("a")]).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(50)], "id long, n long")
    order = sorted(range(50), key=lambda i: (-(i // 3), i))
    at = order.index(20)
    after = topk.page(df, "n", "id", 10, after=20).collect()
    before = topk.page(df, "n", "id", 10, before=20).collect()
    assert {r["id"] for r in after} == set(order[at + 1 : at + 11]) and all(r["has_more"] for r in after)
    assert {r["id"] for r in before} == set(order[at - 10 : at]) and all(r["has_more"] for r in before)
    assert [r["has_more"] for r in topk.page(df, "n", "id", 100, after=order[-3]).collect()] == [False] * 2


def test_generation_against_brute_force(spark):
    rng = random.Random(4)
    words = [(f"w{i}", rng.randint(1, 50), [rng.random() for _ in range(4)]) for i in range(12)] + [(".", 3, [0.5] * 4)]
    links = [(a[0], b[0], rng.random()) for a in words for b in words if rng.random() < 0.4]
    heed = [(a[0], b[0], rng.random()) for a in words for b in words if rng.random() < 0.3]
    model = scoring.Words(
        spark.createDataFrame(words, "word string, n long, place array<double>"), spark.createDataFrame(links, "src string, dst string, pmi double"),
        spark.createDataFrame(heed, "src string, dst string, weight double"),
    )
    place = {w: p for w, _, p in words}
    top, pmi, attention = max(p for *_, p in links), {(a, b): p for a, b, p in links}, {(a, b): p for a, b, p in heed}

    def best(last, without):
        def score(w, n):
            return 0.4 / (1 + math.dist(place[w], place[last])) + 0.3 * pmi.get((last, w), 0) / top + 0.2 * attention.get((last, w), 0) + 0.1 * math.log1p(n) / 10

        return max(((score(w, n), w) for w, n, _ in words if w not in {last, *without}), key=lambda x: (x[0], [-ord(c) for c in x[1]]))[1]

    for again in (True, False):
        path = ["w0"]
        while len(path) < 7 and (len(path) == 1 or path[-1] != "."):
            path.append(best(path[-1], () if again else path))
        assert [r["word"] for r in scoring.generate(model, "w0", 6, again=again).orderBy("position").collect()] == path
    assert scoring.generate(model, "unknown", 3).count() == 0


def test_walks_are_self_avoiding(spark):
    e = spark.createDataFrame([(i, j, 1.0 + j) for i in range(6) for j in range(6) if i != j], "src long, dst long, weight double")
    starts = spark.range(3).selectExpr("id AS start")
    first = sorted(map(tuple, graph.walks(e, starts, 4).collect()))
    assert first == sorted(map(tuple, graph.walks(e, starts, 4).collect()))
    for s in range(3):
        nodes = [n for a, _, n in first if a == s]
        assert len(nodes) == len(set(nodes)) == 5


def test_spectral_coordinates_are_orthonormal(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 12, 1.0) for i in range(12)], "src long, dst long, weight double")
    c = np.array([list(r)[1:] for r in graph.spectral_coordinates(ring).orderBy("node").collect()])
    assert np.allclose(c.T @ c, np.eye(4), atol=1e-9)


def test_lanczos_equals_the_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    pairs = {(i, i + 1) for i in range(39)} | {tuple(sorted(map(int, rng.choice(40, 2, False)))) for _ in range(40)}
    df = spark.createDataFrame([(i, j, float(rng.uniform(0.2, 1))) for i, j in sorted(pairs)], "src long, dst long, weight double")
    dense = np.array([list(r)[1:] for r in graph.spectral_coordinates(df).orderBy("node").collect()])
    steps = np.array([list(r)[1:] for r in graph.spectral_coordinates(df, dense=5).orderBy("node").collect()])
    assert np.allclose(np.abs((dense * steps).sum(0)), 1, atol=1e-4) and np.allclose(steps.T @ steps, np.eye(4), atol=1e-6)


def test_sparse_steps_equal_the_dense_eigenvectors(spark, monkeypatch):
    """Few and many steps, with a basis that is full before they are done; and no step is a job."""
    monkeypatch.setattr(graph, "lanczos_coordinates", None)
    rng = np.random.default_rng(6)
    pairs = {(i, i + 1) for i in range(299)} | {tuple(sorted(map(int, rng.choice(300, 2, False)))) for _ in range(600)}
    df = spark.createDataFrame([(i, j, float(rng.uniform(0.2, 1))) for i, j in sorted(pairs)], "src long, dst long, weight double")
    dense = np.array([list(r)[1:] for r in graph.spectral_coordinates(df).orderBy("node").collect()])
    for size in (1 << 28, 8 * 300 * 40):
        monkeypatch.setattr(graph, "BASIS_BYTES", size)
        steps = np.array([list(r)[1:] for r in graph.spectral_coordinates(df, dense=5).orderBy("node").collect()])
        assert np.allclose(np.abs((dense * steps).sum(0)), 1, atol=1e-4) and np.allclose(steps.T @ steps, np.eye(4), atol=1e-6)


def test_joined_steps_equal_the_dense_eigenvectors(spark):
    df = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(14)], "src long, dst long, weight double")
    dense, steps = (np.array([list(r)[1:] for r in graph.spectral_coordinates(df, dense=d, sparse=0).orderBy("node").collect()]) for d in (20, 5))
    assert np.allclose(np.abs((dense * steps).sum(0)), 1, atol=1e-4)


def test_edges_both_ways(spark):
    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("a", "d")], "src string, dst string")
    assert sorted(map(tuple, graph.both_ways(e).collect())) == [("a", "b"), ("a", "d"), ("b", "a"), ("c", "c"), ("d", "a")]
    plan = graph.both_ways(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Union" not in plan


def tables_in(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    for d in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {d.stem} AS SELECT * FROM '{d}/*.parquet'")
    return canon(catalog.QUERIES[name](spark, folder).toPandas()) == canon(con.sql(catalog.SQL[name]).df())


def test_wide_distances_of_large_keys(spark, tmp_path):
    folder = tables_in(spark, tmp_path, orders=([(50, 7), (1, 8132), (2, 1500), (60_000_000, 5_400_000), (3, 0)], "o_orderkey long, o_custkey long"))
    assert equals_sql(spark, folder, "hb3_wide_distance")


@pytest.mark.parametrize("name", ["a22_category_distribution", "t1_t2_characters"])
def test_characters_of_an_empty_text(spark, tmp_path, name):
    folder = tables_in(spark, tmp_path, documents=([(1, ""), (2, "aé\n"), (3, None), (4, "\0🎉e\u0301")], "doc_id long, text string"))
    assert equals_sql(spark, folder, name)


@needs_data
def test_places_of_characters_need_no_table_of_atoms(spark):
    assert "Join" not in catalog.QUERIES["j12_ordered_characters"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_bridges_connect_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (5, 6), (8, 7), (7, 9)], "src long, dst long")
    assert sorted(map(tuple, graph.bridges(e).collect())) == [(2, 5), (2, 7)]


def test_points_as_ewkb(spark):
    p = [(1, 0.5, -1.0, 2.0, 3.25), (2, 0.0, 0.0, 0.0, 1.0)]
    rows = sinks.with_ewkb(spark.createDataFrame(p, "id long, x double, y double, z double, m double")).collect()
    assert {r["id"]: bytes(r["ewkb"]) for r in rows} == {i: files.point_ewkb([tuple(x)]) for i, *x in p}


def test_batch_knn_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    n = v / np.linalg.norm(v, axis=1)[:, None]
    s = n @ n.T
    np.fill_diagonal(s, -9)
    got = {(r["src"], r["rank"]): r["dst"] for r in topk.batch_knn(df, df, 3).collect()}
    assert all(got[i, k + 1] == np.argsort(-s[i])[k] for i in range(60) for k in range(3))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_batch_knn_streams_tiles(spark, monkeypatch, metric):
    """Single vectors go to the workers, no lists of them, and tiles of any size give the same neighbours; equal vectors tie by id."""
    for name, n in (("BLOCK", 16), ("ROWS", 5), ("COLUMNS", 6)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(70, 4)).astype(np.float32).astype(float)
    v[10:40:3] = v[1]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    n = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(-(n @ n.T) if metric == "cosine" else np.linalg.norm(v[:, None] - v, axis=2), 12)
    want = {(i, k + 1): j for i in range(70) for k, j in enumerate(sorted((j for j in range(70) if j != i), key=lambda j: (s[i, j], j))[:4])}
    found = topk.batch_knn(df, df, 4, metric)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert {(r["src"], r["rank"]): r["dst"] for r in rows} == want
    assert metric == "cosine" or all(r["score"] == 0 for r in rows if r["src"] in range(10, 40, 3))
    pairs = {(r["src"], r["dst"]) for r in topk.batch_knn(df, df, None, least=0.5).collect()}
    assert pairs == {(i, j) for i in range(70) for j in range(70) if i != j and (n @ n.T)[i, j] >= 0.5}


def test_learners(spark):
    docs = spark.createDataFrame([(1, "abababab"), (2, ""), (3, None)], "doc_id long, text string")
    m = learners.pair_merges(docs, 5).collect()
    assert (m[0]["left"], m[0]["right"], m[0]["n"]) == ("a", "b", 4)
    rules = learners.grammar("a b c d a b c d x".split())

    def flat(r):
        return [w for x in rules[r] for w in (flat(x) if isinstance(x, int) else [x])]

    assert flat(-1) == "a b c d a b c d x".split()
    body = [tuple(b[i : i + 2]) for b in rules.values() for i in range(len(b) - 1)]
    assert len(body) == len(set(body))
    assert learners.segmented("abcabd", learners.trie(["ab", "abc", "b"])) == [("abc", True), ("ab", True), ("d", False)]
    hits = learners.keyword_search(spark.createDataFrame([(1, "use c++ (now)", 3), (2, "ccc now", 3)], "id long, text string, depth int"), "c++ (now", 5)
    assert [r["id"] for r in hits.collect()] == [1]


def test_grammars_of_random_sequences():
    rng = random.Random(3)
    for _ in range(3000):
        seq = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))]
        rules = learners.grammar(seq)

        def flat(r, rules=rules):
            return [w for x in rules[r] for w in (flat(x) if isinstance(x, int) else [x])]

        assert flat(-1) == seq
        used, seen = Counter(x for b in rules.values() for x in b if isinstance(x, int)), {}
        assert all(used[r] >= 2 for r in rules if r != -1)
        for r, b in rules.items():
            for i, d in enumerate(zip(b, b[1:], strict=False)):
                at = seen.setdefault(d, (r, i))
                assert at == (r, i) or at == (r, i - 1)  # only overlapping ones may be equal


def brute_merges(text):
    seq, out = list(text), []
    while pairs := Counter(zip(seq, seq[1:], strict=False)):
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        out.append((len(out), a, b, n))
        merged, i = [], 0
        while i < len(seq):
            size = 2 if seq[i : i + 2] == [a, b] else 1
            merged.append("".join(seq[i : i + size]))
            i += size
        seq = merged
    return out


def test_pair_merges_of_all_documents(spark):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("ab c"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 80)))
        assert learners.merges(list(text)) == brute_merges(text)
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {}
    for r in entry.queries()["t10_merges"](spark, folder).collect():
        got.setdefault(r["doc_id"], []).append((r["step"], r["left"], r["right"], r["n"]))
    assert set(got) == {k for k, x in docs.items() if learners.merges(list(x or ""))}
    assert max(got) >= 50 and max(map(len, got.values())) > 20
    assert all(sorted(got[k]) == brute_merges(docs[k]) for k in got if len(docs[k]) < 1000)


def brute_contraction(text, where, twice=2):
    """Lists searched anew for every step; a pair's information is kept until its count changes."""
    names = sorted(set(text))
    seq, spots, depth, made, out, rated, counts = [names.index(c) for c in text], [where(c) for c in names], [0] * len(names), {}, [], {}, {}
    while len(seq) > 1:
        if (now := Counter(zip(seq, seq[1:]))) != counts:
            single = Counter(seq)
            for p in now:
                if now[p] != counts.get(p):
                    rated[p] = math.log2((now[p] / (len(seq) - 1)) / ((single[p[0]] / len(seq)) * (single[p[1]] / len(seq))))
            counts = now
        good = [(-rated[p], p) for p in counts if counts[p] >= twice and rated[p] > 0]
        if good:
            pair = min(good)[1]
            at = range(len(seq))
        else:
            dots = [sum(a * b for a, b in zip(spots[x], spots[y])) for x, y in zip(seq, seq[1:])]
            i = min(range(len(dots)), key=lambda k: (math.acos(max(-1, min(1, dots[k]))), k))
            pair, at = (seq[i], seq[i + 1]), [i]
        if pair not in made:
            made[pair] = len(spots)
            depth.append(max(depth[pair[0]], depth[pair[1]]) + 1)
            spots.append(contraction.between(spots[pair[0]], spots[pair[1]], depth[-1]))
        new, i, n = [], 0, 0
        while i < len(seq):
            if i in at and tuple(seq[i : i + 2]) == pair:
                new.append(made[pair])
                i, n = i + 2, n + 1
            else:
                new.append(seq[i])
                i += 1
        out.append((*pair, made[pair], "information" if good else "angle", n))
        seq = new
    return out


def test_contraction_equals_brute_force(spark):
    rng = random.Random(4)
    spot = {c: contraction._unit(tuple(rng.uniform(-1, 1) for _ in range(4))) for c in "abcde"}
    for n in [0, 1, 2, 3, 5, 9, 20, 60, 200] * 6:
        text = "".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(n))
        got = contraction.contraction(text, spot.__getitem__)
        assert [(*r[1:6],) for r in got] == brute_contraction(text, spot.__getitem__), text
        assert sum(r[5] for r in got) == max(0, n - 1)
    docs = spark.createDataFrame([(1, "abcabc"), (2, None), (3, ""), (4, "a"), (1, "abcabc")], "doc_id long, text string")
    points = spark.createDataFrame([(ord(c), *p) for c, p in spot.items()], "codepoint long, x double, y double, z double, m double")
    rows = contraction.contracted(docs, points).groupBy("doc_id").agg(F.sum("n")).collect()
    assert list(map(tuple, rows)) == [(1, 10)]


def test_elo_modes(spark):
    o = spark.createDataFrame([("a", "b", i, 1.0) for i in range(50)], "src string, dst string, ts long, w double")
    r = relations.elo_fold(o, ["src", "dst"], ["ts"], "w").first()
    low = relations.elo_fold(o, ["src", "dst"], ["ts"], "w", mode="min").first()
    assert r["observations"] == 50 and 1500 < low["rating"] < r["rating"] < 3000


def test_upserts(spark):
    old = spark.createDataFrame([(1, None), (2, 5.0)], "id long, v double")
    new = spark.createDataFrame([(1, 7.0), (2, 9.0), (3, 1.0)], "id long, v double")
    assert sorted(map(tuple, maintenance.upsert_missing(old, new, "id", "v").collect())) == [(1, 7.0), (2, 5.0), (3, 1.0)]
    assert maintenance.append_missing(old, new, ["id"]).count() == 3


def test_model_files(spark, tmp_path):
    f32 = np.arange(6, dtype="<f4").tobytes()
    f16 = np.array([1.5, -2], "<f2").tobytes()
    bf16 = (np.array([3.0], "<f4").view("<u4") >> 16).astype("<u2").tobytes()
    head, at = {}, 0
    for name, dtype, shape, raw in (("a", "F32", [2, 3], f32), ("b", "F16", [2], f16), ("c", "BF16", [1], bf16)):
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    text = json.dumps({"__metadata__": {"format": "pt"}, **head}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(text)) + text + f32 + f16 + bf16)
    root = f"file://{tmp_path}"
    assert {r["name"]: r["dtype"] for r in files.tensor_headers(spark, root).collect()} == {"a": "F32", "b": "F16", "c": "BF16"}
    rows = {(r["name"], r["row"]): r["values"] for r in files.tensor_rows(spark, root).collect()}
    assert rows["a", 1] == [3, 4, 5] and rows["b", 0] == [1.5, -2] and rows["c", 0] == [3]
    assert files.models(spark, root).first()["files"] == 1
    (tmp_path / "tok.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1}, "merges": ["a b"]}, "x": {"y": [1, "z"]}}))
    (tmp_path / "index.json").write_text(json.dumps({"weight_map": {"w": "one"}}))
    (tmp_path / "vocab.txt").write_text("x\ny\n")
    (tmp_path / "req.jsonl").write_text('{"custom_id": "1", "method": "POST"}\nnot json\n{"method": "GET"}\n')
    assert {tuple(r) for r in files.tokenizer_vocab(spark, f"{root}/tok.json").collect()} == {("a", 0), ("b", 1)}
    assert [tuple(r) for r in files.tokenizer_merges(spark, f"{root}/tok.json").collect()] == [(0, "a", "b")]
    assert [tuple(r) for r in files.model_index(spark, f"{root}/index.json").collect()] == [("w", "one")]
    assert [tuple(r) for r in files.vocab_lines(spark, f"{root}/vocab.txt").collect()] == [("x", 0), ("y", 1)]
    assert ("x.y.1", "z") in {tuple(r) for r in files.flattened_config(spark, f"{root}/tok.json").collect()}
    assert files.batch_requests(spark, f"{root}/req.jsonl").count() == 1
    assert files.texts(spark, root, "*.txt").count() == 1
    assert len(files.point_ewkb([(0, 0, 0, 0)])) == 37


def test_streamed_ratings_equal_batch(spark, tmp_path):
    rows = [(i % 3, "ab"[i % 2], i, i, ((i * 7) % 11) / 5 - 1) for i in range(60)]
    df = spark.createDataFrame(rows, "src long, dst string, ts long, seq long, weight double")
    for k in range(3):
        df.filter(f"seq >= {k * 20} AND seq < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = ratings.streamed_ratings(stream).writeStream.outputMode("update").format("memory").queryName("rated").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["src"], r["dst"]): r["rating"] for r in spark.sql("SELECT src, dst, max_by(rating, observations) AS rating FROM rated GROUP BY ALL").collect()}
    want = {(r["src"], r["dst"]): r["rating"] for r in relations.elo_fold(df, ["src", "dst"], ["ts"], "weight").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def neighbours_by_hand(ids, v, asked, k):
    n = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(n @ n.T, 12)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]] for i in asked}


@pytest.mark.parametrize("kind", ["random", "clustered", "hot"])
def test_cells_find_nine_of_ten_neighbours(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1200, 12))
    if kind != "random":
        v = rng.normal(size=(30, 12))[rng.integers(0, 30, 1200)] + 0.2 * v
    if kind == "hot":
        v[:400] = v[0]
        monkeypatch.setattr(topk, "BLOCK", 7)
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)] + [(5000, None, "x"), (5001, [0.0] * 12, "x"), (5002, [1.0], "x"), (None, [1.0] * 12, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cells string")
    index = cells.fit(df, 10)
    got = {}
    for r in cells.approximate_knn(df.filter("vec_id % 20 = 0"), df, 10, index).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    want = neighbours_by_hand(list(range(1200)), v, range(0, 1200, 20), 10)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert np.mean([len(set(got[i].values()) & set(want[i])) / 10 for i in want]) >= 0.9
    if kind == "clustered":
        assert index.probes < len(index.centres) / 2


def test_cells_of_an_empty_table(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert cells.approximate_knn(none, none, 3, cells.fit(none)).count() == 0


def test_neighbours_stay_in_their_group(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 5)
    v = np.random.default_rng(6).normal(size=(90, 4))
    df = spark.createDataFrame([(i, "big" if i < 80 else "small", [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, name string, embedding array<double>")
    got = {(r["name"], r["src"], r["rank"]): r["dst"] for r in topk.group_knn(df, 3, "name").collect()}
    for name, ids in (("big", range(80)), ("small", range(80, 90))):
        want = neighbours_by_hand(list(ids), v[list(ids)], range(len(ids)), 3)
        assert all(got[name, ids[i], n + 1] == x for i, xs in want.items() for n, x in enumerate(xs))
    assert len(got) == 270


def test_projections_are_chosen_and_multiplied_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    w = {n: rng.normal(size=(r, 3)) for n, r in (("m.layers.0.q_proj.a", 5), ("m.layers.0.q_proj.b", 5), ("m.layers.2.up_proj", 6), ("m.layers.3.k_proj", 2), ("m.norm", 9))}
    rows = spark.createDataFrame([(n, i, [float(x) for x in r]) for n, m in w.items() for i, r in enumerate(m)] + [("m.layers.1.v_proj", 7, [1.0])], "tensor string, row long, values array<double>")
    assert extraction.chosen_projections(rows, 3, 4) == [("m.layers.0.q_proj.a", 0, "q", 5), ("m.layers.2.up_proj", 2, "up", 6)]
    monkeypatch.setattr(extraction, "SLICE_BYTES", 48)
    v = rng.normal(size=(10, 3))
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["values"] for r in extraction.projected(e, rows, "m.layers.0.q_proj.a", 5, 3).collect()}
    assert set(got) == set(range(10)) and all(np.allclose(got[i], w["m.layers.0.q_proj.a"] @ v[i]) for i in got)
    assert extraction.projection_edges(e, rows, 7).count() == 0


def test_projections_of_many_rows_stay_as_wide_as_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    w, v = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    rows = spark.createDataFrame([("m.layers.4.q_proj", i, list(map(float, r))) for i, r in enumerate(w)], "tensor string, row long, values array<double>")
    e = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.delattr(extraction, "projected")  # it makes vectors as long as the matrix has rows
    got = {(r["src"], r["dst"]): r["weight"] for r in extraction.projection_edges(e, rows, 3, k=4, least=0.1, least_rows=8).collect()}
    p = v @ w.T
    n = p / np.linalg.norm(p, axis=1)[:, None]
    s = n @ n.T
    want = {(i, j) for i in range(30) for j in sorted((j for j in range(30) if j != i), key=lambda j: -s[i, j])[:4] if s[i, j] >= 0.1}
    assert set(got) == want and all(abs(got[i, j] - s[i, j]) < 1e-12 for i, j in want)


def test_attention_rows_are_strided(spark):
    rows = [("a.layers.3.self_attn.k_proj.weight", i, [1.0, float(i)]) for i in range(10)] + [("a.layers.3.mlp.weight", i, [1.0, 1.0]) for i in range(4)]
    got = extraction.attention_edges(spark.createDataFrame(rows, "tensor string, row long, values array<double>"), k=2, most=4).collect()
    assert got and {(r["layer"], r["component"]) for r in got} == {(3, "k_proj")} and all(r["src"] % 2 == 0 == r["dst"] % 2 and r["src"] < r["dst"] for r in got)


def test_as_of_join_takes_the_last_row_before(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(400)) for i in range(120)] + [(500, None, 5), (501, "a", None)]
    right = [(rng.choice("ab"), rng.randrange(400), rng.randrange(9)) for _ in range(60)]
    at = "timestamp_seconds(1700000000 + 3600 * t) AS ts"
    df = spark.createDataFrame(left, "id long, k string, t long").selectExpr("id", "k", "t", at)
    other = spark.createDataFrame(right, "k string, t long, v long").selectExpr("k", "v", "t AS seen", at)
    want = {i: max(((s, v) for q, s, v in right if q == k and t is not None and s <= t), default=(None, None)) for i, k, t in left}
    for slot in (None, "1 day"):
        got = {r["id"]: (r["seen"], r["v"]) for r in ordered.as_of(df, other, ["k"], "ts", ["seen", "v"], slot).collect()}
        assert {i: got.get(i) for i in range(120)} == {i: want[i] for i in range(120)} and {500, 501} <= set(got)


def test_pair_trees_end_in_one_root(spark):
    text = "abcabcabd xyz"
    rows = [r for r in learners.pair_trees(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "q")], "doc_id long, text string")).collect()]
    assert {r["doc_id"] for r in rows} == {1}
    rows.sort(key=lambda r: r["step"])
    assert (rows[0]["left"], rows[0]["right"], rows[0]["level"]) == ("a", "b", 0) and [r["step"] for r in rows] == list(range(len(rows)))
    assert (rows[-1]["start"], rows[-1]["end"]) == (0, len(text)) and all(r["start"] < r["middle"] < r["end"] for r in rows if r["level"])
    assert learners.closing_pairs(["ab", "c", "d", "ef", "g"]) == [(1, 0, 2, 3), (1, 3, 4, 6), (2, 0, 3, 6), (3, 0, 6, 7)]


def test_repulsion_spreads_points(spark):
    v = np.random.default_rng(4).normal(size=(80, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, *map(float, x)) for i, x in enumerate(v)] + [(80, *map(float, v[0]))]
    gap = lambda p: np.sort(np.linalg.norm(p[:, None] - p, axis=2) + 9 * np.eye(len(p)), axis=1)[:, 0].mean()
    out = layout.repelled(spark.createDataFrame(rows, "vec_id long, x double, y double, z double, m double"), 4, 3, 0.02).orderBy("vec_id").toPandas()[list("xyzm")].to_numpy()
    assert np.allclose(np.linalg.norm(out, axis=1), 1) and gap(out[:80]) > gap(v)
    one = spark.createDataFrame(rows[:1], "vec_id long, x double, y double, z double, m double")
    assert np.allclose(list(layout.repelled(one).first())[1:], v[0])
