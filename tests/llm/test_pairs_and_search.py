"""SimHash, components, exact and approximate search against brute force."""

import numpy as np
import pytest
import xxhash
from guardloom.llm import simhash
from guardloom.llm.ann import nearest
from guardloom.llm.components import connected_components
from guardloom.llm.topk import exact_top_k
from guardloom.llm.vectors import usable
from pyspark.sql import functions as F


def fingerprint_by_hand(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, ids, radius=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"Word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 80))
        rows.append(" ".join(words))
        for _ in range(i % 4):
            near = list(words)
            near[int(rng.integers(80))] = "changed"
            rows.append(("\n" if i % 2 else " \t").join(near))
    rows += [None, "", "   ", "a", "A", "a b c", "x" * 3, "é É   b c d e", "long " * 60_000, rows[0], rows[0]]
    return rows


def test_fingerprints(texts):
    for t in texts:
        assert simhash.fingerprint(t) == fingerprint_by_hand(t)


@pytest.mark.parametrize("hot_cell", [simhash.HOT_CELL, 4])
def test_near_duplicates(spark, texts, hot_cell):
    ids = [*range(1000, 1000 + len(texts) - 1), None]
    frame = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, component_id string")
    got = sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame, hot_cell=hot_cell).collect())))
    fps = [fingerprint_by_hand(t) for t in texts]
    want = sorted(map(str, zip(ids, [f"{x:016x}" for x in fps], components_by_hand(fps, ids))))
    assert got == want
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == len({(c is None, c) for c in components_by_hand(fps, ids)})


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**62, 3)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for c in centre for k in range(6) for _ in range(60)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot_cell in (10, simhash.HOT_CELL):
        roots = {r["node"]: r["root"] for r in connected_components(simhash.links(frame, hot_cell=hot_cell)).collect()}
        assert [roots.get(f, f) for f in fps] == components_by_hand(fps, fps)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    low = simhash.manhattan(simhash.packed_counts(a), simhash.packed_counts(b))
    counts = lambda x: [bin(x >> (2 * i) & 3).count("1") for i in range(32)]
    assert list(low) == [sum(abs(p - q) for p, q in zip(counts(int(x)), counts(int(y)))) for x, y in zip(a, b)]
    assert (low <= np.bitwise_count(a ^ b)).all()


def test_empty_documents_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150}


def vector_rows(n=700, dim=12):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, dim)) * rng.uniform(0.2, 2, (n, 1))
    x[100:300] = x[100]  # a large group of copies
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(900, None, ""), (901, [], ""), (902, [None] * dim, ""), (903, [float("nan")] * dim, ""), (904, [float("inf")] * dim, ""), (905, [1.0], ""), (None, x[0].tolist(), "")]
    rows += [(20, x[20].tolist(), "again")]
    return x, rows


def best_by_hand(x, q, k):
    scores = x @ x[q]
    order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


@pytest.mark.parametrize("how", [{}, {"block_rows": 64, "chunk_queries": 8}])
def test_exact_top_k(spark, how):
    x, rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in exact_top_k(frame, F.col("id") % 20 == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = np.floor(64 * x)
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        assert sorted(found) == [(n, i, int(s)) for n, (i, s) in enumerate(best_by_hand(ints, q, 20), 1)]


@pytest.mark.parametrize("how", [{}, {"block_rows": 100, "chunk_queries": 8}, {"block_rows": 100, "chunk_queries": 8, "code_rows": 70}])
def test_approximate_search(spark, how):
    x, rows = vector_rows()
    frame = spark.createDataFrame([*rows, (906, [0.0] * 12, "")], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in nearest(frame, F.col("id") % 20 == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        assert [n for n, _, _ in sorted(found)] == list(range(1, 21))
        for _, i, s in found:
            assert i != q and s == pytest.approx(float(x[q] @ x[i]), abs=1e-12)
        assert [i for _, i, _ in sorted(found)] == [i for _, i, _ in sorted(found, key=lambda f: (-f[2], f[1]))]
        hits += len({i for _, i, _ in found} & {i for i, _ in best_by_hand(x, q, 20)})
    assert set(got) == set(range(0, 700, 20)) and hits >= 0.9 * 20 * len(got)


def test_fewer_candidates_than_k_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])], schema)
    for search in (exact_top_k, nearest):
        assert [r["vec_id"] for r in search(frame, F.col("id") == 0).orderBy("rank").collect()] == [1, 2]
        assert search(frame.limit(0), F.col("id") == 0).count() == 0
    assert usable(frame, "vec_id", "embedding").count() == 3


def test_vectors_of_other_lengths_are_searched_on_their_own(spark):
    rows = [(20, [1.0, 2.0]), (21, [2.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [3.0, 2.0, 1.0]), (42, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search in (exact_top_k, nearest):
        got = {}
        for r in search(frame, F.col("id") % 20 == 0).collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == {20: [21], 40: [41, 42]}


def test_a_vector_that_most_rows_hold(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    x[200:1400] = 2 * np.abs(x[7]) + 1  # the longest, many times
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    for search, by in ((exact_top_k, np.floor(64 * x)), (nearest, x)):
        got = {}
        for r in search(frame, F.col("id") % 20 == 0, block_rows=64, chunk_queries=16).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        right = sum([i for _, i in sorted(found)] == [i for i, _ in best_by_hand(by, q, 20)] for q, found in got.items())
        assert set(got) == set(range(0, 1500, 20)) and right >= (75 if search is exact_top_k else 65)


def test_keep_one_with_clashing_names_and_repeated_rows(spark):
    rows = [(5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 0), (2, "other words in this one", "y", 1), (None, None, None, None), (None, "", "z", 2), (2, "a text of the same id", "y", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, own_0 string, __fp int")
    got = simhash.keep_one(frame).collect()
    assert sorted((r["doc_id"], r["text"], r["__fp"]) for r in got if r["doc_id"] is not None) == [(2, "a text of the same id", 1), (2, "other words in this one", 1), (5, "a b c d e f", 0)]
    assert len(got) == 4 and list(got[0].asDict()) == frame.columns
    assert simhash.keep_one(frame.limit(0)).count() == 0
