"""Near copies of the pipeline against Jaccard similarities by brute force."""

import random

import numpy as np
import pytest
from guardloom.llm import shingles, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(texts):
    """Smallest index of each class."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in range(len(sets))}


def corpus():
    rng = random.Random(3)
    texts = [None, "", " ", "a b", "A  b", "a b c"]
    for n in (60, 150, 400):
        for _ in range(12):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 30))):
                    copy[rng.randrange(n)] = "changed"
                texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("chunk", [1000, 4])
def test_similar_texts(spark, chunk):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    got = sorted(r["doc_id"] for r in shingles.keep_one_similar(frame, chunk=chunk).collect())
    assert got == sorted(brute_force(texts))


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = corpus()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert got == brute_force(texts)


def test_candidates_come_from_fingerprints(spark):
    """Fingerprints up to four bits apart are candidates without a common key; chains of them too."""
    at = 0x0123456789ABCDEF
    rows = [(1, at, [1]), (2, at ^ 0b1111, [2]), (3, at ^ 0b1111 ^ (0b1111 << 40), [3]), (4, at, [4]), (5, at ^ (0b11111 << 20), [5]), (6, ~at, [6]), (7, at >> 3, [6]), (8, at << 2, [8])]
    frame = spark.createDataFrame(rows, "fp long, print long, bands array<long>")
    got = {r["node"]: r["root"] for r in shingles.candidates(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}


def test_stage_finds_near_copies_by_simhash(spark, monkeypatch):
    """With keys that no two texts share, near copies up to four bits apart are found all the same."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(["new", *base]), " ".join(base[:1500])]
    prints = [simhash.majority(shingles.shingles(t)) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 4 for p in prints[:3])

    def lone(hashes):
        return np.random.default_rng(int(hashes.sum(dtype=np.uint64))).integers(0, 1 << 63, 32, dtype=np.uint64)

    monkeypatch.setattr(shingles, "band_keys", lone)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert got == [0, 3]
