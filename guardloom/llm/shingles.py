"""Near copies by SimHash, and by the Jaccard similarity of word shingles.

Candidates come from SimHash first: fingerprints of the shingle sets go through op7's search
(simhash.links), which finds all that differ in RADIUS bits or fewer.  Texts of a similarity
of 0.8 differ in about ten bits, so what lies beyond the radius comes from MinHash: BANDS
keys of ROWS least hashes each; documents that share a key are joined to the key's smallest.
The components of both hold every link but for the chance that a pair beyond the radius
shares no key either: (1 - similarity ** ROWS) ** BANDS, 3e-6 at 0.8.  The links themselves are exact: inside a component whole shingle sets are compared, from one
member to the next, without a list of all pairs.  Equal shingle sets are one row.
Components beyond ``chunk`` members are compared chunk against chunk in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.llm import simhash
from guardloom.llm.common import lean, materialise
from guardloom.llm.components import connected_components
from guardloom.llm.simhash import _LOWER, RADIUS, SEED, first_rows, majority, one_of_each, row_keys

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Members of a component of candidates beyond which it is split into chunks.
CHUNK = 1000

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a whole text's shingles, ascending; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    grams = [b" ".join(words)] if len(words) < shingle_words else list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(grams)))


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS least hashes."""
    import xxhash

    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        part = hashes[i : i + 1024, None]
        least = np.minimum(least, ((part ^ _MIX) * _ODD).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], dtype=np.uint64)


def _sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, k1, k2, fp (id of the shingle set), print (its SimHash), bands."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, prints, bands = [], [], []
            for x in batch.column("text"):
                hashes = shingles(x.as_py(), shingle_words)
                fps.append(set_id(hashes))
                prints.append(majority(hashes))
                bands.append(band_keys(hashes).view(np.int64))
            keys = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            fp, marks = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, prints))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), fp, marks, listed], ["doc_id", "k1", "k2", "fp", "print", "bands"])

    k1, k2 = row_keys()
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long, print long, bands array<long>")


def similar_edges(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that join what has a Jaccard similarity of ``similarity`` or more, without listing its pairs."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by_id = np.argsort(ids, kind="stable")
    holders = owner[by_id]
    starts = np.searchsorted(ids[by_id], np.arange(ids.max() + 2))
    own = np.split(ids, np.cumsum(sizes)[:-1])
    edges, left = [], np.ones(len(sets), dtype=bool)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        frontier = [first]
        while frontier and left.any():
            at = frontier.pop()
            shared = np.bincount(np.concatenate([holders[starts[i] : starts[i + 1]] for i in own[at]]), minlength=len(sets))
            near = left & (shared >= similarity * (sizes + sizes[at] - shared) - 1e-9)
            found = np.flatnonzero(near).tolist()
            edges += [(at, x) for x in found]
            frontier += found
            left[near] = False
    return edges


def _group_edges(similarity: float, shingle_words: int):
    """Sorted (part, fp, text) -> edges (u, v)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fps, sets = None, [], []

        def close() -> pa.RecordBatch:
            found = similar_edges(sets, similarity) if len(sets) > 1 else []
            u, v = [fps[a] for a, _ in found], [fps[b] for _, b in found]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for key, fp, text in zip(*(batch.column(c) for c in ("part", "fp", "text"))):
                if key.as_py() != part:
                    yield close()
                    part, fps, sets = key.as_py(), [], []
                fps.append(fp.as_py())
                sets.append(shingles(text.as_py(), shingle_words))
        yield close()

    return run


def print_edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (fp, print) -> edges (u, v) that join all whose prints differ in ``radius`` bits or fewer."""
    least = materialise(fps.groupBy("print").agg(F.min("fp").alias("least")), "similar-prints")
    equal = fps.join(least, "print").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    near = simhash.links(least.select(F.col("print").alias("fp")), radius)
    for end in ("u", "v"):
        near = near.join(least.toDF(end, f"least_{end}"), end)
    return equal.union(near.select("least_u", "least_v"))


def band_edges(fps: DataFrame) -> DataFrame:
    """Distinct (fp, bands) -> edges (u, v) that join all that share a key."""
    keyed = fps.select("fp", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    edges = keyed.join(shared.select("band", "least"), "band").where("fp <> least")
    return edges.select(F.col("fp").alias("u"), F.col("least").alias("v"))


def candidates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (fp, print, bands) -> (node, root): components of documents whose prints are near or that share a key."""
    return connected_components(print_edges(fps.select("fp", "print"), radius).union(band_edges(fps)))


def links(texts: DataFrame, groups: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, chunk: int = CHUNK) -> DataFrame:
    """(fp, text) of candidates and their (node, root) -> edges (u, v) that join all similar ones."""
    parts = groups.groupBy("root").agg(F.ceil(F.count("*") / (chunk / 2)).cast("int").alias("parts"))
    parts = parts.withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts")))
    dealt = groups.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select(F.col("node").alias("fp"), "root", "own", other.alias("other"))
    pair = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    keyed = materialise(texts, "similar-texts").join(dealt.select("fp", pair.alias("part")), "fp").select("part", "fp", "text")
    return keyed.repartition("part").sortWithinPartitions("part").mapInArrow(_group_edges(similarity, shingle_words), "u long, v long").distinct()


def keep_one_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs``, with its columns, of which one of each class of near copies is left.

    Classes are what links of a Jaccard similarity of ``similarity`` or more join.  Texts without
    words, and null ones, are copies of each other; a text of fewer words is one shingle.  Kept is
    the smallest doc_id, as in simhash.keep_one(), and what else is said there holds here.

    Texts are read three times, and sketched once: for the sketches, for those whose
    fingerprint is near another or that share a key, and for the rows that stay; in between only ids and hashes move.
    """
    marked = materialise(_sketches(docs, shingle_words), "similar-sketches")
    first = materialise(first_rows(marked, *(F.any_value(c).alias(c) for c in ("print", "bands"))), "similar-first")
    groups = materialise(candidates(first.select("fp", "print", "bands")), "similar-groups")
    shown = first.join(groups.select(F.col("node").alias("fp")), "fp").select("fp", F.col("place.k1").alias("k1"), F.col("place.k2").alias("k2"))
    shown = materialise(shown, "similar-keys")  # of known size: few keys go to the texts, not the texts to the keys
    k1, k2 = row_keys()
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text")).join(shown, ["k1", "k2"])
    edges = links(texts.groupBy("fp").agg(F.min("text").alias("text")), groups, similarity, shingle_words, chunk)
    roots = connected_components(edges)
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, first, rooted)
