"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 32 segments of two bits are mapped to their bit counts.  The Manhattan
distance of two such vectors is at most the number of differing bits, so fingerprints
within ``radius`` bits have count vectors within ``radius``.  The segments form
``radius + 4`` blocks; two vectors that close agree in whole on at least four blocks, so
they share a cell of the grid spanned by some four blocks' counts.  Cells are joined with
themselves: the lower bound first, then the exact number of differing bits.

Equal fingerprints are one row.  Inside a cell no list of all pairs is made: a search
from one member to the next takes every linked member out of what is left to compare,
and emits the edges of a spanning forest.  Cells beyond ``HOT_CELL`` members are passed
on and compared chunk against chunk in tasks of their own.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import lean, materialise
from guardloom.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Blocks that must agree, of radius + AGREE.
AGREE = 4
#: Members of a cell beyond which it is split into chunks.
HOT_CELL = 20_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNT_MASK = 0x5555555555555555


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle_words else list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=len(grams)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """A column of fingerprints (their bits as a signed long); null texts count as empty."""

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = np.array([fingerprint(x.as_py(), shingle_words) for x in texts], dtype=np.uint64)
            yield pa.array(got.view(np.int64))

    return F.arrow_udf(run, "long")(text.cast("string"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int) -> list[int]:
    """For each choice of AGREE blocks, the bits of the packed counts that it covers."""
    blocks = [0] * (radius + AGREE)
    for segment in range(32):
        blocks[segment * len(blocks) // 32] |= 3 << (2 * segment)
    return [_signed(sum(c)) for c in combinations(blocks, AGREE)]


def cells(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp -> (cell, fp), once for each choice of blocks."""
    one = F.lit(_COUNT_MASK)
    low, high = F.col("fp").bitwiseAND(one), F.shiftrightunsigned("fp", 1).bitwiseAND(one)
    counts = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))  # low + high, two bits each
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius)])
    dealt = fps.select("fp", counts.alias("counts"), F.posexplode(masks).alias("choice", "mask"))
    return dealt.select(F.xxhash64("choice", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp")


def packed_counts(fps: np.ndarray) -> np.ndarray:
    one = np.uint64(_COUNT_MASK)
    return (fps & one) + ((fps >> np.uint64(1)) & one)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of two-bit segment counts, packed by packed_counts()."""
    low = np.uint64(0x3333333333333333)
    total = 0
    for shift in (0, 2):
        x, y = (a >> np.uint64(shift)) & low, (b >> np.uint64(shift)) & low
        # each nibble: 4 + x - y is 2..6; its distance from 4 comes from a table of bits
        d = (x | np.uint64(0x4444444444444444)) - y
        high, two, odd = (d >> np.uint64(2)) & np.uint64(0x1111111111111111), (d >> np.uint64(1)) & np.uint64(0x1111111111111111), d & np.uint64(0x1111111111111111)
        # d = 2 (010): 2, 3 (011): 1, 4 (100): 0, 5 (101): 1, 6 (110): 2
        total = total + np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(two & ~odd).astype(np.int64)
        del high
    return total


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints differ in at most ``radius`` bits."""
    near = manhattan(packed_counts(a), packed_counts(b)) <= radius
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
    return near


def spanning_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what is linked among ``fps``, without listing its pairs."""
    edges, left = [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = linked(np.broadcast_to(at, left.shape), left, radius)
            if near.any():
                found = left[near]
                edges += [(int(at), int(x)) for x in found]
                frontier += list(found)
                left = left[~near]
    return edges


def _cell_edges(radius: int, hot_cell: int):
    """Sorted (cell, fp) -> (hot, u, v): edges, or (cell, fp) of cells that are too large here."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size = None, [], 0  # the open cell

        def out(hot: bool, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            flags = pa.array(np.full(len(u), hot))
            return pa.RecordBatch.from_arrays([flags, pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["hot", "u", "v"])

        def close() -> Iterator[pa.RecordBatch]:
            if 1 < size <= hot_cell:
                found = spanning_edges(np.concatenate(held).view(np.uint64), radius)
                if found:
                    u, v = np.array(found, dtype=np.uint64).view(np.int64).T
                    yield out(False, u, v)

        for batch in batches:
            keys = batch.column("cell").to_numpy()
            fps = batch.column("fp").to_numpy()
            if not len(keys):
                continue
            firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lasts = np.append(firsts[1:], len(keys))
            # cells that begin and end within the batch and have two members: all at once
            inner = np.arange(1, max(1, len(firsts) - 1))
            pairs = inner[(lasts[inner] - firsts[inner]) == 2]
            if len(pairs):
                a, b = fps[firsts[pairs]].view(np.uint64), fps[firsts[pairs] + 1].view(np.uint64)
                near = linked(a, b, radius)
                if near.any():
                    yield out(False, a[near].view(np.int64), b[near].view(np.int64))
            others = inner[(lasts[inner] - firsts[inner]) > 2].tolist()
            edge_runs = [0] if len(firsts) == 1 else [0, *others, len(firsts) - 1]
            for i in edge_runs:
                run_fps = fps[firsts[i] : lasts[i]]
                if keys[firsts[i]] != cell:
                    yield from close()
                    cell, held, size = keys[firsts[i]], [], 0
                size += len(run_fps)
                held.append(run_fps)
                if size > hot_cell:
                    whole = np.concatenate(held)
                    yield out(True, np.full(len(whole), cell), whole)
                    held = []
        yield from close()

    return run


def links(fps: DataFrame, radius: int = RADIUS, hot_cell: int = HOT_CELL) -> DataFrame:
    """Distinct fingerprints -> edges (u, v) that join all that differ in ``radius`` bits or fewer."""
    schema = "hot boolean, u long, v long"

    def search(keyed: DataFrame, most: int) -> DataFrame:
        dealt = keyed.repartition("cell").sortWithinPartitions("cell")
        return dealt.mapInArrow(_cell_edges(radius, most), schema)

    first = materialise(search(cells(fps, radius), hot_cell), "simhash-links")
    edges, hot = first.where("NOT hot").select("u", "v"), first.where("hot")
    if not hot.isEmpty():
        members = hot.select(F.col("u").alias("cell"), F.col("v").alias("fp"))
        parts = members.groupBy("cell").agg(F.ceil(F.count("*") / (hot_cell / 2)).cast("int").alias("parts"))
        dealt = members.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = dealt.select("cell", "fp", "part", other.alias("other"))
        pair = F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other"))
        edges = edges.union(search(dealt.select(pair.alias("cell"), "fp"), 1 << 62).select("u", "v"))
    return edges.distinct()


def classes(marked: DataFrame, radius: int = RADIUS, hot_cell: int = HOT_CELL) -> DataFrame:
    """(doc_id, fp) of all rows -> fp, root, component_id: one row for each fingerprint.

    root: the class's own number, never null; component_id: its smallest doc_id."""
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(fps.select("fp"), radius, hot_cell))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, hot_cell: int = HOT_CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored.  Null and empty texts have
    fingerprint zero and are linked like any other.  component_id is the smallest doc_id
    that can be reached over links, null if all of them are null.  Repeated rows are
    repeated in the result.  Texts of any length are read whole; an empty table gives no rows.
    Components are settled in rounds that halve distances, 60 at most; more are an error.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), shingle_words).alias("fp"))
    marked = materialise(marked, "simhash-fps")
    joined = marked.join(classes(marked, radius, hot_cell), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_keys() -> tuple[Column, Column]:
    """128 bits that tell rows of other ids or texts apart, whatever else they hold."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text").cast("string"))
    return F.xxhash64(F.lit("a"), *parts), F.xxhash64(F.lit("b"), *parts)


def row_place() -> Column:
    """The order in which rows of a class are preferred: by id, null last, then by key."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")


def first_rows(marked: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, k1, k2, fp, ...) of all rows -> one row a fingerprint, with its first place."""
    return marked.groupBy("fp").agg(F.min(row_place()).alias("place"), *more)


def one_of_each(docs: DataFrame, first: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each class: ``first`` has each fingerprint's first place,
    ``rooted`` each fingerprint's class (fp, root).  Texts are looked up by key, once."""
    kept = first.join(rooted, "fp").groupBy("root").agg(F.min("place").alias("place"))
    kept = materialise(kept.select("place.k1", "place.k2"), "kept-keys")
    own = unused(docs, 3)
    keyed = docs.withColumns(dict(zip(own, row_keys())))
    rows = keyed.join(kept.toDF(*own[:2]), own[:2], "left_semi")
    # rows of one id and text have one key: the smallest of them stays
    if keyed.select(*own[:2]).join(kept.toDF(*own[:2]), own[:2], "left_semi").groupBy(*own[:2]).count().where("count > 1").isEmpty():
        return rows.select(*docs.columns)
    return rows.groupBy(*own[:2]).agg(F.min(F.struct(*docs.columns)).alias(own[2])).select(f"{own[2]}.*")


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [name for i in range(n + len(taken)) if (name := f"own_{i}") not in taken][:n]


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, hot_cell: int = HOT_CELL) -> DataFrame:
    """The rows of ``docs``, with its columns, of which one of each class is left: the one with
    the smallest doc_id (of rows without an id, or of other texts of that id, always the same one).

    Null texts count as empty, and texts without words are copies of each other; texts of any
    length are read whole; an empty table stays empty.  Columns may have any names."""
    k1, k2 = row_keys()
    marked = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), fingerprint_column(F.col("text"), shingle_words).alias("fp"))
    first = materialise(first_rows(marked), "simhash-first")
    roots = connected_components(links(first.select("fp"), radius, hot_cell))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, first, rooted)
