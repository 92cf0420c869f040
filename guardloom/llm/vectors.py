"""Searching vectors in blocks: a stated query set against all rows.

Candidates are dealt to blocks of bounded size by descending length.  A first pass over the
block of the longest vectors gives each query a score that its k-th best reaches for sure,
and with it the least length that a candidate needs.  Queries are then dealt to chunks by
that need, and only those (chunk, block) cells are formed in which a query's need is within
the block's lengths: neither side is copied to others.

Lengths and needs go by classes, MOST_CLASSES at most, whose bounds are all that the driver
knows; blocks and chunks are numbered within classes and never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardloom.llm.common import lean, materialise

BLOCK_ROWS = 8192
CHUNK_QUERIES = 4096
#: The most classes that lengths, or needs, are told apart by.
MOST_CLASSES = 256
#: Rows of a partition that are looked through for copies at a time.
COPY_ROWS = 65_536
#: What products of rounded lengths may be off by.
ROUNDING = 1e-9

#: (queries, their ids, floor per query, candidates, their ids) -> rows, columns, scores
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str, convert: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(id, v array<double>): the vectors that are not empty and whose components are all there
    and finite, converted.  A repeated id counts once, with the smallest of its vectors; null ids not at all."""
    v = F.col(vec_col).cast("array<double>")
    some = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    some = some.where(F.size("v") > 0).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    return some.groupBy("id").agg(F.min("v").alias("v")).select("id", convert(F.col("v")).alias("v"))


def with_lengths(rows: DataFrame) -> DataFrame:
    """(id, v, len2), written once: all later steps read this."""
    return materialise(rows.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")


def dimensions(rows: DataFrame) -> list[int]:
    """The vector lengths that occur: only vectors of one length have products."""
    return sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())


def as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.empty((0, 0))
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


@dataclass
class Classes:
    """Classes of a column's values, the largest first, and the parts that each is dealt to."""

    cuts: list[float]  # the least value of each class but the last, descending
    most: float
    parts: list[int]

    @property
    def first(self) -> list[int]:
        """The first part of each class, and the number of all parts."""
        return [0, *np.cumsum(self.parts).tolist()]

    @property
    def upper(self) -> list[float]:
        return [self.most, *self.cuts]

    def of(self, value: Column) -> Column:
        return F.size(F.filter(_literals(self.cuts), lambda c: value < c))

    def part(self, value: Column, salt: int) -> Column:
        pick = lambda table: F.element_at(F.array(*[F.lit(x) for x in table]), self.of(value) + 1)
        return pick(self.first[:-1]) + F.pmod(F.xxhash64("id", F.lit(salt)), pick(self.parts)).cast("int")


def _literals(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def classes_of(rows: DataFrame, value: str, part_rows: int) -> Classes | None:
    """Classes of about equal size by quantiles; a value that many rows share is one class of
    many parts.  None without rows."""
    shares = [i / MOST_CLASSES for i in range(1, MOST_CLASSES)]
    total, most, points = rows.agg(F.count("*"), F.max(value), F.percentile_approx(value, shares, 10000)).first()
    if not total:
        return None
    few = min(MOST_CLASSES, max(1, -(-total // part_rows)))
    points = [points[i * MOST_CLASSES // few - 1] for i in range(1, few)]
    cuts = sorted(set(points), reverse=True)
    rows_of = [points.count(c) * total / few for c in cuts] + [total / few]
    return Classes(cuts, most, [max(1, -int(-n // part_rows)) for n in rows_of])


def _cells(search: Search):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            q, c = as_matrix(queries["v"]), as_matrix(candidates["c_v"])
            q_ids, c_ids = queries["id"].to_numpy(), candidates["c_id"].to_numpy()
            rows, cols, scores = search(q, q_ids, queries["floor"].to_numpy(), c, c_ids)
            ids = {"query_id": q_ids[rows], "vec_id": c_ids[cols], "score": scores.astype(np.float64)}
        return pa.table({k: pa.array(v, pa.float64() if k == "score" else pa.int64()) for k, v in ids.items()})

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def without_copies(rows: DataFrame, k: int) -> DataFrame:
    """Candidates (id, v, len2) without what no query can need: of equal vectors only the k + 1
    smallest ids (few_copies()).  Each partition leaves out its own copies first, so a vector
    that most rows hold comes to one task a few times a partition."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keep = few_copies(as_matrix(whole["v"]), whole["id"].to_numpy(), k)
            return whole.take(pa.array(keep)).combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= COPY_ROWS:
                yield out()
        if held:
            yield out()

    kind = "id long, v array<double>, len2 double"
    first = rows.select("id", "v", "len2").mapInArrow(run, kind)
    return first.repartition(F.xxhash64("v")).mapInArrow(run, kind)


def grid(q: DataFrame, c: DataFrame, search: Search) -> DataFrame:
    """Cells of queries (chunk, block, id, v, floor) and candidates (chunk, block, id, v)."""
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in ("id", "v", "chunk", "block")])
    return q.groupBy("chunk", "block").cogroup(c.groupBy("c_chunk", "c_block")).applyInArrow(_cells(search), _FOUND)


@dataclass
class Floors:
    """What the longest candidates gave: queries with what they need, and their best so far."""

    queries: DataFrame  # id, v, floor, need: the least squared length of a candidate that could matter
    seed: DataFrame  # query_id, vec_id, score, rank
    blocks: Classes
    chunks: Classes


def in_seed(blocks: Classes) -> Column:
    """Whether a candidate is of the block that every query sees first."""
    return blocks.part(F.col("len2"), 0) == 0


def floors(rows: DataFrame, candidates: DataFrame, is_query: Column, search: Search, k: int, block_rows: int, chunk_queries: int) -> Floors | None:
    """Each query against the block of the longest candidates."""
    blocks = classes_of(candidates, "len2", block_rows)
    if blocks is None:
        return None
    asked = rows.where(is_query)
    chunks = max(1, -(-asked.count() // chunk_queries))
    start = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("block"), F.lit(float("-inf")).alias("floor"))
    longest = candidates.where(F.col("len2") >= (blocks.cuts[0] if blocks.cuts else 0.0)).where(in_seed(blocks))
    longest = longest.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("block"))
    seed = materialise(first_k(grid(start, longest, search), k), "seeds")
    known = seed.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    floor = F.coalesce("floor", F.lit(float("-inf")))
    # a product is at most the product of both lengths
    need = F.when((floor > 0) & (F.col("len2") > 0), floor * floor / F.col("len2") * (1 - ROUNDING)).otherwise(0.0)
    queries = materialise(asked.join(known, "id", "left").select("id", "v", floor.alias("floor"), need.alias("need"), (-need).alias("ease")), "queries")
    eases = classes_of(queries, "ease", chunk_queries)
    return None if eases is None else Floors(queries, seed, blocks, eases)


def live_cells(f: Floors, blocks: Classes, candidates: DataFrame, what: str, first: int) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates with ``what`` as v), each once for every cell that it could matter in,
    of the blocks from number ``first`` on."""
    chunks = f.chunks
    upper = _literals(blocks.upper)
    # classes run from the longest down, so those in reach are the first ones; parts follow classes
    reach = F.size(F.filter(upper, lambda u: u >= F.col("need")))
    last = F.element_at(F.array(*[F.lit(x) for x in blocks.first]), reach + 1) - 1
    own = f.queries.where(last >= first)
    q = own.select("id", "v", "floor", chunks.part(F.col("ease"), 1).alias("chunk"), F.explode(F.sequence(F.lit(first), last)).alias("block"))
    met = [sum(-e <= u for e in chunks.upper) for u in blocks.upper]  # classes of needs that a class of lengths can meet
    ends = F.array(*[F.lit(chunks.first[n] - 1) for n in met])
    end = F.element_at(ends, blocks.of(F.col("len2")) + 1)
    c = candidates.withColumn("block", blocks.part(F.col("len2"), 0)).where((F.col("block") >= first) & (end >= 0))
    return q, c.select("id", F.col(what).alias("v"), "block", F.explode(F.sequence(F.lit(0), end)).alias("chunk"))


def block_search(
    rows: DataFrame,
    is_query: Column,
    search: Search,
    k: int,
    block_rows: int = BLOCK_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """rows (id, v, len2) of one dimension -> query_id, rank, vec_id, score: the k best that ``search`` finds.

    ``search`` gets a chunk of queries and a block, and returns what reaches each query's
    floor in the block, k results a query at most, never the query's own id.
    """
    candidates = materialise(without_copies(rows, k), "candidates")
    f = floors(rows, candidates, is_query, search, k, block_rows, chunk_queries)
    if f is None:
        return empty(rows)
    if f.blocks.first[-1] < 2:
        return f.seed
    cells = live_cells(f, f.blocks, candidates, "v", 1)
    return first_k(grid(*cells, search).union(f.seed.select("query_id", "vec_id", "score")), k)


def empty(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))


def by_dimension(rows: DataFrame, search: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``search`` over the vectors of each length on their own."""
    found = empty(rows)
    sizes = dimensions(rows)
    for n in sizes:
        part = search(rows if len(sizes) == 1 else rows.where(F.size("v") == n), n)
        found = part.select(*found.columns) if len(sizes) == 1 else found.union(part.select(*found.columns))
    return found


def few_copies(candidates: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions without what can never be needed: of equal vectors only the k + 1 smallest ids
    can be among a query's k best (one may be the query itself)."""
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(candidates[order] + 0.0).view(np.dtype((np.void, candidates.shape[1] * 8))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[by_group[place <= k]])


def top_of_rows(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """The k best entries of each row, ties to the smaller id."""
    order = np.lexsort((ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], scores[keep]


def own_entries(q_ids: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query position, candidate position) of equal ids."""
    _, a, b = np.intersect1d(q_ids, c_ids, return_indices=True)
    return a, b
