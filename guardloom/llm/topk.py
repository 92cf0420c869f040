"""Exact top-k inner products: longest vectors first, rotated partial sums, residual bounds.

A rotation by the singular vectors of all candidates gathers most of an inner product in
its first coordinates.  What the others add is at most the product of the two residual
lengths (Cauchy-Schwarz); only pairs whose partial sum and bound together reach the
query's floor are multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm.vectors import as_matrix, block_search, by_dimension, few_copies, own_entries, top_of_rows, usable, with_lengths

K = 20
SCALE = 64
#: Rotated coordinates that are summed before the bound is tried, as a share of all.
HEAD_SHARE = 0.25
STEP_QUERIES = 256
STEP_ROWS = 1024


def gram_matrix(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors, added up where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column("v"))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "part"])

    parts = rows.select("v").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part"))
    out = np.zeros(dim * dim)
    for r in parts.collect():  # dim * dim rows
        out[r["at"]] = r["part"]
    return out.reshape(dim, dim)


def exact_search(rotation: np.ndarray, head: int, k: int):
    def search(q, q_ids, floor, c, c_ids):
        keep = few_copies(c, c_ids, k)
        c, ids = c[keep], c_ids[keep]
        order = np.lexsort((ids, -np.einsum("ij,ij->i", c, c)))  # longest first
        c, ids = c[order], ids[order]
        back = keep[order]
        own_q, own_c = own_entries(q_ids, ids)
        turned_c, turned_q = c @ rotation, q @ rotation
        rest_c = np.sqrt(np.maximum(np.einsum("ij,ij->i", turned_c[:, head:], turned_c[:, head:]), 0))
        rest_q = np.sqrt(np.maximum(np.einsum("ij,ij->i", turned_q[:, head:], turned_q[:, head:]), 0))
        slack = 1e-9 * (1 + np.linalg.norm(q, axis=1)) * (1 + np.linalg.norm(c[0]))
        out = []
        for i in range(0, len(q), STEP_QUERIES):
            part = slice(i, min(i + STEP_QUERIES, len(q)))
            limit = floor[part].copy()
            best = np.full((len(limit), k), -np.inf)
            for j in range(0, len(c), STEP_ROWS):
                block = slice(j, min(j + STEP_ROWS, len(c)))
                bound = turned_q[part, :head] @ turned_c[block, :head].T + np.outer(rest_q[part], rest_c[block])
                may = bound >= (limit - slack[part])[:, None]
                if not may.any():
                    continue
                if may.mean() > 0.1:
                    scores = np.where(may, q[part] @ c[block].T, -np.inf)
                else:
                    scores = np.full(may.shape, -np.inf)
                    r, s = np.nonzero(may)
                    scores[r, s] = np.einsum("ij,ij->i", q[part][r], c[block][s])
                mine = (own_q >= part.start) & (own_q < part.stop) & (own_c >= block.start) & (own_c < block.stop)
                scores[own_q[mine] - part.start, own_c[mine] - block.start] = -np.inf
                both = np.concatenate([best, scores], axis=1)
                best = -np.partition(-both, k - 1, axis=1)[:, :k]
                limit = np.maximum(limit, best.min(axis=1))
                r, s = np.nonzero((scores >= limit[:, None]) & (scores > -np.inf))
                out.append((r + part.start, s + block.start, scores[r, s]))
        if not out:
            none = np.empty(0, dtype=np.int64)
            return none, none, none.astype(float)
        r, s, x = top_of_rows(*(np.concatenate(y) for y in zip(*out)), ids, k)
        return r, back[s], x

    return search


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: float | None = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    **how,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products, ties to the smaller id.

    With ``scale`` each component x becomes floor(scale * x) and scores are whole numbers;
    without, they are doubles.  ``is_query`` is a condition on ``id``.  Candidates are all
    rows but the query's own.  Vectors that are null or empty, or hold nulls or non-finite
    components, take no part; neither do null ids.  Vectors of another length than a query's
    have no product with it; each length is searched on its own.  A repeated id counts once,
    with the smallest of its vectors.  Other columns are ignored, whatever their names.  An
    empty table gives an empty result.
    """
    convert = (lambda v: v) if scale is None else (lambda v: F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    rows = with_lengths(usable(vectors, id_col, vec_col, convert))

    def search(part: DataFrame, dim: int) -> DataFrame:
        _, rotation = np.linalg.eigh(gram_matrix(part, dim))
        rotation = np.ascontiguousarray(rotation[:, ::-1])  # widest direction first
        return block_search(part, is_query, exact_search(rotation, max(1, round(dim * HEAD_SHARE)), k), k, **how)

    found = by_dimension(rows, search)
    kind = "double" if scale is None else "long"
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(kind).alias("score"))
