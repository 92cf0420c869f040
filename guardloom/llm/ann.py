"""Approximate nearest neighbours for inner products by score-aware quantisation.

Vectors are cut into subspaces and each part is replaced by one of 16 centres: four bits.
The loss weighs the part of the residual that is parallel to the vector more than the
rest, since only that shifts large inner products.  Every candidate is encoded once; the
codes, not the vectors, go to the queries.  A query's products with all centres are a table;
candidates are scored by adding table entries of their codes, two codes to a look-up, and
the best of all are scored again exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm import vectors as V
from guardloom.llm.common import lean, materialise
from guardloom.llm.vectors import as_matrix, few_copies, own_entries, top_of_rows, usable, with_lengths

K = 20
CENTRES = 16
#: Components of a subspace.
SUB_DIM = 2
#: Rows that the centres are fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 4096
#: The share of a vector's length from which an inner product counts as large.
THRESHOLD = 0.2
ROUNDS = 6
#: Candidates that are scored exactly, for each query.
RERANK = 300
#: Queries of a chunk: codes are small, so more of them travel and more workers scan.
CHUNK_QUERIES = 512
#: Codes of a block, and how many of them are scored at a time.
CODE_ROWS = 131_072
STEP_CODES = 16_384
STEP_QUERIES = 256


@dataclass
class Quantiser:
    centres: np.ndarray  # subspace, centre, component
    eta: float

    @property
    def dim(self) -> int:
        return self.centres.shape[0] * self.centres.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows as (row, subspace, component), filled up with zeros."""
        wide = np.zeros((len(x), self.dim))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), *self.centres.shape[::2])

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes of rows: by coordinate descent on the anisotropic loss."""
        parts = self.parts(x)
        along = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = np.zeros(parts.shape[:2], dtype=np.uint8)
        shift = np.zeros(parts.shape[:2])  # what each subspace's residual adds along the vector
        for turn in range(passes + 1):
            for s in range(parts.shape[1]):
                left = parts[:, s, None, :] - self.centres[s]
                across = np.einsum("nkd,nkd->nk", left, left)
                own = np.einsum("nkd,nd->nk", left, along[:, s])
                rest = shift.sum(axis=1) - shift[:, s] if turn else 0.0
                loss = across + (self.eta - 1) * (own + np.asarray(rest).reshape(-1, 1)) ** 2
                codes[:, s] = loss.argmin(axis=1)
                shift[:, s] = own[np.arange(len(x)), codes[:, s]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)

    def scan(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products (query, row) from tables of code pairs."""
        tables = np.einsum("nsd,skd->snk", self.parts(q), self.centres).astype(np.float32)
        if len(tables) % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:1])])
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
        out = np.zeros((len(q), len(codes)), dtype=np.float32)
        for s in range(0, len(tables), 2):
            pair = (tables[s][:, :, None] + tables[s + 1][:, None, :]).reshape(len(q), -1)
            out += np.take(pair, codes[:, s].astype(np.intp) * CENTRES + codes[:, s + 1], axis=1, mode="clip")
        return out


def fit(sample: np.ndarray, sub_dim: int = SUB_DIM, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Quantiser:
    """Centres for a sample: k-means starts, then rounds of codes and weighted least squares."""
    dim = sample.shape[1]
    subspaces = -(-dim // sub_dim)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    model = Quantiser(np.zeros((subspaces, CENTRES, sub_dim)), eta)
    parts = model.parts(sample)
    rng = np.random.default_rng(0)
    for s in range(subspaces):
        picked = rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES)
        model.centres[s] = parts[picked, s] + rng.normal(0, 1e-6, (CENTRES, sub_dim))
    along = parts / np.maximum(np.linalg.norm(sample, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = model.encode(sample, passes=1)
        left = parts - model.decode(codes).reshape(parts.shape)
        shift = np.einsum("nsd,nsd->ns", left, along)
        for s in range(subspaces):
            rest = shift.sum(axis=1) - shift[:, s]
            u, x = along[:, s], parts[:, s]
            goal = x + (eta - 1) * u * (rest + np.einsum("nd,nd->n", x, u))[:, None]
            for c in range(CENTRES):
                mine = codes[:, s] == c
                if mine.any():
                    weigh = mine.sum() * np.eye(sub_dim) + (eta - 1) * u[mine].T @ u[mine]
                    model.centres[s, c] = np.linalg.solve(weigh, goal[mine].sum(axis=0))
            shift[:, s] = np.einsum("nd,nd->n", x - model.centres[s, codes[:, s]], u)
    return model


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row, added in the order of the components, as a plain sum would."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def plain_search(k: int):
    """The first block, the longest candidates: exact."""

    def search(q, q_ids, floor, c, c_ids):
        keep = few_copies(c, c_ids, k)
        c, ids = c[keep], c_ids[keep]
        own_q, own_c = own_entries(q_ids, ids)
        out = []
        for i in range(0, len(q), STEP_QUERIES):
            part = slice(i, min(i + STEP_QUERIES, len(q)))
            near = q[part] @ c.T
            mine = (own_q >= part.start) & (own_q < part.stop)
            near[own_q[mine] - part.start, own_c[mine]] = -np.inf
            n = min(k, near.shape[1])
            least = -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]
            r, s = np.nonzero((near >= least - 1e-9 * (1 + np.abs(least))) & (near > -np.inf))
            out.append((r + part.start, s, products(q[part][r], c[s])))
        r, s, x = top_of_rows(*(np.concatenate(y) for y in zip(*out)), ids, k)
        return r, keep[s], x

    return search


def _scan(model: Quantiser, rerank: int):
    """The codes of a block against a chunk of queries: each query's ``rerank`` best by table."""

    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            order = np.argsort(candidates["c_id"].to_numpy(), kind="stable")  # smaller ids first among equal codes
            ids, q_ids = candidates["c_id"].to_numpy()[order], queries["id"].to_numpy()
            raw = candidates["c_v"].combine_chunks()
            codes = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            q = as_matrix(queries["v"])
            own_q, own_c = own_entries(q_ids, ids)
            for i in range(0, len(q), STEP_QUERIES):
                part, held = slice(i, min(i + STEP_QUERIES, len(q))), []
                for j in range(0, len(ids), STEP_CODES):
                    step = slice(j, min(j + STEP_CODES, len(ids)))
                    near = model.scan(q[part], codes[step])
                    mine = (own_q >= part.start) & (own_q < part.stop) & (own_c >= step.start) & (own_c < step.stop)
                    near[own_q[mine] - part.start, own_c[mine] - step.start] = -np.inf
                    n = min(rerank, near.shape[1])
                    least = -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]
                    above, equal = near > least, near == least
                    pick = above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= n - above.sum(axis=1)[:, None])
                    r, s = np.nonzero(pick & (near > -np.inf))
                    held.append((r, s + step.start, near[r, s]))
                r, s, x = top_of_rows(*(np.concatenate(y) for y in zip(*held)), ids, rerank)
                found["query_id"].append(q_ids[part][r])
                found["vec_id"].append(ids[s])
                found["score"].append(x.astype(np.float64))
        columns = {k: np.concatenate(v) if v else np.empty(0) for k, v in found.items()}
        return pa.table({k: pa.array(v, pa.float64() if k == "score" else pa.int64()) for k, v in columns.items()})

    return run


def encoded(candidates: DataFrame, model: Quantiser) -> DataFrame:
    """(id, len2, codes) of every candidate, made where the rows are and written once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = model.encode(as_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("len2"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "len2", "codes"])

    return materialise(candidates.select("id", "v", "len2").mapInArrow(run, "id long, len2 double, codes binary"), "codes")


def rescored(found: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, vec_id) with their exact products: vectors are fetched for these pairs only."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = products(as_matrix(batch.column("q")), as_matrix(batch.column("c")))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(x)], ["query_id", "vec_id", "score"])

    pairs = found.select("query_id", "vec_id").join(candidates.select(F.col("id").alias("vec_id"), F.col("v").alias("c")), "vec_id")
    pairs = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return pairs.select("query_id", "vec_id", "q", "c").mapInArrow(run, "query_id long, vec_id long, score double")


def approximate_search(
    rows: DataFrame, is_query: Column, k: int, rerank: int, sample_rows: int,
    block_rows: int = V.BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
    code_rows: int = CODE_ROWS,
) -> DataFrame:
    """rows (id, v, len2) of one dimension -> query_id, rank, vec_id, score."""
    candidates = materialise(V.without_copies(rows, k), "candidates")
    f = V.floors(rows, candidates, is_query, plain_search(k), k, block_rows, chunk_queries)
    if f is None:
        return V.empty(rows)
    if f.blocks.first[-1] < 2:
        return f.seed
    sample = candidates.select("v").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    model = fit(as_matrix(sample.toArrow()["v"]))
    rest = encoded(candidates.where(~V.in_seed(f.blocks)), model)
    blocks = V.classes_of(rest, "len2", code_rows)
    if blocks is None:
        return f.seed
    q, c = V.live_cells(f, blocks, rest, "codes", 0)
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in ("id", "v", "chunk", "block")])
    near = q.groupBy("chunk", "block").cogroup(c.groupBy("c_chunk", "c_block")).applyInArrow(_scan(model, rerank), "query_id long, vec_id long, score double")
    best = materialise(V.first_k(near, rerank), "nearest")
    exact = rescored(best, f.queries, candidates)
    return V.first_k(exact.union(f.seed.select("query_id", "vec_id", "score")), k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    rerank: int = RERANK,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    **how,
) -> DataFrame:
    """query_id, rank, vec_id, score: k near neighbours by inner product, nearest first.

    Scores are exact, on the original vectors in double precision; ties go to the smaller
    id.  Which rows are found is approximate: every row is indexed, the block of the longest
    vectors is searched exactly, and of the others the ``rerank`` best by code are scored.
    Centres are fitted on ``sample_rows`` rows at most.  ``is_query`` is a condition on ``id``.
    Vectors that are null, empty or zero, or hold nulls or non-finite components, take no
    part; neither do null ids.  Each vector length is searched on its own.  A repeated id
    counts once, with the smallest of its vectors.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    rows = with_lengths(usable(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0)))
    found = V.by_dimension(rows, lambda part, _: approximate_search(part, is_query, k, max(k, rerank), sample_rows, **how))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
