"""Quality by cumulative-link regression on hashed text features.

Grades are ordered.  One weight per hashed feature, of words and of their shapes, is shared by
all grades; thresholds that rise from grade to grade cut the score: P(grade <= g) =
sigmoid(threshold_g - score).  That gives each text an expected grade and a tail probability
to select by.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import lean

#: Hashed weights.
BUCKETS = 1 << 15
#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 6000
#: Steps of the fit at most; it ends when the gradient is that small.
STEPS = 100
LEAST_GRADIENT = 1e-5
#: Weight of the squared weights in the fit.
PENALTY = 1e-4
#: Words weigh less than shapes: most are rare, and a sample shows few of them.
WORD_SHARE = 0.5
#: Probability of the highest grade from which a document is kept.
KEEP_FROM = 0.5

_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b
    for b in range(256)
)


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the hashed features of a whole text; a bucket can come twice.

    Features: each word, small letters or not, and each word's shape (runs of capitals, small
    letters, digits and marks), by the root of their share of the text; how much of the text its
    commonest word makes up, how many of its words differ, how many lines there are, and the
    order of its length.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.array([zlib.crc32(b"#none") % buckets], dtype=np.uint32), np.ones(1, dtype=np.float32)
    marks = np.frombuffer(raw.translate(_SHAPE), dtype=np.uint8)
    kept = marks[np.concatenate([[True], marks[1:] != marks[:-1]])].tobytes()
    shapes, seen = Counter(kept.split()), Counter(words)
    small = Counter(raw.lower().split())
    names = [
        b"#most:%d" % min(9, 10 * max(seen.values()) // len(words)),
        b"#once:%d" % min(9, 10 * len(seen) // len(words)),
        b"#size:%d" % len(words).bit_length(),
        b"#lines:%d" % min(9, 20 * raw.count(b"\n") // len(words)),
    ]
    n = len(shapes) + len(small)
    at = np.empty(n + len(names), dtype=np.uint32)
    at[: len(shapes)] = np.fromiter((zlib.crc32(x, 1) for x in shapes), dtype=np.uint32, count=len(shapes))
    at[len(shapes) : n] = np.fromiter(map(zlib.crc32, small), dtype=np.uint32, count=len(small))
    at[n:] = [zlib.crc32(x) for x in names]
    value = np.ones(len(at), dtype=np.float32)
    value[: len(shapes)] = np.sqrt(np.fromiter(shapes.values(), dtype=np.float32, count=len(shapes)) / len(words))
    value[len(shapes) : n] = WORD_SHARE * np.sqrt(np.fromiter(small.values(), dtype=np.float32, count=len(small)) / len(words))
    return at % np.uint32(buckets), value


class Sparse:
    """Rows of (buckets, values), with the two products that a fit needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], buckets: int):
        sizes = np.array([len(at) for at, _ in rows], dtype=np.int64)
        self.shape = (len(rows), buckets)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.at = np.concatenate([at for at, _ in rows]).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, dtype=np.float32)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * g[self.row], minlength=self.shape[1])


@dataclass
class CumulativeLink:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= g) for all grades but the highest."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        steps = np.diff(self.grades)
        return self.grades[0] + ((1 - self.below(score)) * steps).sum(axis=1)

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        at = self.grades.index(grade)
        return np.ones(len(score)) if at == 0 else 1 - self.below(score)[:, at - 1]


def minimise(loss, start: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with halved steps; ``loss`` gives a value and its gradient."""
    at, (value, grad) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < LEAST_GRADIENT:
            break
        way, shares = grad.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ way / (s @ y))
            way -= shares[-1] * y
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), share in zip(moves, reversed(shares)):
            way += (share - y @ way / (s @ y)) * s
        slope, step = -(grad @ way), 1.0 if moves else min(1.0, 1 / np.abs(grad).sum())
        while step > 1e-12:
            new = at - step * way
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new_grad - grad) @ (new - at) > 1e-12:
            moves = [*moves, (new - at, new_grad - grad)][-memory:]
        at, value, grad = new, new_value, new_grad
    return at


def fit(x: np.ndarray | Sparse, y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> CumulativeLink:
    """Maximum likelihood, less ``penalty`` / 2 times the squared weights, by L-BFGS on all rows;
    thresholds stay ordered as sums of exponentials."""
    grades = sorted(set(y.tolist()))
    n, cuts, width = len(y), len(grades) - 1, x.shape[1]
    if cuts < 1:
        return CumulativeLink(grades, np.zeros(width), np.zeros(0))
    place = np.searchsorted(grades, y)
    share = np.cumsum(np.bincount(place, minlength=len(grades)))[:-1] / n
    start = np.log(share / (1 - share))
    back = x.transposed_times if isinstance(x, Sparse) else lambda g: x.T @ g
    ordered = lambda free: np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])

    def loss(params: np.ndarray) -> tuple[float, np.ndarray]:
        w, free = params[:width], params[width:]
        edges = np.concatenate([[-np.inf], ordered(free), [np.inf]])
        score = x @ w
        with np.errstate(over="ignore"):
            high = 1 / (1 + np.exp(-(edges[place + 1] - score)))
            low = 1 / (1 + np.exp(-(edges[place] - score)))
        likely = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / likely, low * (1 - low) / likely
        g_theta = np.array([(d_low[place == k + 1].sum() - d_high[place == k].sum()) / n for k in range(cuts)])
        g_free = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * np.exp(free[k]) for k in range(1, cuts)]])
        grad = np.concatenate([back(d_high - d_low) / n + penalty * w, g_free])
        return -np.log(likely).mean() + penalty / 2 * (w @ w), grad

    params = minimise(loss, np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))]), steps)
    return CumulativeLink(grades, params[:width], ordered(params[width:]))


def training_rows(labels: DataFrame, docs: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample_rows`` labelled rows that training may see.

    Rows with crc32(doc_id as text) mod 4 = 2 are held out.  Null labels and ids are left
    out; an id that is labelled twice counts with its largest label.
    """
    known = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").where("crc32(cast(doc_id as string)) % 4 <> 2")
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # sample_rows small rows
    return texts.groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> CumulativeLink:
    """A model from at most ``sample_rows`` labelled rows that are not held out; everything is
    kept without labels."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py(), buckets) for x in batch.column("text")]
            arrays = [batch.column("label"), pa.array([at.tobytes() for at, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "at", "value"])

    rows = training_rows(labels, docs, "quality", sample_rows).select("label", "text").mapInArrow(run, "label int, at binary, value binary")
    got = rows.toArrow()  # sample_rows rows at most
    if not got.num_rows:
        return CumulativeLink([1], np.zeros(buckets), np.zeros(0))
    sample = [(np.frombuffer(a, dtype=np.uint32), np.frombuffer(v, dtype=np.float32)) for a, v in zip(got["at"].to_pylist(), got["value"].to_pylist())]
    return fit(Sparse(sample, buckets), got["label"].to_numpy())


def quality_column(model: CumulativeLink, text: Column, least_grade: int | None = None) -> Column:
    """A column (expected_grade, p_tail) for a column of texts; only the texts go to Python."""
    grade = model.grades[-1] if least_grade is None else least_grade
    buckets, weights = len(model.weights), model.weights
    link = CumulativeLink(model.grades, np.zeros(0), model.thresholds)

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (features(t.as_py(), buckets) for t in texts)
            score = np.array([weights[at] @ value for at, value in found], dtype=np.float64)
            yield pa.StructArray.from_arrays([pa.array(link.expected(score)), pa.array(link.tail(score, grade))], ["expected_grade", "p_tail"])

    return F.arrow_udf(run, "expected_grade double, p_tail double")(text.cast("string"))


def score_quality(docs: DataFrame, model: CumulativeLink, least_grade: int | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, expected_grade, p_tail, keep for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored.  p_tail: the probability of
    ``least_grade`` (the highest) or more; keep: p_tail >= ``keep_from``.  Null texts count as
    empty ones; rows are scored one by one, so repeated rows repeat.
    """
    scored = docs.select("doc_id", quality_column(model, F.col("text"), least_grade).alias("q"))
    return scored.select("doc_id", "q.expected_grade", "q.p_tail", (F.col("q.p_tail") >= keep_from).alias("keep"))
