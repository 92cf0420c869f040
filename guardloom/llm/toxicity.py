"""Toxicity of texts, scored after a noisy-channel deobfuscation.

Words that could hide letters (leetspeak, drawn-out letters, spaced-out letters) become
lattices: each character may stand for itself, for the letters it looks like, or for
nothing.  A Viterbi search under a character model finds the likeliest reading, which takes
the place of what was written; all other words have one reading, themselves.  A logistic
regression on words and word beginnings of the restored text gives the score; it is fitted on
restored texts too.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardloom.llm.common import lean, materialise
from guardloom.llm.quality import Sparse, minimise, training_rows

#: Labelled rows that models are fitted on, at most.
SAMPLE_ROWS = 6000
#: Words and beginnings that the regression uses, at most: those that tell the labels apart best.
#: The bound is on the model, like that on its sample; 150 to 250 were found on the test tables.
FEATURES = 2000
#: Log-likelihood ratio (chi-squared with one degree of freedom) from which a feature counts
#: as bound to the label: about what the best of a hundred thousand unrelated ones reaches by chance.
LEAST_RATIO = 20.0
PREFIXES = (4, 5, 6, 7)
#: A beginning counts as a feature when so many different words of a text have it.
REPEATS = (1, 2, 4)
PREDICT_FROM = 0.3
STEPS = 100
#: Weight, in the fit, of squared differences from each feature's own log odds.
PENALTY = 1e-5

#: Letters that a mark or digit is written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h",
}
#: Costs of the channel, in nats.
COST_LOOKALIKE, COST_WILD, COST_KEEP, COST_DROP, COST_REPEAT = 0.5, 2.5, 6.0, 0.7, 3.0

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.escape("".join(LOOKALIKES))
#: whole runs that mix letters and such marks
_LEET = re.compile(rf"(?<![\w{_MARKS}])(?=[{_MARKS}]*+[^\W\d_])(?=[^\W{_MARKS}]*+[{_MARKS}])[\w{_MARKS}]++")
_MARK = re.compile(rf"[{_MARKS}]+")
_RUN = re.compile(rf"[\w{_MARKS}]*+")
_LEAD = re.compile(rf"[{_MARKS}]*+[^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(rf"(?<![\w{_MARKS}])(?:[^\W_]|[@$!])(?:[ .\-_*][^\W\d_0]|[ .\-_*][0-9@$!](?=[ .\-_*])){{2,}}(?![\w])")


@dataclass
class CharModel:
    """Log probabilities of a letter after two letters, with back-off to one and none."""

    three: Counter = field(default_factory=Counter)
    two: Counter = field(default_factory=Counter)
    one: Counter = field(default_factory=Counter)
    zero: Counter = field(default_factory=Counter)

    def learn(self, trigrams: Counter) -> "CharModel":
        """From counts of three letters of words marked as ^^word$."""
        for gram, n in trigrams.items():
            self.three[gram] += n
            self.two[gram[:2]] += n
            self.one[gram[1:]] += n
            self.zero[gram[2]] += n
        return self

    def cost(self, context: str, letter: str) -> float:
        costs = self.__dict__.setdefault("_costs", {})
        if (key := context + letter) not in costs:
            if len(costs) > 500_000:
                costs.clear()
            costs[key] = self._cost(context, letter)
        return costs[key]

    def _cost(self, context: str, letter: str) -> float:
        total = sum(self.zero.values()) if not hasattr(self, "_total") else self._total
        self._total = total
        floor = (self.zero[letter] + 0.1) / (total + 10)
        second = (self.one[context[-1] + letter] + 3 * floor) / (sum_of(self, context[-1]) + 3)
        third = (self.three[context + letter] + 3 * second) / (self.two[context] + 3)
        return -math.log(third)


def sum_of(model: CharModel, letter: str) -> int:
    """How often ``letter`` was followed by anything."""
    cache = model.__dict__.setdefault("_after", {})
    if letter not in cache:
        cache[letter] = sum(n for pair, n in model.one.items() if pair[0] == letter)
    return cache[letter]


def decode(raw: str, model: CharModel, cache: dict[str, str]) -> str:
    """The likeliest letters of one obfuscated word."""
    if raw in cache:
        return cache[raw]
    drawn = _DRAWN.sub(r"\1\1", raw.lower())  # not marks: each may be a letter
    states = {"^^": (0.0, "")}
    for i, c in enumerate(drawn):
        options = [(c, 0.0 if c.isalpha() else COST_KEEP)]
        options += [(x, COST_LOOKALIKE if len(LOOKALIKES[c]) < 3 else COST_WILD) for x in LOOKALIKES.get(c, "")]
        if not c.isalnum():
            options.append(("", COST_DROP))
        elif i and drawn[i - 1] == c:
            options.append(("", COST_REPEAT))
        after: dict[str, tuple[float, str]] = {}
        for context, (so_far, text) in states.items():
            for letter, price in options:
                if letter:
                    cost, key = so_far + price + model.cost(context, letter), context[-1] + letter
                else:
                    cost, key = so_far + price, context
                if key not in after or cost < after[key][0]:
                    after[key] = (cost, text + letter)
        states = after
    best = min((cost + model.cost(context, "$"), text) for context, (cost, text) in states.items())[1]
    if len(cache) > 200_000:
        cache.clear()
    cache[raw] = best
    return best


def _drawn_words(text: str, points: np.ndarray) -> list[tuple[int, int]]:
    """Where words with a letter three times or more in a row stand; ``points`` are the code points."""
    out, end = [], 0
    for i in np.flatnonzero((points[:-2] == points[1:-1]) & (points[1:-1] == points[2:])).tolist():
        if i >= end and _TRIPLE.match(text, i):
            first, end = i, i + 3
            while first and text[first - 1].isalpha():
                first -= 1
            while end < len(text) and text[end].isalpha():
                end += 1
            out.append((first, end))
    return out


def _mixed_words(text: str) -> list[tuple[int, int]]:
    """The spans of _LEET: around each sign, as most texts have few."""
    out, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() >= end:
            first, end = m.start(), _RUN.match(text, m.end()).end()
            while first and (text[first - 1].isalnum() or text[first - 1] == "_"):
                first -= 1
            if _LEAD.match(text, first):
                out.append((first, end))
    return out


_GAP = np.zeros(128, dtype=bool)
_GAP[[ord(c) for c in " .-_*"]] = True
_PLAIN_LETTER = np.array([chr(i).isalnum() for i in range(128)])


def _may_be_spaced(points: np.ndarray) -> bool:
    """Whether two gaps with one character between them stand behind a character that no plain letter is before."""
    low = np.minimum(points, 127)
    gap, letter = _GAP[low] & (points < 127), _PLAIN_LETTER[low] & (points < 127)
    two = gap[1:-2] & ~gap[2:-1] & gap[3:]  # gaps at i + 1 and i + 3 behind a character at i
    return bool(two.size and (two[0] or (two[1:] & ~letter[: len(two) - 1]).any()))


def hidden(text: str) -> list[tuple[int, int, str]]:
    """(first, end, letters and signs) of what could hide a word in a small-letter text, in order:
    spaced-out letters without their gaps, mixed letters and signs, drawn-out words."""
    found, points = [], np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    spaced = [m.span() for m in _SPACED.finditer(text)] if _may_be_spaced(points) else []
    for rank, spans in enumerate((spaced, _mixed_words(text), _drawn_words(text, points))):
        for first, end in spans:
            raw = text[first:end] if rank else re.sub(r"[ .\-_*]", "", text[first:end])
            if any(c.isalpha() for c in raw):
                found.append((first, rank, end, raw))
    out, at = [], 0
    for first, _, end, raw in sorted(found):
        if first >= at:
            out.append((first, end, raw))
            at = end
    return out


def restored(text: str | None, model: CharModel, cache: dict[str, str]) -> str:
    """A whole text in small letters with the likeliest reading of all that could hide a word."""
    small = (text or "").lower()
    spans = hidden(small)
    if not spans:
        return small
    parts, at = [], 0
    for first, end, raw in spans:
        parts += [small[at:first], " ", decode(raw, model, cache), " "]
        at = end
    return "".join([*parts, small[at:]])


def readings(text: str, model: CharModel, cache: dict[str, str]) -> list[str]:
    """The restored words of a small-letter text alone."""
    return [w for _, _, raw in hidden(text) for w in _WORD.findall(decode(raw, model, cache))]


def word_set(text: str | None, model: CharModel | None, cache: dict[str, str]) -> set[str]:
    """Distinct words of a whole text as it is restored; without a model, as it is written."""
    return set(_WORD.findall((text or "").lower() if model is None else restored(text, model, cache)))


def document_features(words: set[str]) -> set[str]:
    """Words, marked at both ends, and word beginnings, also with how many words have them."""
    out = {f"^{w}$" for w in words}
    for begun, n in Counter(w[:n] for w in words for n in PREFIXES if len(w) > n).items():
        out.update(f"^{begun}#{k}" for k in REPEATS if n >= k)
    return out


@dataclass
class ToxicityModel:
    letters: CharModel
    weights: dict[str, float]
    bias: float

    def scorer(self):
        cache: dict[str, str] = {}
        whole = {k[1:-1]: v for k, v in self.weights.items() if k.endswith("$")}
        starts: dict[int, dict[str, list[tuple[int, float]]]] = {n: {} for n in PREFIXES}
        for k, v in self.weights.items():
            if not k.endswith("$"):
                begun, _, least = k[1:].partition("#")
                starts[len(begun)].setdefault(begun, []).append((int(least), v))
        sizes = [(n, known) for n, known in starts.items() if known]

        def score(text: str | None) -> float:
            total, counts = self.bias, Counter()
            words = word_set(text, self.letters, cache)
            for w in words & whole.keys():
                total += whole[w]
            for n, known in sizes:
                begun = [w[:n] for w in words if w[:n] in known and len(w) > n]
                if begun:
                    counts.update(begun)
            for begun, count in counts.items():
                total += sum(v for least, v in starts[len(begun)][begun] if count >= least)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))

        return score


def _fit_weights(x: Sparse, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by L-BFGS on all rows, with a penalty on how far a weight is from its
    feature's own log odds: evidence that always comes together is not shared out among its parts."""
    prior = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    a, b = x.transposed_times(y) + 0.5, x.transposed_times(1 - y) + 0.5
    start = np.append(np.log(a / b) - prior, prior)

    def loss(params: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ params[:-1] + params[-1]
        off = params[:-1] - start[:-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        value = (np.logaddexp(0, z) - y * z).mean() + PENALTY / 2 * (off @ off)
        return value, np.append(x.transposed_times(gap) / len(y) + PENALTY * off, gap.mean())

    params = minimise(loss, start, STEPS)
    return params[:-1], float(params[-1])


def without_near_copies(rows: DataFrame) -> DataFrame:
    """Training rows without those that share one of three least hashes of their three-word
    shingles with a row of smaller id: copies would count their words as independent evidence."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            least = []
            for text in batch.column("text").to_pylist():
                words = (text or "").lower().split()
                grams = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
                least.append([min(xxhash.xxh32_intdigest(g, seed) for g in grams) for seed in range(3)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(least, pa.list_(pa.int64()))], ["doc_id", "label", "text", "least"]
            )

    marked = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, text string, least array<long>")
    for i in range(3):
        marked = marked.withColumn(f"first{i}", F.min("doc_id").over(Window.partitionBy(F.col("least")[i])))
    return marked.where("first0 = doc_id AND first1 = doc_id AND first2 = doc_id").select("doc_id", "label", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_features: int = FEATURES) -> ToxicityModel:
    """A model from at most ``sample_rows`` labelled rows that are not held out.

    The character model learns from the words of all documents.  Without rows of both labels
    every text scores the share of label 1 (0 without any).
    """
    letters = CharModel().learn(letter_trigrams(docs))

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            found = [sorted(document_features(word_set(x.as_py(), letters, cache))) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.string()))], ["label", "features"])

    sample = without_near_copies(training_rows(labels, docs, "toxic", sample_rows)).select("label", "text")
    rows = materialise(sample.mapInArrow(read, "label int, features array<string>"), "toxic-sample")
    toxic = (F.col("label") > 0).cast("long")
    counted = rows.select(toxic.alias("toxic"), F.explode("features").alias("feature")).groupBy("feature").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    n_all, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum(toxic), F.lit(0))).first()
    n_clean = n_all - n_toxic
    if not n_clean or not n_toxic:
        return ToxicityModel(letters, {}, 50.0 if n_toxic else -50.0)
    a, b = F.col("toxic"), F.col("clean")
    expected_a, expected_b = (a + b) * n_toxic / n_all, (a + b) * n_clean / n_all
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gap = 2 * (term(a, expected_a) + term(b, expected_b))
    chosen = counted.where((gap >= LEAST_RATIO) & (a > expected_a))
    names = [r["feature"] for r in chosen.orderBy(F.desc(gap), "feature").limit(most_features).collect()]
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    got = rows.select("label", F.array_intersect("features", wanted).alias("known")).toArrow()  # sample_rows rows at most
    place = {f: i for i, f in enumerate(names)}
    sparse = []
    for known in got["known"].to_pylist():
        at = np.array([place[f] for f in known], dtype=np.uint32)
        sparse.append((at, np.ones(len(at), dtype=np.float32)))
    weights, bias = _fit_weights(Sparse(sparse, len(names)), (got["label"].to_numpy() > 0).astype(float))
    return ToxicityModel(letters, dict(zip(names, weights.tolist())), bias)


def letter_trigrams(docs: DataFrame) -> Counter:
    """How often three letters follow each other in the words of all documents, each word once a document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            grams: Counter = Counter()
            for word, n in held.items():
                marked = f"^^{word}$"
                for i in range(len(word) + 1):
                    grams[marked[i : i + 3]] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], ["gram", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(word_set(text.as_py(), None, {}))
                if len(held) > 200_000:
                    yield out()
        yield out()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram string, n long")
    return Counter({r["gram"]: r["n"] for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()})


def toxicity_column(model: ToxicityModel, text: Column) -> Column:
    """A column of scores for a column of texts; only the texts go to Python."""

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for texts in batches:
            yield pa.array([score(x.as_py()) for x in texts], pa.float64())

    return F.arrow_udf(run, "double")(text.cast("string"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, predict_from: float = PREDICT_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``docs`` needs doc_id and text; nothing else is looked at.  held_out: crc32 of the id
    as text mod 4 is 2 (null for a null id).  Null and empty texts get the score of a text
    without words; rows are scored one by one, so repeated rows repeat.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity_column(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= predict_from).cast("int").alias("predicted"),
    )
