"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every known word has a sparse random index vector. Its word vector is the sum of the
index vectors of its neighbours within two words, over the training texts, normed. A
document is the mean of its words' vectors and the logarithm of its length. Words that
are not among the frequent ones count by their shape (``Xx*`` for ``Word***``), a word
equal to the one before it as "again". The network's logit is divided by a temperature
fitted on training rows that the weights have not seen.

The classifier is fitted on at most ``max_train`` labelled documents, those with the
smallest hash of their id; everything else is read whole. Null text counts as empty and
gets a score like any other. Null labels are not learned from, rows of an id with several
labels count by the lowest. Without labelled rows the score is 0.5, with one class only
it is that class. Null and repeated ids stay; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import SPACE_PATTERN, as_text, map_batches, map_partitions
from placelab.session import discard, materialize

MAX_TRAIN, MAX_WORDS, MAX_SHAPES, LEAST_COUNT = 20_000, 8_000, 1_000, 5
DIMENSIONS, HIDDEN, REACH, SEED, THRESHOLD = 64, 32, 2, 11, 0.7
KEPT_WORDS, BLOCK_WORDS, FIT_TASKS = 400_000, 1 << 18, 8
_SPACES = re.compile(SPACE_PATTERN)
_SHAPES = [(re.compile(p), r) for p, r in (
    (r"[^\W\d_]+", lambda m: re.sub(r"X+", "X", re.sub(r"x+", "x", "".join("X" if c.isupper() else "x" for c in m[0])))),
    (r"\d+", "9"), (r"([^\w])\1+", r"\1"))]


def words_of(text: str) -> list[str]:
    return [w for w in _SPACES.split(text) if w]


def shape_of(word: str) -> str:
    """The first places of a word with runs of letters, digits and signs shortened."""
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return "\0" + word[:12]


class Vocabulary:
    """Numbers of words: frequent words, frequent shapes, then "again" and "other"."""

    def __init__(self, words: list[str], shapes: list[str]) -> None:
        self.words, self.shapes = words, shapes
        self.again, self.other = len(words) + len(shapes), len(words) + len(shapes) + 1
        self.fixed = {w: i for i, w in enumerate([*words, *shapes])}
        self.cache: dict[str, int] = dict(self.fixed)

    def __len__(self) -> int:
        return self.other + 1

    def __getstate__(self) -> tuple:
        return self.words, self.shapes

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _number(self, word: str) -> int:
        number = self.cache.get(word)
        if number is None:
            number = self.fixed.get(shape_of(word), self.other)
            if len(self.cache) >= KEPT_WORDS:
                self.cache = dict(self.fixed)
            if len(word) <= 64:
                self.cache[word] = number
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        found = np.fromiter(map(self._number, words), np.int64, len(words))
        same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)
        found[1:][same] = self.again
        return found


def index_vectors(size: int) -> np.ndarray:
    """Eight places of +1 or -1 per word."""
    rng, out = np.random.default_rng(SEED), np.zeros((size, DIMENSIONS), np.int64)
    for row in out:
        row[rng.choice(DIMENSIONS, 8, replace=False)] = rng.integers(0, 2, 8) * 2 - 1
    return out


def context_sums(numbers: np.ndarray, index: np.ndarray, sums: np.ndarray) -> None:
    """Add the index vectors of the neighbours of every word to that word's sum."""
    for at in range(0, len(numbers), BLOCK_WORDS):
        part = numbers[max(at - REACH, 0) : at + BLOCK_WORDS]
        for step in range(1, REACH + 1):
            first = max(at - max(at - REACH, 0) - step, 0) if at else 0
            a, b = part[first : len(part) - step], part[first + step :]
            np.add.at(sums, a, index[b])
            np.add.at(sums, b, index[a])


@dataclass
class Classifier:
    """A fitted model; ``vocabulary`` is None if it is a constant."""

    vocabulary: Vocabulary | None
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    constant: float = 0.5

    def pooled(self, text: str) -> np.ndarray:
        words = words_of(text)
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(words), BLOCK_WORDS):
            numbers = self.vocabulary.numbers(words[max(at - 1, 0) : at + BLOCK_WORDS])[1 if at else 0 :]
            total += self.vectors[numbers].sum(0)
        return np.append(total / max(len(words), 1), np.log1p(len(words)) / 10)

    def scores(self, features: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        hidden = np.tanh((features - mean) / scale @ w1 + b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ w2 + b2) / self.temperature, -30, 30)))

    def score_texts(self, texts: list[str]) -> np.ndarray:
        if self.vocabulary is None:
            return np.full(len(texts), self.constant)
        return self.scores(np.array([self.pooled(t) for t in texts]))


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128) -> tuple[np.ndarray, ...]:
    """Adam on the log loss, with a small weight penalty."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            grads = [x[rows].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], error.sum(keepdims=True)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return mean, scale, *weights


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a fine grid."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(8), 120))
    losses = [np.logaddexp(0, np.where(y == 1, -logits, logits) / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def learn(
    docs: DataFrame, labels: DataFrame, trained_on: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "quality", max_train: int = MAX_TRAIN,
) -> Classifier:
    """Fit on ``labels(key, label)`` of the rows where ``trained_on`` (of the key) holds."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.filter(trained_on) if trained_on is not None else rows
    chosen = (
        rows.groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_k"), "_k").limit(max_train)
    )
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    sample = materialize(texts.join(F.broadcast(chosen), "_k"))  # at most max_train ids
    spread = sample.repartition(FIT_TASKS)

    def counted(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in part:
            for t in as_text(batch.column(0)):
                words = words_of(t)
                seen.update(words)
                seen.update(map(shape_of, words))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["w", "n"])

    counts = map_partitions(spread.select("_t"), counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    is_shape = F.col("w").startswith("\0")
    top = {
        kind: [r.w for r in counts.filter(test & (F.length("w") <= 64) & (F.col("n") >= LEAST_COUNT)).orderBy(F.desc("n"), "w").limit(n).collect()]
        for kind, test, n in (("words", ~is_shape, MAX_WORDS), ("shapes", is_shape, MAX_SHAPES))
    }
    vocabulary = Vocabulary(top["words"], top["shapes"])
    index = index_vectors(len(vocabulary))

    def contexts(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(index)
        for batch in part:
            for t in as_text(batch.column(0)):
                context_sums(vocabulary.numbers(words_of(t)), index, sums)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<i4").tobytes()])], ["v"])

    sums = np.zeros_like(index)
    for row in map_partitions(spread.select("_t"), contexts, "v binary").collect():  # FIT_TASKS rows of fixed size
        sums += np.frombuffer(row.v, "<i4").reshape(sums.shape)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (sums / np.maximum(norms, 1)).astype(np.float32)
    model = Classifier(vocabulary, vectors, (), 1.0)

    def pooled(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.pooled(t).tolist() for t in as_text(batch.column(0))]
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["k", "y", "x"])

    kind = sample.schema["_k"].dataType.simpleString()
    features = map_batches(spread.select("_t", "_k", "_y"), pooled, f"k {kind}, y int, x array<double>")
    found = features.orderBy(F.xxhash64("k"), "k", "x").toArrow()
    discard(sample)
    y = found.column("y").to_numpy().astype(float) if found.num_rows else np.zeros(0)
    if len(set(y)) < 2:
        return Classifier(None, vectors, (), 1.0, float(y[0]) if len(y) else 0.5)
    x = np.array(found.column("x").to_pylist())
    unseen = np.arange(len(y)) % 5 == 4
    if len(set(y[~unseen])) < 2 or len(set(y[unseen])) < 2:
        unseen = np.zeros(len(y), bool)
    model.layers = train_network(x[~unseen], y[~unseen])
    mean, scale, w1, b1, w2, b2 = model.layers
    check = unseen if unseen.any() else ~unseen
    model.temperature = fit_temperature(np.tanh((x[check] - mean) / scale @ w1 + b1) @ w2 + b2, y[check])
    return model


def score(
    docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, *keep, score, predicted)."""
    keep = keep or {}

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.score_texts(as_text(batch.column(0)))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
            [*batch.schema.names[1:], "_s", "_p"])

    rows = docs.select(F.col(text).alias("_t"), F.col(key).alias("_k"), *[v.alias(f"_{i}") for i, v in enumerate(keep.values())])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_batches(rows, worker, f"{schema}, _s double, _p int").toDF(key, *keep, "score", "predicted")


def keep_good(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of at least that score, with all their columns."""
    place = [c.lower() for c in docs.columns].index(text.lower())

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score_texts(as_text(batch.column(place))) >= threshold))

    return map_batches(docs, worker, docs.schema)
