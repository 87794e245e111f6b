"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters'
vectors, the first two shifted by two places and one; a text is the sum of its trigrams,
a language the sum of its training texts. The language with the largest cosine wins.

Letters are lower-cased; everything else is a word boundary, which is a letter of its
own at the edges of words. Whole texts are read, in blocks. A text that is null or has
no letter is ``und`` with score 0, and so is every text if nothing could be learned.
Null languages are not learned from; null and repeated ids stay; equal cosines go to
the first language by name; other columns are ignored. Sums are whole numbers, so the
result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import BLOCK_CHARS, as_text, map_batches, map_partitions

DIMENSIONS, KEPT_GRAMS, SEED = 1024, 24_576, 7
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
_BITS = 21


class Profiles:
    """Counts trigrams and turns counts into vectors; remembers the vectors of a bounded number of trigrams."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)  # of a code point: 0 is the boundary
        self.points = [32]
        self.letters = [self._letter(32)]
        self.rows: dict[int, int] = {}
        self.table = np.empty((KEPT_GRAMS, dimensions), np.float32)

    def _letter(self, point: int) -> np.ndarray:
        return np.random.default_rng([SEED, point]).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1

    def _numbers(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        numbers = self.number[points]
        if (numbers < 0).any():
            for point in np.unique(points[numbers < 0]).tolist():
                self.number[point] = len(self.letters) if chr(point).isalpha() else 0
                if self.number[point]:
                    self.letters.append(self._letter(point))
            numbers = self.number[points]
        return numbers

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of ``text`` and their counts; those with a boundary in the middle say nothing."""
        found = []
        for at in range(0, max(len(text), 1), BLOCK_CHARS):
            numbers = np.concatenate([[0], self._numbers(text[max(at - 2, 0) : at + BLOCK_CHARS]), [0]]).astype(np.int64)
            numbers = numbers[(numbers != 0) | np.concatenate([[True], numbers[:-1] != 0])]
            codes = (numbers[:-2] << 2 * _BITS) | (numbers[1:-1] << _BITS) | numbers[2:]
            found.append(np.unique(codes[numbers[1:-1] != 0], return_counts=True))
        if len(found) == 1:
            return found[0]
        return merged(found)

    def _row(self, code: int) -> int:
        row = self.rows.get(code)
        if row is None:
            a, b, c = code >> 2 * _BITS, (code >> _BITS) & ((1 << _BITS) - 1), code & ((1 << _BITS) - 1)
            row = self.rows[code] = len(self.rows)
            self.table[row] = np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]
        return row

    def vector(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for at in range(0, len(codes), KEPT_GRAMS // 2):
            part = codes[at : at + KEPT_GRAMS // 2].tolist()
            if len(self.rows) + len(part) > KEPT_GRAMS:
                self.rows.clear()
            rows = [self._row(c) for c in part]
            total += counts[at : at + KEPT_GRAMS // 2].astype(np.float32) @ self.table[rows]
        return total


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in found])
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(place, np.concatenate([n for _, n in found]), len(distinct)).astype(np.int64)


_profiles: dict[int, Profiles] = {}


def _of(dimensions: int) -> Profiles:
    if dimensions not in _profiles:
        _profiles[dimensions] = Profiles(dimensions)
    return _profiles[dimensions]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of every language: the sum of its texts, normed. Every row is used.

    Tasks hand on one vector per language; the languages of a column of labels are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = _of(dimensions), {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for t, name in zip(as_text(batch.column(0)), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(profiles.grams(t))
            for name, found in by_lang.items():
                sums[name] = sums.get(name, 0) + profiles.vector(*merged(found))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["l", "v"])

    parts = map_partitions(docs.filter(F.col(lang).isNotNull()).select(text, lang), run, "l string, v array<double>")
    sums = parts.select("l", F.posexplode("v").alias("at", "x")).groupBy("l", "at").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("l", "v.x")
    found = rows.orderBy("l").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vectors = {r.l: np.array(r.x) for r in found}
    return {name: v / np.linalg.norm(v) for name, v in vectors.items() if v.any()}


def predict(
    docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text",
    keep: dict[str, Column] | None = None, dimensions: int = DIMENSIONS,
) -> DataFrame:
    """(key, *keep, lang_pred, score): the score is the cosine, at least 0."""
    names, keep = sorted(prototypes), keep or {}
    matrix = np.array([prototypes[n] for n in names]) if names else np.zeros((0, dimensions))

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        profiles, langs, scores = _of(dimensions), [], []
        for t in as_text(batch.column(0)):
            codes, counts = profiles.grams(t)
            norm = 0.0
            if len(codes) and names:
                vector = profiles.vector(codes, counts)
                norm = float(np.linalg.norm(vector))
            cosines = matrix @ vector / norm if norm else np.zeros(len(names))
            best = int(np.argmax(cosines)) if len(codes) and names else -1
            langs.append(names[best] if best >= 0 else UNKNOWN)
            scores.append(min(max(float(cosines[best]), 0.0), 1.0) if best >= 0 else 0.0)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(langs), pa.array(scores)], [*batch.schema.names[1:], "_l", "_s"])

    rows = docs.select(F.col(text).alias("_t"), F.col(key).alias("_k"), *[v.alias(f"_{i}") for i, v in enumerate(keep.values())])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_batches(rows, worker, f"{schema}, _l string, _s double").toDF(key, *keep, "lang_pred", "score")
