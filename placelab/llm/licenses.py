"""Licence statements in texts, by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words, one blank between two. The
set of its words decides which of the rules are tried at all: a rule needs all
its keywords. Every match of a tried rule is a detection with its stretch of
words. Rules of a better priority come first; a detection whose stretch lies
inside that of an accepted one of the same or a better priority is suppressed
(of equal stretches the earlier rule stays). Stretches that overlap without
containment both stay. Detections of the base phrases are all kept in the list.

A null text is empty: no words, no detections, score 0. An empty table gives no
rows; repeated rows and rows without a key each give their own result. A very
long text is split into words block by block; the memory of a task follows its
size, and its detections are settled in sorted order, not pair by pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import as_bytes, blocks, map_batches
from placelab.llm.license_rules import Rule, parsed

DETECTION = ("rule int, label string, priority int, confidence double, base boolean, first_word long, last_word long, "
             "suppressed boolean")

# a word is a run of digits, letters and characters beyond ASCII
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Scanner:
    """The rules, and which of them a set of words lets through."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.keywords = frozenset(w for r in rules for w in r.keywords)
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for rule in rules:
            # filed under its longest keyword, which is the rarest as a rule of thumb
            self.by_keyword.setdefault(max(rule.keywords, key=len), []).append(rule)

    def words(self, data: bytes) -> tuple[int, bytes, frozenset[bytes]]:
        """(number of words, the words between blanks, the keywords among them)."""
        count, parts, found = 0, [], set()
        for block in blocks(data):
            words = block.translate(_WORD_BYTES).split()
            count += len(words)
            found |= self.keywords.intersection(words)
            parts.append(b" ".join(words))
        return count, b" " + b" ".join(filter(None, parts)) + b" ", frozenset(found)

    def tried(self, found: frozenset[bytes]) -> list[Rule]:
        rules = [r for w in found for r in self.by_keyword.get(w, []) if found.issuperset(r.keywords)]
        return sorted(rules, key=lambda r: r.number)

    def scan(self, data: bytes) -> tuple[int, list[tuple]]:
        """(number of words, detections as (rule, first word, last word, suppressed), by place)."""
        count, text, found = self.words(data)
        hits = [(r, *m.span()) for r in self.tried(found) for m in r.pattern.finditer(text)] if found else []
        if not hits:
            return count, []
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        start = np.searchsorted(blanks, [h[1] for h in hits])
        end = np.searchsorted(blanks, [h[2] for h in hits]) - 1
        hidden = suppressed([h[0].priority for h in hits], [h[0].number for h in hits], start, end)
        return count, sorted(
            zip((h[0] for h in hits), start.tolist(), end.tolist(), hidden.tolist()), key=lambda x: (x[1], x[2], x[0].number))


def suppressed(priority: list[int], number: list[int], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which stretches lie inside an accepted one of the same or a better priority.

    Level by level of priority. Within a level, stretches are sorted by start and
    falling end, so that one inside another comes after it; an accepted one
    contains a stretch if the largest end among those that start no later reaches its end.
    """
    priority, hidden = np.asarray(priority), np.zeros(len(start), bool)
    for level in np.unique(priority):
        accepted = np.flatnonzero((priority < level) & ~hidden)
        accepted = accepted[np.argsort(start[accepted], kind="stable")]
        reach = np.maximum.accumulate(end[accepted]) if len(accepted) else np.zeros(0, int)
        here = np.flatnonzero(priority == level)
        here = here[np.lexsort((np.asarray(number)[here], -end[here], start[here]))]
        before = np.searchsorted(start[accepted], start[here], side="right") - 1
        by_better = (before >= 0) & (reach[before] >= end[here]) if len(accepted) else np.zeros(len(here), bool)
        # one that a better level hides lies inside it whole, and so does all that it contains
        longest = np.concatenate([[-1], np.maximum.accumulate(end[here])[:-1]])
        hidden[here] = by_better | (longest >= end[here])
    return hidden


@lru_cache(maxsize=4)
def _scanner(rules: str | None) -> Scanner:
    return Scanner(parsed(rules) if rules else parsed())


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: dict[str, Column] | None = None,
         rules: str | None = None) -> DataFrame:
    """(key, *keep, n_words, detections): one row per row of ``docs``.

    ``rules`` is a text of rules in the form of ``license_rules``; the built-in ones by default.
    """
    keep = keep or {}

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner, counts, sizes, hits = _scanner(rules), [], [0], []
        for data in as_bytes(batch.column(0)):
            count, found = scanner.scan(data)
            counts.append(count)
            hits += found
            sizes.append(len(hits))
        of = [h[0] for h in hits]
        fields = pa.StructArray.from_arrays([
            pa.array([r.number for r in of], pa.int32()), pa.array([r.label for r in of], pa.string()),
            pa.array([r.priority for r in of], pa.int32()), pa.array([r.confidence for r in of], pa.float64()),
            pa.array([r.base for r in of], pa.bool_()), pa.array([h[1] for h in hits], pa.int64()),
            pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.bool_()),
        ], [f.split()[0] for f in DETECTION.split(", ")])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), fields)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(counts, pa.int64()), lists], [*batch.schema.names[1:], "_n", "_d"])

    rows = docs.select(F.col(text).alias("_t"), F.col(key).alias("_k"), *[v.alias(f"_{i}") for i, v in enumerate(keep.values())])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    detection = ", ".join(f.replace(" ", ": ") for f in DETECTION.split(", "))
    return map_batches(rows, worker, f"{schema}, _n long, _d array<struct<{detection}>>").toDF(key, *keep, "n_words", "detections")


def base(detections: Column) -> Column:
    """Detections of the base phrases, suppressed or not."""
    return F.filter(detections, lambda d: d["base"])


def accepted(detections: Column) -> Column:
    return F.filter(detections, lambda d: ~d["suppressed"])


def labels(detections: Column) -> Column:
    """Distinct labels, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def score(detections: Column) -> Column:
    """How sure a statement is there: one minus the product over accepted labels of their doubt."""
    kept = accepted(detections)
    found = F.array_distinct(F.transform(kept, lambda d: d["label"]))
    best = F.transform(found, lambda name: F.array_max(
        F.transform(F.filter(kept, lambda d: d["label"] == name), lambda d: d["confidence"])))
    return 1 - F.aggregate(best, F.lit(1.0), lambda doubt, sure: doubt * (1 - sure))
