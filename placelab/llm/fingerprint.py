"""Document fingerprints by one-permutation MinHash.

The shingles of five words are hashed once. The highest bits of a hash choose one of
512 bins, every bin keeps its smallest hash, and an empty bin takes over the value of a
bin that a fixed series of hash functions of its number finds first (optimal
densification). A fingerprint stores four low-order bits per bin. Two texts are as alike
as their bins agree, less the agreement by chance.

Words are separated by ASCII white space and compared as they are. A text of fewer words
is one shingle; a text without words has the fingerprint "" and is like (1) other such
texts only. Null text counts as empty. ``against_next`` also fingerprints an edited copy
of every text, made with the next document in descending order of the id; rows of equal
id are ordered by a hash of the text and by the text, null ids come last. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelab.llm.common import Rolling, as_bytes, map_batches, map_partitions, mix, shingle_hashes, word_hashes
from placelab.session import materialize

WORDS, BINS, BITS, TRIES = 5, 512, 4, 64
_ROLLING = Rolling(41)
_CHANCE = 2.0**-BITS
_SALTS = mix(np.arange(1, BINS + 1, dtype=np.uint64) << np.uint64(32))


def _probes(block: int) -> np.ndarray:
    """For TRIES rounds: the bin that each bin looks into."""
    at = (np.arange(block * TRIES, (block + 1) * TRIES, dtype=np.uint64)[:, None] << np.uint64(16)) + np.arange(
        BINS, dtype=np.uint64
    )
    return (mix(at + np.uint64(0x9E3779B9)) % np.uint64(BINS)).astype(np.int64)


_FIRST_PROBES = _probes(0)


def densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill empty bins; one bin at least has to be full."""
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        probes = (_FIRST_PROBES if block == 0 else _probes(block))[:, empty]
        hits = full[probes]
        found = hits.any(0)
        first = hits.argmax(0)
        values[empty[found]] = values[probes[first[found], np.flatnonzero(found)]]
        empty, block = empty[~found], block + 1
    return values


def fingerprint(data: bytes) -> bytes:
    """Packed bits of all bins, empty for a text without words."""
    hashes = np.sort(shingle_hashes(word_hashes(data, _ROLLING), WORDS))
    if not len(hashes):
        return b""
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]] = hashes[first]
    full[bins[first]] = True
    # mixed with the bin, so that bins that took over the same value agree by chance independently
    values = mix(densified(values, full) + _SALTS).astype(np.uint8) & np.uint8((1 << BITS) - 1)
    return (values[0::2] << 4 | values[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated share of common shingles, from 0 to 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    agree = (np.count_nonzero((x & 15) == 0) + np.count_nonzero((x >> 4) == 0)) / BINS
    return max(0.0, (agree - _CHANCE) / (1 - _CHANCE))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as binary)."""
    kind = docs.schema[key].dataType.simpleString()

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t) for t in as_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["k", "fingerprint"])

    return map_batches(docs.select(key, text), worker, f"k {kind}, fingerprint binary").toDF(key, "fingerprint")


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_NAMES = ["k", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next", "part", "place", "body"]


def _compared(k, text: str, print_: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following).encode()
    changed_print = fingerprint(changed)
    return (k, len(text), hashlib.sha256(changed).hexdigest(), print_, changed_print,
            likeness(print_, changed_print), likeness(print_, next_print), None, None, None)


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next), one row per document.

    Texts are sorted once over the cluster; a task compares every row with its
    follower. Only the first and the last row of each task meet in a second step.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"k {kind}, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, "
              "near_next double, part int, place string, body string")

    def batch_of(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)

    def types_of(key_type: pa.DataType) -> list[pa.DataType]:
        return [key_type, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(),
                pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, types = TaskContext.get().partitionId(), None, None
        for batch in batches:
            types, rows = types_of(batch.column(0).type), []
            for k, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                body, print_ = data.decode(), fingerprint(data)
                if before is None:
                    rows.append((k, None, None, print_, None, None, None, part, "first", body))
                else:
                    rows.append(_compared(*before, body, print_))
                before = (k, body, print_)
            if rows:
                yield batch_of(rows, types)
        if before is not None:
            k, body, print_ = before
            yield batch_of([(k, None, None, print_, None, None, None, part, "last", body)], types)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            _compared(k, body or "", fp or b"", next_body or "", next_fp or b"")
            for k, fp, body, next_fp, next_body in zip(*[c.to_pylist() for c in batch.columns])
        ]
        return batch_of(rows, types_of(batch.column(0).type))

    order = [F.col(key).desc_nulls_last(), F.xxhash64(text), F.col(text)]
    ordered = docs.select(key, text).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    done = materialize(map_partitions(ordered, run, schema))
    # two rows per task: numbered by one small window
    ends = done.filter("place IS NOT NULL").select("k", "fp", "body", "part", "place")
    numbered = ends.withColumn("n", F.dense_rank().over(Window.orderBy("part")))
    size = F.max("n").over(Window.partitionBy())
    lasts = numbered.withColumn("size", size).filter("place = 'last'").withColumn("next", F.col("n") % F.col("size") + 1)
    firsts = numbered.filter("place = 'first'").select(F.col("n").alias("next"), F.col("fp").alias("next_fp"), F.col("body").alias("next_body"))
    joined = lasts.join(firsts, "next").select("k", "fp", "body", "next_fp", "next_body")
    bounds = map_batches(joined, finish, schema)
    return done.filter("place IS NULL").unionByName(bounds).drop("part", "place", "body").withColumnRenamed("k", key)
