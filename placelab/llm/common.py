"""What the text operators share: splits by id, Arrow maps over texts, and polynomial hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelab.session import ship_package

#: ASCII white space: what separates words in every operator here.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a Java pattern.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
BLOCK_CHARS, SLICE_ROWS = 1 << 20, 1024


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(
    df: DataFrame, worker: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply ``worker`` to every Arrow batch, in slices: memory follows the slice."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield worker(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def map_partitions(
    df: DataFrame, worker: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply ``worker`` to the stream of batches of every partition."""
    ship_package(df.sparkSession)
    return df.mapInArrow(worker, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a byte string, from prefix sums.

    Bytes are first replaced by random 64-bit values. Stretches of less than 2,000
    bytes have no systematic collisions in this family.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """One value per position, for ``stretch``."""
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: bytes) -> bytes:
    return data.lower()  # of bytes: A-Z only


def blocks(data: bytes, size: int = BLOCK_CHARS) -> Iterator[bytes]:
    """``data`` cut at white space into blocks of about ``size`` bytes, so that no word is cut."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: bytes, rolling: Rolling) -> np.ndarray:
    """A 64-bit hash of every word of ``data``, in order."""
    found = []
    for block in blocks(data):
        b = np.frombuffer(block, np.uint8)
        edge = np.diff(np.concatenate([[True], _IS_SPACE[b], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            sums = rolling.prefix(b)
            found.append(mix(rolling.stretch(sums, start, end) + (end - start).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words; of the whole sequence if there are fewer, none of nothing."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - width + 1 + j]
    return mix(total)


def public_path(name: str) -> str:
    """The place of a public vocabulary file, which every worker has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
