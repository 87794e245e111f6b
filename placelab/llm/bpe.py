"""Byte-level BPE by monoid tree reduction.

A piece of text is encoded by halves. Two encoded neighbours are joined by encoding
a growing window around their boundary again, until the window's first and last token
are stable next to the tokens outside. Stable means that the two tokens, encoded as
one byte string, come out as the same two tokens: if that holds for all neighbours, no
merge crosses any of their boundaries in the whole string either, so the sequence is
the encoding of the whole. Decoding concatenates up a tree.

Pieces are the matches of the vocabulary's split pattern and are encoded separately.
Null text counts as empty and gives no ids; repeated rows and null ids stay; other
columns are ignored. A text of any length is read whole, piece by piece.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placelab.llm.common import as_text, map_batches

LEAF_BYTES, KEPT_BYTES, KEPT_ENTRIES, KEPT_CHUNKS, LEAF_IDS = 6, 32, 150_000, 500_000, 4096


def split_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with white space as Unicode's property, whatever ``\\s`` means to the library."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Chunks:
    """Cuts texts where no match of the split pattern reaches across: before a single space and a visible character."""

    def __init__(self, pattern: str) -> None:
        self.pattern = split_pattern(pattern)
        self.odd_space = regex.compile(r" (?:\p{White_Space}|$)")

    def __call__(self, text: str) -> list[str]:
        if self.odd_space.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + part for part in rest]


class ByteBpe:
    """Encoder for a rank table (bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def direct(self, data: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(data)
        if n <= 2:
            return (ranks[data],) if data in ranks else tuple(ranks[data[i : i + 1]] for i in range(n))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        alive = bytearray(b"\x01" * n)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (rank := ranks.get(data[i : after[end]])) is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            if (left := before[i]) >= 0 and (rank := ranks.get(data[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        found, i = [], 0
        while i < n:
            found.append(ranks[data[i : after[i]]])
            i = after[i]
        return tuple(found)

    def is_stable(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= KEPT_ENTRIES:
                self.stable.clear()
            known = self.stable[key] = self.remembered(self.bytes_of[left] + self.bytes_of[right]) == key
        return known

    def remembered(self, data: bytes) -> tuple[int, ...]:
        """``direct``, of short strings only once, up to a fixed number."""
        found = self.known.get(data)
        if found is None:
            found = self.direct(data)
            if len(data) <= KEPT_BYTES:
                if len(self.known) >= KEPT_ENTRIES:
                    self.known.clear()
                self.known[data] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the two byte strings behind ``left`` and ``right`` put together."""
        if not left or not right:
            return left + right
        if self.is_stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(len(left) - width, 0), min(width, len(right))
            window = self.remembered(b"".join([self.bytes_of[t] for t in left[a:] + right[:b]]))
            if (a == 0 or self.is_stable(left[a - 1], window[0])) and (
                b == len(right) or self.is_stable(window[-1], right[b])
            ):
                return left[:a] + window + right[b:]
            width *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Encode one piece by halves; the leaves of the tree are remembered."""
        if len(data) <= LEAF_BYTES:
            return self.remembered(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """A piece that is a token as a whole is that token."""
        rank = self.ranks.get(data)
        return self.encode(data) if rank is None else (rank,)

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """Leaves of some thousand ids are put together, then neighbours up the tree."""
        ids = np.asarray(ids, np.int64)
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, ids[i : i + LEAF_IDS].tolist())) for i in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Packed(dict):
    """Ids of chunks as packed 32-bit numbers; forgets everything at a fixed number of entries."""

    def __init__(self, bpe: ByteBpe, pattern: regex.Pattern) -> None:
        super().__init__()
        self.bpe, self.pattern = bpe, pattern

    def __missing__(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[0] == " " else chunk
        pieces = [chunk] if word.isalpha() else self.pattern.findall(chunk)  # letters are one match
        packed = array("i", [t for piece in pieces for t in self.bpe.encode_piece(piece.encode())]).tobytes()
        if len(chunk) <= KEPT_BYTES:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = packed
        return packed


_loaded: dict[str, ByteBpe] = {}
_packed: dict[tuple[str, str], tuple[Chunks, _Packed]] = {}


def load(path: str) -> ByteBpe:
    """The encoder of a rank file, loaded once per process."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            _loaded[path] = ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})
    return _loaded[path]


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    key = (path, pattern)
    if key not in _packed:
        chunks = Chunks(pattern)
        _packed[key] = (chunks, _Packed(load(path), chunks.pattern))
    chunks, packed = _packed[key]
    return np.frombuffer(b"".join([packed[c] for c in chunks(text)]), "<i4")


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every text. ``path`` names a rank file that all workers can open."""
    kind = docs.schema[key].dataType.simpleString()

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [encode_text(t, path, pattern) for t in as_text(batch.column(1))]
        ends = np.cumsum([0, *map(len, found)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["k", "ids"])

    return map_batches(docs.select(key, text), worker, f"k {kind}, ids array<int>").toDF(key, "ids")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the bytes behind the ids."""
    kind = encoded.schema[key].dataType.simpleString()

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, ids = load(path), batch.column(1)
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        texts = [bpe.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary())], ["k", "ids", "decoded"])

    return map_batches(encoded.select(key, "ids"), worker, f"k {kind}, ids array<int>, decoded binary").toDF(
        key, "ids", "decoded")
