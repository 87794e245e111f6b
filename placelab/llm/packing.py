"""Hierarchical multi-length packing of token sequences, without padding but for the last one.

Documents are routed by length to tiers of context sizes (512, 1024, 2048). A window of a
tier starts with one of its longest pieces; its gap is filled with the longest pieces
that fit, from its own and from shorter tiers, and closed exactly by cutting one. Longer
documents fill whole windows of the largest tier first. Full windows of one tier are
dealt to step groups of equal token numbers.

Every task packs what it reads; at its end it keeps less than one smallest window of
tokens, which go on to the next level, some thousand pieces to a task. The one window that is
left in the end is padded to the largest size.

Null text counts as empty: its document is the end id alone. Null and repeated ids are
packed like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from placelab.llm.common import as_text, map_partitions
from placelab.session import materialize

TIERS = (512, 1024, 2048)
GROUP_WINDOWS, POOL_TOKENS, RESTS_PER_TASK = 8, 1 << 20, 4096
PART_CHARS, EMIT_ROWS = 1 << 20, 8192

_tokenizers: dict[str, tuple] = {}


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _tokenizer(path: str, pattern: str) -> tuple:
    """(library tokenizer, search for special strings, encoder with the same merges)."""
    if path not in _tokenizers:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = [t.content for t in loaded.get_added_tokens_decoder().values()]
        value, vocabulary = _byte_values(), model["vocab"]
        ranks = {bytes(value[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("the ids of the vocabulary do not follow its merges")
        found = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        encoder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _tokenizers[path] = (loaded, found, encoder)
    return _tokenizers[path]


#: No match of the split pattern reaches across this place.
_BETWEEN_WORDS = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that are encoded for themselves."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = _BETWEEN_WORDS.search(text, at + PART_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def tokenize(texts: list[str], path: str, pattern: str, end_id: int) -> list[bytes]:
    """Ids of every text, as the tokenizer file's library gives them, and the end id, as packed 32-bit numbers.

    The merges are run by a faster encoder with the ranks of the same file. A text that holds the
    string of a special token goes to the library itself, which gives that string its own id.
    """
    loaded, special, encoder = _tokenizer(path, pattern)
    end, found = array("I", [end_id]).tobytes(), []
    for text in texts:
        if special(text):
            ids = [loaded.encode(text, add_special_tokens=False).ids]
        else:
            ids = map(encoder.encode_ordinary, _parts(text))
        found.append(b"".join(array("I", part).tobytes() for part in ids) + end)
    return found


class Packer:
    """Fills windows from pools of pieces; a piece is (length, order, doc, start, ids, doc_tokens)."""

    def __init__(self, numbering: int, tiers: tuple[int, ...]) -> None:
        self.tiers, self.number, self.order = tiers, numbering, 0
        self.pools: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.pooled = 0
        self.dealt = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def _tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def put(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        """Cut whole windows of the largest tier off, and route the rest."""
        largest, at, n = self.tiers[-1], 0, len(ids) // 4
        while n - at >= largest:
            self._close(largest, [(largest, 0, doc, start + at, ids[4 * at : 4 * (at + largest)], doc_tokens)])
            at += largest
        if at < n:
            self.order += 1
            piece = (n - at, self.order, doc, start + at, ids[4 * at :], doc_tokens)
            bisect.insort(self.pools[self._tier(n - at)], piece, key=lambda p: p[:2])
            self.pooled += n - at

    def _take(self, tier: int, place: int) -> tuple:
        piece = self.pools[tier].pop(place)
        self.pooled -= piece[0]
        return piece

    def _fitting(self, gap: int) -> tuple | None:
        """The longest piece of at most ``gap`` tokens."""
        for tier in reversed(self.tiers):
            place = bisect.bisect_right(self.pools[tier], gap, key=lambda p: p[0]) - 1
            if place >= 0:
                return self._take(tier, place)
        return None

    def _cut(self, gap: int) -> tuple:
        """The first ``gap`` tokens of the shortest piece that is longer."""
        for tier in self.tiers:
            place = bisect.bisect_right(self.pools[tier], gap, key=lambda p: p[0])
            if place < len(self.pools[tier]):
                length, order, doc, start, ids, tokens = self._take(tier, place)
                self.put(doc, start + gap, ids[4 * gap :], tokens)
                return (gap, order, doc, start, ids[: 4 * gap], tokens)
        raise AssertionError("called with enough tokens pooled")

    def _close(self, tier: int, pieces: list[tuple]) -> None:
        offset, group = 0, self.dealt[tier] * tier // (GROUP_WINDOWS * self.tiers[-1])
        for length, _, doc, start, ids, tokens in pieces:
            self.rows.append((
                doc, start, length, zlib.crc32(ids), tokens, self.number, offset, tier,
                (self.number >> 32 << 32) | (self.tiers.index(tier) << 28) | group, None,
            ))
            offset += length
        self.number += 1
        self.dealt[tier] += 1

    def fill(self, keep: int) -> None:
        """Close windows until at most ``keep`` tokens, or less than the smallest window, are pooled."""
        while self.pooled > keep and self.pooled >= self.tiers[0]:
            tier = max((t for t in self.tiers if self.pools[t]), default=None)
            tier = max(t for t in self.tiers if t <= max(tier, self.tiers[0]) and t <= self.pooled)
            pieces, gap = [], tier
            while gap:
                piece = self._fitting(gap) or self._cut(gap)
                pieces.append(piece)
                gap -= piece[0]
            self._close(tier, pieces)

    def finish(self, last: bool) -> None:
        """Close what can be closed; the rest becomes one padded window or is handed on with its ids."""
        self.fill(0)
        rest = [p for t in self.tiers for p in self.pools[t]]
        if last and rest:
            self._close(self.tiers[-1], rest)
        elif rest:
            self.rows += [
                (doc, start, n, None, tokens, None, None, None, None, ids) for n, _, doc, start, ids, tokens in rest
            ]
        self.pools = {t: [] for t in self.tiers}


def _schema(kind: str) -> str:
    return (
        f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "tier int, step_group long, rest binary"
    )


def _emitted(packer: Packer, types: list[pa.DataType], least: int) -> Iterator[pa.RecordBatch]:
    if packer.rows and len(packer.rows) >= least:
        columns = [pa.array(c, t) for c, t in zip(zip(*packer.rows), types)]
        packer.rows = []
        yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(types))])


def _types(doc: pa.DataType) -> list[pa.DataType]:
    return [doc, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()]


def _named(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    names = [part.strip().split(" ")[0] for part in _schema(kind).split(", ")]
    for batch in batches:
        yield batch.rename_columns(names)


def pack(
    docs: DataFrame, path: str, pattern: str, end_id: int = 1, key: str = "doc_id", text: str = "text",
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row per piece: its document, place and checksum there, and its sequence and place there.

    ``path`` names a tokenizer file that all workers can open. ``tier`` is the window
    size, ``step_group`` numbers groups of windows with equal token numbers.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches, level: int, last: bool, pieces) -> Iterator[pa.RecordBatch]:
        packer = Packer((level << 56) | (TaskContext.get().partitionId() << 32), tiers)
        types = None
        for batch in batches:
            types = types or _types(batch.column(0).type)
            for piece in pieces(batch):
                packer.put(*piece)
                if packer.pooled > POOL_TOKENS:
                    packer.fill(POOL_TOKENS // 2)
            yield from _named(_emitted(packer, types, EMIT_ROWS), kind)
        if types:
            packer.finish(last)
            yield from _named(_emitted(packer, types, 1), kind)

    def from_texts(batch):
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc, ids in zip(part.column(0).to_pylist(), tokenize(as_text(part.column(1)), path, pattern, end_id)):
                yield doc, 0, ids, len(ids) // 4

    def from_rests(batch):
        yield from zip(*[c.to_pylist() for c in batch.columns])

    table = materialize(map_partitions(
        docs.select(key, text), lambda batches: run(batches, 0, False, from_texts), _schema(kind)))
    result, level, last, tasks = table.filter("rest IS NULL"), 0, False, 1 << 40
    while not last:
        rests = table.filter("rest IS NOT NULL").select("doc", "start", "rest", "doc_tokens")
        tasks = min(-(-rests.count() // RESTS_PER_TASK), tasks // 2)
        level, last = level + 1, tasks <= 1
        rests = rests.coalesce(1) if last else rests.repartition(tasks)
        table = materialize(map_partitions(
            rests, lambda batches, n=level, end=last: run(batches, n, end, from_rests), _schema(kind)))
        result = result.unionByName(table.filter("rest IS NULL"))
    return result.drop("rest").withColumnRenamed("doc", key)
