"""Removal of repeated substrings by a hash-compared suffix sort.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. The
windows of a text (its stretches of ``width`` bytes) are told apart in three steps:

1. Every window names an anchor, the ``gram`` bytes with the smallest hash inside it;
   equal windows name equal anchors. Neighbouring windows with the same anchor form one
   row: the hash of the anchor and the hash of the bytes under all these windows.
   Anchors that occur once belong to windows that occur once and go.
2. Rows that agree in both hashes (128 bits) are copies: all their windows are repeated.
3. What is left are the edges of repeated passages. All their suffixes are sorted, by merging
   sorted runs; equal windows have their anchor at the same distance, so each anchor and
   distance is an order of its own. Two suffixes are compared at the end of their common
   extension, which a binary search over prefix hashes finds; neighbours in the order
   with ``width`` common bytes are compared byte by byte and are repeated.

An anchor with very many different surroundings is split before its sort: windows are cut
into blocks at fixed distances from the anchor, and only blocks with the same core (the
bytes that all windows of a block cover) can hold equal windows. Each core is sorted on its
own; one that still has too many surroundings is cut into halves, down to single windows.

Null text counts as empty; a text of less than ``width`` bytes keeps all of them; rows
that are equal are copies of each other; other columns are ignored by ``spans`` and kept
by ``remove``. Texts of any length are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelab.llm.common import Rolling, as_bytes, fresh, map_batches, map_partitions, mix
from placelab.session import discard, materialize

WIDTH, GRAM = 200, 40
HOT_CONTEXTS, CHUNK_WINDOWS, BLOCK_BYTES, BLOCK_WINDOWS = 1000, 200_000, 1 << 18, 16
_PLACE_BITS = np.uint64(21)
_PLACE = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
_ORDER, _CONTENT = Rolling(17), Rolling(29)
_CONTEXT = ("row", "first", "windows", "n", "body")


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every stretch of ``width`` values, by doubling."""
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(values) - width + 1], least[width - size :])
    return least


def _segments(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as (row, start, bytes), a block of some total size at a time; every window lies in one of them."""
    block, size = [], 0
    for row, data in enumerate(texts):
        for start in range(0, max(len(data) - width + 1, 0), BLOCK_BYTES):
            part = data[start : start + BLOCK_BYTES + width - 1]
            if size and size + len(part) > 2 * BLOCK_BYTES - 2 * width:
                yield block
                block, size = [], 0
            block.append((row, start, part))
            size += len(part)
    if block:
        yield block


def anchored(texts: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (text, first window, last window, anchor hash, content hash) for all windows."""
    for block in _segments(texts, width):
        data = np.frombuffer(b"".join(part for *_, part in block), np.uint8)
        lengths = np.array([len(part) for *_, part in block])
        begins = np.cumsum(lengths) - lengths
        order, content = _ORDER.prefix(data), _CONTENT.prefix(data)
        at = np.arange(len(data) - gram + 1)
        hashes = mix(_ORDER.stretch(order, at, at + gram))
        keyed = (hashes & ~_PLACE) | at.astype(np.uint64)
        anchors = (_sliding_min(keyed, width - gram + 1) & _PLACE).astype(np.int64)  # of the window at each place
        owner = np.repeat(np.arange(len(block)), lengths)[: len(anchors)]
        whole = owner == np.repeat(np.arange(len(block)), lengths)[width - 1 :]
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new & whole)
        ends = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole)
        bytes_ = mix(_CONTENT.stretch(content, first, ends + width) + (ends - first).astype(np.uint64))
        seg = owner[first]
        shift = np.array([start for _, start, _ in block])[seg] - begins[seg]
        yield (np.array([row for row, *_ in block])[seg], first + shift, ends + shift, hashes[anchors[first]], bytes_)


def common_extension(sums: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Equal bytes from places ``x`` and ``y`` on, at most ``limit``, by binary search over prefix hashes."""
    length, step = np.zeros(len(x), np.int64), 1 << (limit.bit_length() - 1)
    while step:
        fits = np.minimum(length + step, limit)
        same = _CONTENT.stretch(sums, x + length, x + fits) == _CONTENT.stretch(sums, y + length, y + fits)
        length = np.where(same, fits, length)
        step //= 2
    return length


def suffix_sort(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes within their groups (which are sorted), by bottom-up merging of sorted runs.

    All runs of a level merge at once: each suffix looks for its rank in the run beside
    its own by binary search. Suffixes are compared over ``limit`` bytes.
    """
    n = len(starts)
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")
    order, size, longest = np.arange(n), 1, int((end - begin).max(initial=0))
    place = np.arange(n)
    while size < longest:
        run = (place - begin) // size
        odd = run % 2 == 1
        low = np.where(odd, begin + (run - 1) * size, np.minimum(begin + (run + 1) * size, end))
        other = low.copy()
        high = np.minimum(low + size, end)
        suffix = starts[order]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            x, y = suffix[open_], suffix[middle]
            length = common_extension(sums, x, y, limit)
            last = np.minimum(length, limit - 1)
            a, b = data[x + last], data[y + last]
            behind = np.where(length >= limit, odd[open_], b < a)  # equal suffixes keep their order
            low[open_] = np.where(behind, middle + 1, low[open_])
            high[open_] = np.where(behind, high[open_], middle)
        target = begin + (run - odd) * size + (place - begin - run * size) + (low - other)
        merged = np.empty_like(order)
        merged[target] = order
        order, size = merged, 2 * size
    return order


def anchor_distances(contexts: list[bytes], width: int, gram: int) -> np.ndarray:
    """How far behind the start of each context the anchor of its first window is."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(contexts), 2048):
        data = np.frombuffer(b"".join(c[:width] for c in contexts[at : at + 2048]), np.uint8)
        grams = (np.arange(0, len(data), width)[:, None] + np.arange(width - gram + 1)).ravel()
        hashes = mix(_ORDER.stretch(_ORDER.prefix(data), grams, grams + gram))
        found.append((hashes & ~_PLACE).reshape(-1, width - gram + 1).argmin(1))
    return np.concatenate(found)


def repeated_windows(contexts: list[bytes], group: np.ndarray, windows: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Which windows occur twice or more among the contexts of their group; flat, context after context.

    All windows of a context have the same anchor, and so have all contexts of a group.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    begins = np.cumsum(lengths) - lengths
    first = np.repeat(begins, windows)
    starts = first + np.arange(len(first)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.repeat(group * width + anchor_distances(contexts, width, gram) + begins, windows) - starts
    sums = _CONTENT.prefix(data)
    found = np.zeros(len(starts), bool)
    if len(starts):
        rows = np.argsort(owner, kind="stable")
        rows = rows[suffix_sort(data, sums, starts[rows], owner[rows], width)]
        same = (owner[rows[1:]] == owner[rows[:-1]]) & (
            common_extension(sums, starts[rows[:-1]], starts[rows[1:]], width) >= width)
        pairs, views = np.flatnonzero(same), np.lib.stride_tricks.sliding_window_view(data, width)
        for at in range(0, len(pairs), 1 << 14):
            a, b = rows[pairs[at : at + (1 << 14)]], rows[pairs[at : at + (1 << 14)] + 1]
            equal = (views[starts[a]] == views[starts[b]]).all(1)
            if not equal.all():  # two strings of one hash: settle this chunk without hashes
                return _by_bytes(data, starts, owner, width)
            found[a] = found[b] = True
    return found


def _by_bytes(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    seen: dict[tuple[int, bytes], list[int]] = {}
    raw = data.tobytes()
    for i, (s, o) in enumerate(zip(starts.tolist(), owner.tolist())):
        seen.setdefault((o, raw[s : s + width]), []).append(i)
    found = np.zeros(len(starts), bool)
    for places in seen.values():
        if len(places) > 1:
            found[places] = True
    return found


def _runs(found: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of the runs of found windows, numbered within their context."""
    begins = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(windows)), windows)
    edge_in = found & ~np.concatenate([[False], found[:-1] & (owner[1:] == owner[:-1])])
    edge_out = found & ~np.concatenate([found[1:] & (owner[1:] == owner[:-1]), [False]])
    a, b = np.flatnonzero(edge_in), np.flatnonzero(edge_out)
    return owner[a], a - begins[owner[a]], b - begins[owner[a]]


def _text_key(key: str, text: str) -> Column:
    """Rows of equal key are equal rows, as far as 64 bits can tell."""
    return F.xxhash64(key, F.coalesce(F.col(text), F.lit("")))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(row, first, last): runs of repeated windows; ``row`` is the hash of key and text."""
    texts = docs.select(_text_key(key, text).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = batch.column(0).to_numpy(), []
        for owner, first, last, anchor, content in anchored(as_bytes(batch.column(1)), width, gram):
            # copies inside one text are settled here; one of them speaks for the text
            by = np.lexsort([first, content, anchor, owner])
            owner, first, last, anchor, content = (x[by] for x in (owner, first, last, anchor, content))
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(new)))
            within = np.repeat(times, times)[~new]
            found.append((rows[owner[new]], first[new], last[new], anchor[new], content[new], times))
            if len(within):
                again = np.flatnonzero(~new)
                again = again[np.lexsort([first[again], owner[again]])]
                gap = np.ones(len(again), bool)
                gap[1:] = (owner[again][1:] != owner[again][:-1]) | (first[again][1:] > last[again][:-1] + 1)
                head = np.flatnonzero(gap)
                tail = np.append(head[1:], len(again)) - 1
                zero = np.zeros(len(head), np.uint64)
                found.append((rows[owner[again][head]], first[again][head], last[again][tail], zero, zero, np.zeros(len(head), np.int64)))
        row, first, last, anchor, content, times = (
            np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 6
        return pa.RecordBatch.from_arrays([
            pa.array(row), pa.array(first), pa.array(last), pa.array(anchor.astype(np.uint64).view(np.int64)),
            pa.array(content.astype(np.uint64).view(np.int64)), pa.array(times.astype(np.int64))],
            ["row", "first", "last", "anchor", "content", "n"])

    rows = materialize(map_batches(
        texts, find, "row long, first long, last long, anchor long, content long, n long"))
    outside = rows.filter("n > 0")
    shared = (
        outside.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("content").alias("a"), F.max("content").alias("b"))
        .filter("total > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    )
    some = materialize(outside.join(shared, "anchor").unionByName(
        rows.filter("n = 0").withColumn("mixed", F.lit(False))))
    discard(rows)
    kinds = some.filter("n > 0").groupBy("anchor", "content").agg(
        F.sum("n").alias("n"), F.first("row").alias("row"), F.first("first").alias("first"),
        F.first("last").alias("last"), F.first("mixed").alias("mixed"))
    copies = kinds.filter("n > 1").select("anchor", "content")
    settled = some.filter("n > 0").join(copies, ["anchor", "content"], "left_semi").unionByName(some.filter("n = 0"))

    mixed = kinds.filter("mixed")
    open_anchors = mixed.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles"))
    edges = mixed.join(open_anchors.filter("singles > 0").drop("singles"), "anchor")
    contexts = materialize(edges.join(texts, "row").select(
        "anchor", "row", "first", (F.col("last") - F.col("first") + 1).alias("windows"), "n", "kinds",
        F.substring("body", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + width).cast("int")).alias("body"),
    ))

    usual = contexts.filter(F.col("kinds") <= HOT_CONTEXTS).select(F.col("anchor").alias("grp"), *_CONTEXT)
    hot = contexts.filter(F.col("kinds") > HOT_CONTEXTS).select(F.col("anchor").alias("grp"), *_CONTEXT)
    return settled.select("row", "first", "last").unionByName(_sorted(usual, width, gram)).unionByName(_split(hot, width, gram))


def _sorted(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, first, last): windows of ``contexts(grp, row, first, windows, n, body)`` that occur twice in their group.

    Windows of contexts with ``n`` above one are repeated anyway; they are sorted with the others, but not returned.
    """
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def close() -> pa.RecordBatch:
            named, row, first, windows, n, bodies = (
                [x for part in column for x in part] for column in zip(*kept))
            _, group = np.unique(np.array(named), return_inverse=True)
            windows, first, row = np.array(windows), np.array(first), np.array(row)
            found = repeated_windows(bodies, group, windows, width, gram)
            found &= np.repeat(np.array(n) == 1, windows)
            owner, a, b = _runs(found, windows)
            return pa.RecordBatch.from_arrays(
                [pa.array(row[owner]), pa.array(first[owner] + a), pa.array(first[owner] + b)], ["row", "first", "last"])

        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(groups)) + 1, len(groups)).tolist()
            at = 0
            for cut in cuts:
                if held > CHUNK_WINDOWS and (at or kept[-1][0][-1] != groups[0]):
                    yield close()
                    kept, held = [], 0
                if cut > at:
                    part = batch.slice(at, cut - at)
                    kept.append([c.to_pylist() for c in part.columns])
                    held += sum(kept[-1][3])
                at = cut
        if kept:
            yield close()

    return map_partitions(contexts.select("grp", *_CONTEXT).repartition("grp").sortWithinPartitions("grp"), sort,
                          "row long, first long, last long")


def _blocks(contexts: DataFrame, size: int, width: int, gram: int) -> DataFrame:
    """(grp, x, y, row, first, windows, n, body): the contexts cut at fixed distances from their anchor.

    A block has at most ``size`` windows; ``grp`` hashes the old group, the distance and the
    bytes that all windows at these distances cover, ``x`` and ``y`` the windows of the block.
    """
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        grp, row, first, windows, n = (batch.column(i).to_numpy() for i in range(5))
        bodies = as_bytes(batch.column(5))
        data = np.frombuffer(b"".join(bodies), np.uint8)
        lengths = np.array([len(b) for b in bodies], np.int64)
        begins = np.cumsum(lengths) - lengths
        order, content = _ORDER.prefix(data), _CONTENT.prefix(data)
        owner = np.repeat(np.arange(len(bodies)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        distance = anchor_distances(bodies, width, gram)[owner] - place
        block = distance // size
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(owner)))
        o, a, b = owner[head], place[head], block[head]
        start, end = begins[o] + a, begins[o] + a + count - 1 + width
        core = start + distance[head] - b * size
        inner = mix(_CONTENT.stretch(content, core, core + width - size + 1) ^ mix(b.astype(np.uint64)))
        group = mix(inner + mix(grp[o].view(np.uint64))).view(np.int64)
        x, y = (mix(h.stretch(sums, start, end) + count.astype(np.uint64)).view(np.int64) for h, sums in ((_ORDER, order), (_CONTENT, content)))
        slices = [data[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (group, x, y, row[o], first[o] + a, count, n[o])] + [pa.array(slices, pa.binary())],
            ["grp", "x", "y", *_CONTEXT])

    return map_batches(contexts.select("grp", *_CONTEXT), cut,
                       "grp long, x long, y long, row long, first long, windows long, n long, body binary")


def _split(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, first, last) of repeated windows, for anchors with too many surroundings for one task.

    Blocks that agree are copies. Of the others, those of one core are sorted together, if
    at most HOT_CONTEXTS of them differ; the rest is cut into halves. A single window is all
    core, so the last cut leaves nothing but copies.
    """
    size, answers = min(BLOCK_WINDOWS, 1 << max(width.bit_length() - 2, 0)), []
    while True:
        parts = materialize(_blocks(contexts, size, width, gram))
        kind = ["grp", "x", "y"]
        kinds = parts.groupBy(*kind).agg(F.sum("n").alias("n"))
        answers.append(parts.filter("n = 1").join(kinds.filter("n > 1").select(*kind), kind, "left_semi").select(
            "row", "first", (F.col("first") + F.col("windows") - 1).alias("last")))
        mixed = kinds.groupBy("grp").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).filter(
            "kinds > 1 AND singles > 0").select("grp", "kinds")
        one = parts.join(mixed, "grp").groupBy(*kind).agg(
            F.sum("n").alias("n"), F.first("kinds").alias("kinds"),
            F.first(F.struct("row", "first", "windows", "body")).alias("one"))
        left = materialize(one.select(
            "grp", "one.row", "one.first", "one.windows", "n", "one.body", "kinds"))
        crowded = left.filter(F.col("kinds") > HOT_CONTEXTS)
        if size == 1 or crowded.isEmpty():
            answers.append(_sorted(left, width, gram))
            break
        answers.append(_sorted(left.filter(F.col("kinds") <= HOT_CONTEXTS), width, gram))
        contexts, size = crowded, size // 2
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    return found


def _cut(data: bytes, found: list[dict] | None, width: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if not found:
        return data, 0, 0
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, [s["first"] for s in found], 1)
    np.add.at(edges, [min(s["last"] + width, len(data)) for s in found], -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _with_spans(docs: DataFrame, mark: str, key: str, text: str, width: int, gram: int, into: str = "_spans") -> DataFrame:
    found = spans(docs.select(key, text), key, text, width, gram).groupBy("row").agg(
        F.collect_list(F.struct("first", "last")).alias(into)).withColumnRenamed("row", mark)
    return docs.withColumn(mark, _text_key(key, text)).join(found, mark, "left").drop(mark)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): ``kept`` is what is left, as bytes."""
    kind = docs.schema[key].dataType.simpleString()
    rows = _with_spans(docs.select(key, text), "_row", key, text, width, gram).select(
        key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"), "_spans")

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(1))
        kept, gone, runs = zip(*[_cut(t, s, width) for t, s in zip(texts, batch.column(2).to_pylist())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()),
             pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(rows, worker, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("k", key)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, size: str | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; bytes of characters that were cut go too.

    ``size`` names a column of text lengths in code points to be brought up to date. A null text stays null.
    """
    rows = _with_spans(docs, fresh(docs, "_row"), key, text, width, gram, fresh(docs, "_spans"))
    place, at = [c.lower() for c in docs.columns].index(text.lower()), len(docs.columns)

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [
            None if t is None else (t if not s else _cut(t.encode(), s, width)[0].decode("utf-8", "ignore"))
            for t, s in zip(batch.column(place).to_pylist(), batch.column(at).to_pylist())
        ]
        columns = [pa.array(new, pa.string()) if i == place else batch.column(i) for i in range(at)]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:at])

    done = map_batches(rows, worker, T.StructType(docs.schema.fields))
    return done.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size else done
