"""SimHash near-duplicates by vantage-point trees.

A fingerprint has a bit set where more than half of the shingles' hashes have it.
Distinct fingerprints are spread over shards by the upper levels of a vantage-point tree:
a node sends what lies within its radius to the left, the rest to the right, and a copy
of everything within the link distance behind the boundary to the left too. By the
triangle inequality every linked pair meets in one shard. There a vantage-point tree
of the shard's own fingerprints is searched, and linked fingerprints are joined at once,
so a shard hands on one link per fingerprint and never its pairs. The components of
these links over all shards are the groups.

The upper tree is made from a bounded sample; it decides the balance, not the result.
Null text counts as empty: fingerprint zero, linked like any other. Null ids have a
fingerprint but no say in naming a component unless no other id is there; repeated rows
stay; other columns are ignored by ``components`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelab.llm.common import (
    SLICE_ROWS, Rolling, as_bytes, blocks, fresh, lower_ascii, map_batches, map_partitions, mix, shingle_hashes, word_hashes,
)
from placelab.operators.components import connected_components
from placelab.session import discard, materialize

WORDS, DISTANCE, HASH_SEED = 3, 2, 42
SHARD_SIZE, SAMPLE_SIZE, LEAF_SIZE = 4096, 32_768, 512
COMPARED_WORDS, BLOCK_ROWS = 5, 256
#: One text of so many is counted for the common shingles; they decide the work, not the result.
COUNTED, LEAST_COUNTED, MAX_COMMON = 16, 6, 100_000
SEEN_TEXTS = 1_000_000
#: Texts are looked up in a bitmap of this size before they travel; it decides the work, not the result.
FILTER_BITS = 1 << 23
_ROLLING = Rolling(53)
_WEIGHTS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def shingle_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    """How many hashes have each bit, highest first."""
    raw = np.array(hashes, np.uint64).byteswap().view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text; long texts are read in blocks."""
    total, n, carry, digest, seen = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest, 0
    for block in blocks(lower_ascii(data)):
        found = block.split()
        seen += len(found)
        joined = carry + found
        shingles = [b" ".join(joined[i : i + words]) for i in range(len(joined) - words + 1)]
        if shingles:
            total += shingle_counts([digest(s, HASH_SEED) for s in shingles])
            n += len(shingles)
        carry = joined[-(words - 1) :] if words > 1 else []
    if seen and not n:
        total, n = shingle_counts([digest(b" ".join(carry), HASH_SEED)]), 1
    return int(_WEIGHTS[2 * total > n].sum(dtype=np.uint64)) if n else 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def distances(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): fp is the 64-bit fingerprint as a signed number."""
    kind = docs.schema[key].dataType.simpleString()

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in as_bytes(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(found))], ["k", "fp"])

    return map_batches(docs.select(key, text), worker, f"k {kind}, fp long").toDF(key, "fp")


class Tree:
    """A vantage-point tree over distinct fingerprints: nodes are (vantage, radius, left, right) or leaf numbers."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaves: list[np.ndarray] = []
        self.root = self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        if len(rows) > leaf:
            # of a few candidates, the vantage point whose distances are spread the most: its boundary is thinnest
            tried = rows[:: max(len(rows) // 8, 1)][:8]
            spread = [distances(points[rows], points[t]).astype(float).std() for t in tried]
            vantage = int(points[tried[int(np.argmax(spread))]])
            away = distances(points[rows], vantage)
            for radius in (int(np.median(away)), int(np.median(away)) - 1):
                near = away <= radius
                if near.any() and not near.all():
                    return (vantage, radius, self._build(points, rows[near], leaf), self._build(points, rows[~near], leaf))
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def homes(self, points: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For every leaf reached: its number, the rows that live there, the rows that only look for partners there."""
        found = []

        def walk(node, living: np.ndarray, looking: np.ndarray) -> None:
            if not isinstance(node, tuple):
                found.append((node, living, looking))
                return
            vantage, radius, left, right = node
            a = distances(points[living], vantage).astype(int)
            b = distances(points[looking], vantage).astype(int)
            walk(left, living[a <= radius], np.concatenate([
                living[(a > radius) & (a <= radius + reach)], looking[b <= radius + reach]]))
            walk(right, living[a > radius], looking[b > radius - reach])

        walk(self.root, np.arange(len(points)), np.zeros(0, np.int64))
        return found


class Links:
    """Joins rows into groups; the group of a row is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent[rows]
        while (self.parent[at] != at).any():
            at = self.parent[at]
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link_shard(points: np.ndarray, living: np.ndarray, reach: int) -> np.ndarray:
    """The group (a row) of every point, by all pairs within ``reach`` of which one at least lives in the shard."""
    links = Links(len(points))
    own = np.flatnonzero(living)
    if len(own):
        tree = Tree(points[own], LEAF_SIZE)
        order = np.concatenate([own, np.flatnonzero(~living)])
        spread = points[order]

        def walk(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, tuple):
                vantage, radius, left, right = node
                away = distances(spread[rows], vantage).astype(int)
                walk(left, rows[away <= radius + reach])
                walk(right, rows[away > radius - reach])
                return
            members = tree.leaves[node]
            for at in range(0, len(rows), LEAF_SIZE):
                part = rows[at : at + LEAF_SIZE]
                i, j = np.nonzero(np.bitwise_count(spread[part][:, None] ^ spread[members][None]) <= reach)
                different = part[i] != members[j]
                links.join(order[part[i[different]]], order[members[j[different]]])

        walk(tree.root, np.arange(len(spread)))
    return links.roots(np.arange(len(points)))


def linked(prints: DataFrame, reach: int = DISTANCE) -> DataFrame:
    """Links (u, v) of the distinct fingerprints ``prints(fp)`` that join exactly the groups of pairs within ``reach``."""
    spark = prints.sparkSession
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_SIZE + 1).toArrow().column("fp").to_numpy()
    total = len(sample) if len(sample) <= SAMPLE_SIZE else prints.count()
    tree = Tree(sample[:SAMPLE_SIZE].view(np.uint64), max(int(SHARD_SIZE * min(len(sample), SAMPLE_SIZE) / max(total, 1)), 16))

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = batch.column(0).to_numpy()
        shards, rows, lives = [], [], []
        for leaf, living, looking in tree.homes(points.view(np.uint64), reach):
            shards.append(np.full(len(living) + len(looking), leaf))
            rows += [living, looking]
            lives.append(np.arange(len(living) + len(looking)) < len(living))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(shards).astype(np.int32)), pa.array(points[np.concatenate(rows)]),
            pa.array(np.concatenate(lives))], ["shard", "fp", "living"])

    def search(batches):
        open_shard, kept = None, []

        def close():
            points = np.concatenate([p for p, _ in kept])
            groups = link_shard(points.view(np.uint64), np.concatenate([x for _, x in kept]), reach)
            moved = groups != np.arange(len(points))
            return pa.RecordBatch.from_arrays([pa.array(points[moved]), pa.array(points[groups[moved]])], ["u", "v"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            points, lives = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), bool)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != open_shard and kept:
                    yield close()
                    kept = []
                open_shard = shards[a]
                kept.append((points[a:b], lives[a:b]))
        if kept:
            yield close()

    routed = map_batches(prints.select("fp"), route, "shard int, fp long, living boolean")
    shards = routed.repartition("shard").sortWithinPartitions("shard")
    return map_partitions(shards, search, "u long, v long").distinct()


def components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, reach: int = DISTANCE,
) -> DataFrame:
    """(key, fp, component_id): the smallest id that is reachable over links, one row per input row."""
    found = materialize(fingerprints(docs, key, text, words))
    prints = materialize(found.groupBy("fp").agg(F.min(key).alias("least")))
    groups = connected_components(linked(prints.select("fp"), reach))
    named = prints.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "component").select("fp", "component_id")
    return found.join(of_print, "fp").select(key, "fp", "component_id")


def shingles(data: bytes) -> np.ndarray:
    """Distinct hashes of the runs of COMPARED_WORDS words, in order."""
    return np.unique(shingle_hashes(word_hashes(lower_ascii(data), _ROLLING), COMPARED_WORDS))


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a text in one order for all texts, so many that similar texts share one of them.

    Of n shingles, a text that shares ``similarity`` of all shingles with another lacks
    less than this prefix in the other; so each of the two has a shared one in its
    prefix, and the first shared one is in both. ``common`` shingles come last, the
    rarest of them first.
    """
    places = np.minimum(np.searchsorted(common["shingle"], hashes), max(len(common) - 1, 0))
    weights = np.where(common["shingle"][places] == hashes, common["count"][places], 0) if len(common) else np.zeros(len(hashes), np.int64)
    n = len(hashes)
    return hashes[np.lexsort((hashes, weights))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]] if n else hashes


def common_shingles(texts: DataFrame) -> np.ndarray:
    """(shingle, count) of shingles that are frequent in a fixed share of ``texts(node, body)``, sorted by shingle."""
    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in as_bytes(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["shingle"])

    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).select("body")
    counts = map_batches(sample, worker, "shingle long").groupBy("shingle").agg(F.count("*").alias("count"))
    top = counts.filter(F.col("count") >= LEAST_COUNTED).orderBy(F.desc("count"), "shingle").limit(MAX_COMMON).toArrow()
    found = np.zeros(top.num_rows, [("shingle", np.uint64), ("count", np.int64)])
    found["shingle"], found["count"] = top.column("shingle").to_numpy().view(np.uint64), top.column("count").to_numpy()
    return np.sort(found, order="shingle")


def new_texts(batches: Iterator[pa.RecordBatch], asked: np.ndarray | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Nodes and texts of the batches (node, body) in slices, without copies, which would only give the same rows again.

    With ``asked``, a bitmap of ``bitmap``, only those whose bit is set.
    """
    seen = set()
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(begin, SLICE_ROWS)
            if asked is not None:
                places = (some.column(0).to_numpy() % FILTER_BITS).astype(np.uint64)
                some = some.filter(pa.array((asked[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1))
            nodes, bodies = [], []
            for node, t in zip(some.column(0).to_pylist(), as_bytes(some.column(1))):
                if node not in seen:
                    if len(seen) >= SEEN_TEXTS:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    bodies.append(t)
            if nodes:
                yield nodes, bodies


def bitmap(nodes: DataFrame) -> np.ndarray:
    """Words of a bitmap of FILTER_BITS: the bit at ``node`` modulo its size is set for all of ``nodes(node)``."""
    place = F.pmod("node", F.lit(FILTER_BITS))
    words = nodes.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    found = np.zeros(FILTER_BITS // 64, np.uint64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return found


def prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """(part, node, at, size, n): the shingles in the prefixes of two or more of ``texts(node, body)``.

    ``at`` is the place in the prefix, ``size`` the number of shingles of the text, ``n`` that of texts.
    """
    common = common_shingles(texts)

    def worker(batches):
        for nodes, bodies in new_texts(batches):
            found, sizes = [], []
            for t in bodies:
                hashes = shingles(t)
                found.append(prefix(hashes, common, similarity))
                sizes.append(len(hashes))
            n = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), n)),
                pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in n])),
                pa.array(np.repeat(np.array(sizes, np.int32), n))], ["part", "node", "at", "size"])

    rows = map_partitions(texts.select("node", "body"), worker, "part long, node long, at int, size int")
    once = rows.repartition("part").dropDuplicates(["part", "node"])
    return once.withColumn("n", F.count("*").over(Window.partitionBy("part"))).filter("n > 1")


def halves(hashes: np.ndarray) -> np.ndarray:
    """What is compared of the shingles of a text."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap of one to two bits per shingle: whether an odd number of ``found`` has that place.

    Every shingle that only one of two texts has changes one bit, so the texts differ in
    at least as many shingles as their bitmaps in bits. A bitmap is brought to half its
    size by XOR of its halves.
    """
    width = max(64, 1 << int(len(found)).bit_length())
    return np.packbits((np.bincount(found & np.uint32(width - 1), minlength=width) & 1).astype(np.uint8))


def marks(texts: DataFrame) -> DataFrame:
    """(node, size, bits): number of shingles and ``parity`` of each of ``texts(node, body)``."""
    def worker(batches):
        for nodes, bodies in new_texts(batches):
            sets = [halves(shingles(t)) for t in bodies]
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int32()),
                pa.array([parity(x).tobytes() for x in sets], pa.binary())], ["node", "size", "bits"])

    return map_partitions(texts.select("node", "body"), worker, "node long, size int, bits binary").dropDuplicates(["node"])


def maybe_alike(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """``pairs(u, v)`` without those whose bitmaps in ``marked(node, size, bits)`` show that they share less."""
    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        for both, x, y in zip(sizes.tolist(), as_bytes(batch.column(4)), as_bytes(batch.column(5))):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            while len(a) != len(b):
                a, b = (b, a) if len(a) < len(b) else (a, b)
                a = a[: len(a) // 2] ^ a[len(a) // 2 :]
            most = (both - int(np.bitwise_count(a ^ b).sum())) / 2
            kept.append(most * (1 + similarity) >= similarity * both - 1e-6)
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    sides = pairs.join(marked.select(F.col("node").alias("u"), F.col("size").alias("n"), F.col("bits").alias("x")), "u").join(
        marked.select(F.col("node").alias("v"), F.col("size").alias("m"), F.col("bits").alias("y")), "v")
    return map_batches(sides.select("u", "v", "n", "m", "x", "y"), compare, "u long, v long")


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose ``texts(node, body)`` share that much of their shingles."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked = bitmap(needed)

    def pack(batches):
        for nodes, bodies in new_texts(batches, asked):
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.int64()), pa.array([halves(shingles(t)).tobytes() for t in bodies], pa.binary())],
                ["node", "words"])

    sets = materialize(map_partitions(texts.select("node", "body"), pack, "node long, words binary").join(
        needed, "node", "left_semi").dropDuplicates(["node"]))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))):
            a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            common = len(np.intersect1d(a, b))
            kept.append(common >= similarity * (len(a) + len(b) - common))
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    sides = pairs.join(sets.select(F.col("node").alias("u"), F.col("words").alias("x")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("words").alias("y")), "v").select("u", "v", "x", "y")
    links = materialize(map_batches(sides, compare, "u long, v long"))
    discard(sets)
    return links


def _enough(similarity: float) -> Column:
    """Whether two texts whose first shared shingle is at places ``at`` and ``other_at`` can be similar."""
    left = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    return left * (1 + similarity) >= similarity * (F.col("size") + F.col("other_size")) - 1e-6


def pairs_apart(both: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of rows of ``both(part, node, at, size)`` that share a part but no group of ``groups(node, component)``.

    Parts within one group have none. The others are cut into blocks of about
    BLOCK_ROWS rows, and every block meets every block of its part.
    """
    rows = both.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("part").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows"),
    ).filter("least <> most").select("part", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(mixed, "part").withColumn("own", F.pmod(F.xxhash64("node", "part"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("part", F.col("own").alias("i"), every.alias("j"), "node", "component", "at", "size")
    right = rows.select("part", every.alias("i"), F.col("own").alias("j"), *[
        F.col(c).alias(f"other_{c}") for c in ("node", "component", "at", "size")])
    return left.join(right, ["part", "i", "j"]).filter(F.col("component") < F.col("other_component")).filter(
        _enough(similarity)).select(F.greatest("node", "other_node").alias("u"), F.least("node", "other_node").alias("v")).distinct()


def similar(texts: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that, with ``known(u, v)``, join exactly the ``texts(node, body)`` that share that much of their shingles.

    Texts that share a shingle of their prefixes are first compared with two texts of
    that shingle: the one that shares most with others, which is what copies were made
    from, and a fixed one. Then all pairs are compared that share a shingle of their
    prefixes and are not yet in one group, so no similar pair is left out. Bitmaps
    settle most of the pairs that are not similar; only for the others whole sets travel.
    """
    marked = materialize(marks(texts))
    both = materialize(prefixes(texts, similarity))
    degrees = both.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = both.join(degrees, "node")
    middle = F.struct("node", "at", "size")
    middles = ranked.groupBy("part").agg(F.max_by(middle, F.struct("degree", "node")).alias("most"), F.min(middle).alias("least"))
    met = both.join(middles, "part").select("node", "at", "size", F.explode(F.array("most", "least")).alias("m")).select(
        "node", "at", "size", *[F.col(f"m.{c}").alias(f"other_{c}") for c in ("node", "at", "size")])
    pairs = materialize(maybe_alike(met.filter("node <> other_node").filter(_enough(similarity)).select(
        F.greatest("node", "other_node").alias("u"), F.least("node", "other_node").alias("v")).distinct(), marked, similarity))
    links = alike(pairs, texts, similarity)
    apart = pairs_apart(both, connected_components(known.unionByName(links)), similarity)
    rest = materialize(maybe_alike(apart, marked, similarity))
    more = alike(rest, texts, similarity)
    discard(both, marked, pairs, rest)
    return links.unionByName(more)


def keep_first(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, reach: int = DISTANCE,
    similarity: float | None = None,
) -> DataFrame:
    """One row of every group, with all its columns: that of the smallest id, ids before nulls.

    Groups are the components of ``components``. With ``similarity``, groups are also
    joined of which any two rows share that much of their runs of five words; all such pairs
    are found, by a prefix filter, and compared shingle by shingle.
    Rows that share an id are told apart by a hash of their text; of equal rows one stays.
    """
    row = fresh(docs, "_row")
    name = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    named = docs.select(name.alias("name"), F.col(text).alias("body"))
    found = components(named, "name", "body", words, reach)
    if similarity is not None:
        found = materialize(found)
        # a text is known by its hash; those of one component hang on the text that names it
        near = materialize(found.select(F.col("name.hash").alias("u"), F.col("component_id.hash").alias("v")).distinct())
        links = similar(named.select(F.col("name.hash").alias("node"), "body"), near, similarity)
        groups = connected_components(near.unionByName(links))
        firsts = found.select("component_id", F.col("component_id.hash").alias("node")).distinct().join(
            groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("component_id").alias("component_id"))
    else:
        firsts = found.select("component_id").distinct()
    chosen = firsts.select(F.xxhash64("component_id").alias(row))
    return docs.withColumn(row, F.xxhash64(name)).dropDuplicates([row]).join(chosen, row, "left_semi").drop(row)
