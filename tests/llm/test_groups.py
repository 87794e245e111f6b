"""Packing, repeated passages, near-duplicates and the pipeline against plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from placelab.llm import packing, simhash, suffixes
from placelab.llm.common import documents, public_path, public_pattern

TOKENIZER = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(TOKENIZER)
    return lambda text: np.array(loaded.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check_packing(pieces, ids, keys):
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p[0], []).append(p)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at and zlib.crc32(ids[doc][at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[doc]) == parts[0].doc_tokens
    assert set(by_doc) == set(keys)
    sizes = []
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(n not in (512, 1024, 2048) for n in sizes) <= 1


def test_packing_loses_and_pads_nothing(spark, messy_rows, messy, nothing, ids_of, monkeypatch):
    seen, rows = set(), []
    for r in messy_rows:
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    docs = spark.createDataFrame(rows, messy.schema).repartition(5)
    check_packing(packing.pack(docs, TOKENIZER, public_pattern()).collect(), {r[0]: ids_of(r[1]) for r in rows}, seen)
    monkeypatch.setattr(packing, "RESTS_PER_TASK", 2)  # several levels
    check_packing(packing.pack(docs, TOKENIZER, public_pattern()).collect(), {r[0]: ids_of(r[1]) for r in rows}, seen)
    assert packing.pack(messy, TOKENIZER, public_pattern()).agg({"length": "sum"}).first()[0] == sum(len(ids_of(r[1])) for r in messy_rows)
    assert packing.pack(nothing, TOKENIZER, public_pattern()).count() == 0


def test_tokens_equal_the_plain_library(ids_of, monkeypatch):
    rng = random.Random(9)
    bits = ["<|endoftext|>", "<|endof", "text|>", "word", "Ünï", ",", ".", "!?", "'s", "don't", " ", "  ", "\n", "12", "é,", "漢字.", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["<|endoftext|>"] * 2
    odd = [chr(c) for c in (0, 9, 0x0B, 0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x180E, 0xFEFF, 0x301, 0x1F642, 0xE0, 0x661)]
    texts += ["".join(rng.choice(odd + bits[3:]) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(32, 126)])) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    monkeypatch.setattr(packing, "PART_CHARS", 20)
    got = packing.tokenize(texts, TOKENIZER, public_pattern(), 1)
    assert all(g == ids_of(t).tobytes() for g, t in zip(got, texts))


def test_repeated_passages_with_clashing_columns(messy):
    clashing = messy.selectExpr("doc_id", "text AS Text", "n_chars", "row AS _spans", "row AS _row", "lang AS first", "row")
    left = suffixes.remove(clashing, size="n_chars")
    assert left.columns == clashing.columns and left.count() == clashing.count()


def test_step_groups_hold_equal_token_numbers(messy):
    pieces = packing.pack(messy, TOKENIZER, public_pattern()).groupBy("step_group").sum("length").collect()
    sizes = sorted(r[1] for r in pieces)
    assert sizes[-1] == packing.GROUP_WINDOWS * 2048


def repeated(texts, width):
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                edge[i] += 1
                edge[i + width] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()


def check_removed(spark, rows, width, gram):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.removed(docs, width=width, gram=gram).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    wanted = [(r[0], *x) for r, x in zip(rows, repeated([(r[1] or "").encode() for r in rows], width))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_repeated_passages_small_alphabet(spark, monkeypatch, hot):
    """Short widths over few letters make every kind of overlap; a low limit splits anchors down to single windows."""
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choices("ab c", [5, 4, 1, 1], k=rng.randint(0, 300)))) for i in range(60)]
    shared = "".join(rng.choices("abcdefgh", k=40))
    rows += [(100 + i, "".join(rng.choices("xyzuvw", k=25)) + shared[i % 5 :] + "".join(rng.choices("pqrst", k=25))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "é" * 50), (202, "é" * 50), (None, rows[70][1]), (203, "a" * 500)]
    check_removed(spark, rows, 12, 4)


def test_surroundings_of_one_passage_are_split(spark, monkeypatch):
    """One passage in 300 texts, with edges that some of them share, in cores of at most 20 surroundings."""
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", 20)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh", k=300))
    tails = ["".join(rng.choices("pqrst", k=rng.randint(0, 12))) for _ in range(12)]
    rows = [(i, "".join(rng.choices("xyzuvw", k=rng.randint(0, 220))) + passage + rng.choice(tails) + "".join(
        rng.choices("12345", k=rng.randint(0, 220)))) for i in range(300)]
    check_removed(spark, rows, 200, 40)


def test_the_sort_sees_every_open_window(monkeypatch):
    """No hash decides which windows are sorted; the answer is that of counting bytes."""
    seen, real = [], suffixes.suffix_sort
    monkeypatch.setattr(suffixes, "suffix_sort", lambda data, sums, starts, *rest: seen.extend(starts) or real(data, sums, starts, *rest))
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randint(12, 40))).encode() for _ in range(30)]
    contexts, anchors, windows = [], [], []
    for owner, first, last, anchor, _ in suffixes.anchored(texts, 12, 4):
        contexts += [texts[o][a : b + 12] for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist())]
        anchors += anchor.tolist()
        windows += (last - first + 1).tolist()
    group = np.unique(anchors, return_inverse=True)[1]
    found = suffixes.repeated_windows(contexts, group, np.array(windows), 12, 4)
    assert len(seen) == len(set(seen)) == sum(windows)
    every = [c[i : i + 12] for c, n in zip(contexts, windows) for i in range(n)]
    assert found.tolist() == [every.count(w) > 1 for w in every]


def test_repeated_passages_at_full_width(spark, messy_rows, nothing):
    check_removed(spark, [(r[0], r[1]) for r in messy_rows if len(r[1] or "") < 50_000], 200, 40)
    assert suffixes.removed(nothing).count() == 0


def test_remove_keeps_columns(messy):
    done = suffixes.remove(messy, size="n_chars")
    assert done.schema.names == messy.schema.names and done.count() == messy.count()
    assert done.filter("n_chars <> length(text)").count() == 0 and done.filter("text IS NULL").count() == 2


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choices("abcd", k=900))
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 128)
    texts = [text.encode(), (text[100:700] + "zz").encode()]
    found = set()
    for owner, first, last, *_ in suffixes.anchored(texts, 50, 10):
        for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
            for p in range(a, b + 1):
                assert (o, p) not in found
                found.add((o, p))
    assert found == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)}


def test_suffix_sort_orders_suffixes():
    rng = random.Random(3)
    data = np.array(rng.choices([97, 98], k=600), np.uint8)
    starts = np.array(rng.sample(range(560), 300))
    group = np.sort(np.array(rng.choices(range(4), k=300)))
    order = suffixes.suffix_sort(data, suffixes._CONTENT.prefix(data), starts, group, 40)
    raw = data.tobytes()
    got = [(group[i], raw[starts[i] : starts[i] + 40]) for i in order]
    assert got == sorted(got) and sorted(order) == list(range(300))


def plain_print(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, reach):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_follow_the_definition(monkeypatch):
    from placelab.llm import common

    texts = ["", None, "One", "one TWO", "É é É é", "a b c d e f g a b c", " \n x  y\tz w "]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_print(t)
    monkeypatch.setattr(simhash, "blocks", lambda data: common.blocks(data, 7))
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_print(t)


@pytest.mark.parametrize("sample,size,leaf", [(32_768, 4096, 512), (40, 16, 4)])
def test_links_join_exactly_the_near_pairs(spark, monkeypatch, sample, size, leaf):
    monkeypatch.setattr(simhash, "SAMPLE_SIZE", sample)
    monkeypatch.setattr(simhash, "SHARD_SIZE", size)
    monkeypatch.setattr(simhash, "LEAF_SIZE", leaf)
    rng = random.Random(size)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        prints.add(c)
        for _ in range(12):
            x = c
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.linked(spark.createDataFrame([(s,) for s in signed], "fp long"), 2).collect()
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[find(u)] = find(v)
    wanted = plain_components(prints, 2)
    mine = [find(s) for s in signed]
    assert len(set(zip(wanted, mine))) == len(set(wanted)) == len(set(mine))


def test_components_of_a_table(messy, messy_rows, nothing):
    rows = [r for r in messy_rows if len(r[1] or "") < 50_000]
    got = simhash.components(messy.filter("length(coalesce(text, '')) < 50000")).collect()
    prints = [plain_print(r[1]) for r in rows]
    groups = plain_components(prints, 2)
    names = {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            names[g] = min(names.get(g, r[0]), r[0])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    wanted = [(r[0], p - (1 << 64) if p >> 63 else p, names.get(g)) for r, p, g in zip(rows, prints, groups)]
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=key) == sorted(wanted, key=key)
    assert simhash.components(nothing).count() == 0
    kept = simhash.keep_first(messy.filter("length(coalesce(text, '')) < 50000"))
    assert kept.columns == messy.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == sorted(
        (g not in names, names.get(g, 0)) for g in set(groups))


def test_similar_texts_are_grouped(spark):
    """Copies that share four fifths of their runs of five words go, however long; others stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijk", k=5))
    passage = [word() for _ in range(60)]
    rows = []
    for n in (12, 30, 100, 100, 100, 400, 3000):
        base = [word() for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(6):
            copy = list(base)
            for _ in range(max(1, n // 100)):
                copy[rng.randrange(4, n - 4)] = word()
            rows.append((len(rows), " ".join(copy)))
    for _ in range(12):  # a passage that many share does not make them alike
        rows.append((len(rows), " ".join([word() for _ in range(80)] + passage + [word() for _ in range(80)])))
    sets = [set(zip(*[text.split()[i:] for i in range(5)])) for _, text in rows]
    prints, first = [plain_print(text) for _, text in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE
            if near or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if f == old else f for f in first]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect()}
    assert set(first) - kept == set()
    assert len(kept) <= len(set(first)) + 1
    assert len(set(first)) < len(rows) - 20


def set_groups(sets, similarity=0.8):
    """The first member of every set's group, by all pairs."""
    first = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if first[i] != first[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if f == old else f for f in first]
    return first


def nothing_known(spark):
    return spark.createDataFrame([], "u long, v long")


def link_groups(links, n):
    first = list(range(n))
    for u, v in links:
        a, b = first[u], first[v]
        first = [min(a, b) if f in (a, b) else f for f in first]
    return first


@pytest.mark.parametrize("block", [256, 3])
def test_all_rows_of_a_part_are_compared(spark, monkeypatch, block):
    """A chain and copies without their original, whose links do not all touch the two rows that all are compared with first."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    words = [word() for _ in range(300)]
    texts = [" ".join(words[9 * i : 9 * i + 104]) for i in range(20)]
    for _ in range(60):
        copy = words[:204]
        for at in rng.sample(range(204), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    bodies = spark.createDataFrame(list(enumerate(texts)), "node long, body string")
    found = link_groups(simhash.similar(bodies, nothing_known(spark), 0.8).collect(), len(texts))
    assert found == set_groups(sets) and found[:20] == [0] * 20


@pytest.mark.parametrize("least", [6, 1])
def test_pairs_just_above_the_limit_are_found(spark, monkeypatch, least):
    """At every length, however common the shingles are counted; pairs just below stay."""
    monkeypatch.setattr(simhash, "LEAST_COUNTED", least)
    monkeypatch.setattr(simhash, "COUNTED", 2)
    rng = random.Random(least)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    texts = []
    for n in (5, 6, 9, 10, 13, 14, 16, 30, 64, 131, 254, 504, 1004, 4004):
        for below in (0, 0, 0, 1):
            base, m = [word() for _ in range(n)], n - 4
            other = m - -(-8 * m // 9) + below  # shingles that differ: (m - x) / (m + x) >= 0.8 up to m / 9
            copy = base[: n - other] + [word() for _ in range(other)]
            texts += [" ".join(base), " ".join(copy)]
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    bodies = spark.createDataFrame(list(enumerate(texts)), "node long, body string").repartition(4)
    found = link_groups(simhash.similar(bodies, nothing_known(spark), 0.8).collect(), len(texts))
    assert found == set_groups(sets)
    assert all((found[2 * i] == found[2 * i + 1]) == (i % 4 < 3) for i in range(len(texts) // 2))


def test_only_pairs_that_may_be_alike_are_compared_whole(spark, monkeypatch):
    """Texts that share a passage without being alike do not travel; those that are do, also if their bitmaps differ in size."""
    asked, alike = [], simhash.alike

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(simhash, "alike", counted)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    passage = [word() for _ in range(100)]
    texts = [" ".join([word() for _ in range(70)] + passage + [word() for _ in range(80)]) for _ in range(60)]
    for n in (14, 66, 70, 132, 136, 260, 268, 1030, 1100):  # 4 less shingles; around powers of two
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: int(0.9 * n)])]
    texts.append(texts[0])
    nodes = [*range(len(texts) - 1), 0]
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts[:-1]]
    bodies = spark.createDataFrame(list(zip(nodes, texts)), "node long, body string").repartition(3)
    found = link_groups(simhash.similar(bodies, nothing_known(spark), 0.8).collect(), len(sets))
    assert found == set_groups(sets) and len(set(found)) == 69
    assert sum(asked) <= 18  # of more than 100 that share a shingle


def test_bitmaps_bound_what_texts_share(spark):
    """Bitmaps differ in no more bits than texts in shingles, at every size; the lookup knows every node, negative ones too."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 63, 64, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        for share in (0, 0.5, 0.9, 1):
            own = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 1 << 32, n // 7, dtype=np.uint32)]))
            x, y = (simhash.parity(s).view(np.uint64) for s in (a, own))
            while len(x) != len(y):
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, own))
    nodes = [0, 63, 64, -1, -64, simhash.FILTER_BITS - 1, 1 << 62, -(1 << 63)]
    bits = simhash.bitmap(spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert int(np.bitwise_count(bits).sum()) == len({n % simhash.FILTER_BITS for n in nodes})
    rows = pa.RecordBatch.from_arrays([pa.array([*nodes, 7, -7]), pa.array(["x"] * 10)], ["node", "body"])
    assert [n for found, _ in simhash.new_texts([rows], bits) for n in found] == nodes


def test_later_rows_of_a_group_are_compared(spark):
    """A text that is like a later row of a SimHash group, not like its first, goes with the group; repeated rows stay one."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    near = lambda a, b: (plain_print(a) ^ plain_print(b)).bit_count() <= simhash.DISTANCE
    shares = lambda a, b: len(a & b) / len(a | b)
    runs = lambda t: set(zip(*[t.split()[i:] for i in range(5)]))

    def edited(words, n):
        copy = list(words)
        for at in rng.sample(range(len(words)), n):
            copy[at] = word()
        return copy

    while True:  # two bits of distance, but four edits each: under 0.8 from the first to the last
        first = [word() for _ in range(200)]
        second = edited(first, 4)
        third = edited(second, 4)
        a, b, c = map(" ".join, (first, second, third))
        if near(a, b) and not near(a, c) and not near(b, c) and shares(runs(b), runs(c)) >= 0.8 > shares(runs(a), runs(c)):
            break
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (3, c), (4, c), (None, c), (5, ""), (6, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect()) == [1, 5]


def test_pipeline_stages(spark, ids_of):
    """Every stage against what its predecessor kept; the last one packs exactly the texts it got."""
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs, sizes = documents(spark, folder), []
    start = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder).cache()
        assert after.columns == start.columns and name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        sizes.append(after.count())
        docs = after
    assert start.count() > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    rows = docs.collect()
    pieces = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_packing(pieces, {r.doc_id: ids_of(r.text) for r in rows}, {r.doc_id for r in rows})
    labels = {r.doc_id: r.quality for r in documents(spark, folder, "labels").collect()}
    assert all(labels.get(r.doc_id) != 0 for r in rows)
