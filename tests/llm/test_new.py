"""Licence scans, whitening and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from placelab.llm import license_rules, licenses, prefix_trie, queries, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

# licences


def base_places(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


LICENSE_TEXTS = [
    None, "", "...", "CC-BY", "cc by cc by", "ccby cc bye", "All rights\nreserved, all   rights reserved.",
    "GNU General Public License, version 3.", "general PUBLIC licence", "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.", "cc by", "éall rights reserved", "CC BY " * 3000, "\x00cc\x00by\x00",
    "See the Apache License, Version 2.0 or the MIT license; all rights reserved",
]


def test_license_query_equals_plain_python(spark, tmp_path, messy_rows):
    texts = LICENSE_TEXTS + [r[1] for r in messy_rows] + ["All Rights Reserved"] * 2
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "cc by", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, detections long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        n_words, places = base_places(text)
        row = got[i]
        starts = [p for p, _ in places] or [None]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n_words, len(places), min(starts), max(starts)), text
        base = sorted({label for _, label in places})
        assert row.base_labels == ",".join(base)
        found = row.labels.split(",") if row.labels else []
        assert found == sorted(set(found)) and set(base) <= set(found) and 0 <= row.score <= 1
        assert (row.score > 0) == bool(found)
    by_text = {t: got[i] for i, t, _ in rows}
    assert by_text["Licensed under CC BY-NC 4.0."].labels == "cc-by,cc-by-nc"
    assert by_text["Released under the MIT License."].labels == "mit"
    assert by_text["GNU General Public License, version 3."].labels == "gpl,gpl-3.0"


def test_license_tables_without_rows_and_own_rules(spark, nothing):
    assert licenses.scan(nothing).count() == 0
    docs = spark.createDataFrame([(1, "red green blue", 7)], "doc_id long, text string, n_words long")
    rules = "[long 1 0.9]\ngreen: red green blue\n[short 2 0.5]\ngreen: green blue\n[other 1 0.4]\nblue: blue"
    row = licenses.scan(docs, rules=rules).withColumn("score", licenses.score(licenses.F.col("detections"))).first()
    assert [(d.label, d.first_word, d.last_word, d.suppressed) for d in row.detections] == [
        ("long", 0, 2, False), ("short", 1, 2, True), ("other", 2, 2, True)]
    assert row.score == pytest.approx(0.9)


def test_suppression_equals_all_pairs():
    rng = random.Random(1)
    for _ in range(300):
        hits = [(rng.randint(1, 3), n, s := rng.randint(0, 12), s + rng.randint(0, 6)) for n in range(rng.randint(1, 14))]
        want = {}
        for k in sorted(range(len(hits)), key=lambda k: (hits[k][0], hits[k][2], -hits[k][3], hits[k][1])):
            p, _, s, e = hits[k]
            want[k] = any(not want[o] and hits[o][2] <= s and hits[o][3] >= e for o in want)
        priority, number, start, end = (np.array(c) for c in zip(*hits))
        assert licenses.suppressed(list(priority), list(number), start, end).tolist() == [want[k] for k in range(len(hits))]


def test_every_rule_can_match():
    rules = license_rules.parsed()
    assert len(rules) >= 300
    for rule in rules:
        for word in rule.keywords:  # a keyword that the pattern does not ask for would hide matches
            assert re.search(rb"(?<![a-z0-9])" + re.escape(word) + rb"(?![a-z0-9\[?])", rule.pattern.pattern), rule


def test_blocks_do_not_matter(monkeypatch):
    text = ("x All rights reserved, " * 50 + "under the MIT License " + "y " * 40).encode()
    scanner = licenses.Scanner(license_rules.parsed())
    whole = scanner.scan(text)
    monkeypatch.setattr(licenses, "blocks", lambda data: iter(re.findall(rb".{1,7}(?:\s+|$)|\S+\s*", data)))
    assert scanner.scan(text) == whole


# whitening


def exact_covariance(rows):
    n, size = len(rows), len(rows[0])
    sums = [sum(r[d] for r in rows) for d in range(size)]
    return n, sums, [[Fraction(n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j], n * n) for j in range(size)] for i in range(size)]


def check_whitening(found, vectors):
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in vectors]
    n, sums, cov = exact_covariance(x)
    v = np.array([[float(c) for c in row] for row in cov])
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1], parts[:, ::-1]
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(vectors) * min(8, len(sums))
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    for (key, _), row, y in zip(vectors, x, centred):
        for k, r in by_id[key].items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums))
            assert r.explained == pytest.approx(values[k - 1] / np.trace(v), rel=1e-6)
            assert abs(r.whitened) == pytest.approx(abs(y @ parts[:, k - 1]) / math.sqrt(values[k - 1]), rel=1e-6, abs=1e-8)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-6


def test_whitening_query_equals_exact_fractions(spark, tmp_path):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(11, 11))
    vectors = [(i, (rng.normal(size=11) @ mixing).astype(np.float32).astype(float).tolist()) for i in range(150)]
    odd = [(900, None), (901, [None] * 11), (902, [math.nan] * 11), (903, [math.inf] + [0.0] * 10), (904, []), (905, [1.0])]
    rows = [(k, v, 1, None) for k, v in vectors + odd]
    schema = "vec_id long, embedding array<float>, whitened int, _vector string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    check_whitening(queries.op12_whitening(spark, str(tmp_path)).collect(), vectors)


def test_whitening_of_odd_tables(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation long, whitened string")
        model = whitening.fit(df)
        return model, whitening.transform(df, model).collect()

    model, rows = run([])
    assert (model.n, rows) == (0, [])
    model, rows = run([(1, None, 1, "a"), (2, [math.nan], 1, "a")])
    assert (model.n, rows) == (0, [])
    model, rows = run([(1, [0.5, 2.0], 1, "a")])  # a single row has no variance
    assert model.n == 1 and rows[0]["_whitened"] == [None, None] and rows[0]["_deviation"] == 0 and rows[0].whitened == "a"
    model, rows = run([(1, [3.0, -1.0], 1, "a")] * 3 + [(None, [1.0, 5.0], 2, "b")])  # repeated rows, a line
    assert model.n == 4 and len(rows) == 4 and rows[0]["_whitened"][1] is None
    huge = [(i, [x, 1.0 * i], 0, "") for i, x in enumerate([1e300, -1e300, 3e9, 0.0])]
    model, rows = run(huge)
    assert model.n == 4 and all(r["_deviation"] is None for r in rows)


@pytest.mark.parametrize("bits", [[1, 3, 0, 2], [11] * 4, [40, 3, 52, 17]])
def test_bit_planes_add_up_to_products(bits):
    rng = random.Random(2)
    planes, want = whitening.BitPlanes(bits), [[0] * 4 for _ in range(4)]
    for rows in (1, 64, 200):
        z = [[rng.getrandbits(b) if b else 0 for b in bits] for _ in range(rows)]
        planes.add(np.array(z, np.int64))
        want = [[want[i][j] + sum(r[i] * r[j] for r in z) for j in range(4)] for i in range(4)]
    got = [[sum(int(t[i, j]) << 31 * k for k, t in enumerate(planes.totals)) for j in range(4)] for i in range(4)]
    assert all(got[i][j] == want[i][j] for i in range(4) for j in range(i, 4))


# prefix trie


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


TRIE_SCHEMA = "conv_id long, turn long, role string, text string, depth long, _leaf int"


def random_conversations(seed, longest):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (-7, None, None, None), (-7, None, None, None), (-20, 3, "user", "a b")]
    for c in rng.sample(range(0, 130), 60):
        length = rng.choice([1, 1, 2, 3, 8, 9, longest])
        for t in range(length):
            text = rng.choice(["a", "b", "b c", "", None]) if t < 6 or c % 3 else "same"
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("seed,longest,stretch,piece,hot", [(1, 12, 4096, 4096, False), (2, 45, 2, 3, True)])
def test_trie_query_equals_plain_python(spark, tmp_path, monkeypatch, seed, longest, stretch, piece, hot):
    from placelab.operators import skew

    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rows = random_conversations(seed, longest)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], TRIE_SCHEMA)
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TRIE_SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_prefix_trie(spark, str(tmp_path)).collect() == []


def test_very_long_text_is_one_node(spark):
    text = "word " * 300_000
    placed = prefix_trie.turns(spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", text)], TRIE_SCHEMA.split(", depth")[0]))
    convs = placed.selectExpr("conv_id", "n").distinct()
    nodes = prefix_trie.trie(placed.drop("n"), convs).collect()
    assert sorted((r.depth, r.n_convs, r.saved_tokens) for r in nodes) == [(0, 2, 300_000), (1, 2, 300_000)]
