"""Rules, chats, BPE, languages, quality and fingerprints against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelab.llm import bpe, chat, fingerprint, langid, lattice, quality, queries, rules
from placelab.llm.common import held_out, public_path, public_pattern

RANKS = public_path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


def base_rules(text):
    text, words = text or "", words_of(text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)}
    lines = [s for s in text.split("\n") if words_of(s)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rules_count_like_plain_python(messy, messy_rows):
    wanted = sorted((r[0] if r[0] is not None else -9, *base_rules(r[1])) for r in messy_rows if len(r[1] or "") < 50_000)
    got = rules.measured(messy.filter("length(coalesce(text, '')) < 50000")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == wanted


def test_rules_tell_odd_distributions(spark):
    rng = random.Random(1)
    vocabulary = ["the", "of", "and", "to"] + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    good = [(i, " ".join(rng.choices(vocabulary, [40, 30, 20, 20] + [1] * 300, k=200)), "en") for i in range(40)]
    symbols = " ".join(w + "***%%%" for w in good[0][1].split())
    no_common = " ".join(rng.choices(vocabulary[4:], k=200))
    short = "*** %%% $$$"
    rows = good + [(100, symbols, "en"), (101, no_common, "en"), (102, short, "en"), (103, good[1][1], None), (104, good[1][1], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in rules.keep_good(docs).collect()}
    assert kept == {*range(40), 103, 104}


def test_rules_keep_all_columns_and_take_empty_tables(messy, nothing):
    assert rules.keep_good(messy).columns == messy.columns
    assert rules.keep_good(nothing).count() == rules.measured(nothing).count() == 0


CHATS = [
    (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c</s>"), (2, 1, "user", None),
    (2, 1, "user", "[TURN]x[~TURN][/INST]<~~s>"), (3, 1, None, "[NEXT][TEXT]"), (3, None, "a[TEXT]b", ""), (None, 1, "assistant", "[" * 5 + "<s>"),
    (4, 1, "assistant", ""), (4, 2, "assistant", "é🙂"), (4, 2, "assistant", "é🙂"),
]


def test_chats_come_back_unchanged(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("formatted", F.lit(1)).withColumn("ts", F.lit("x"))
    got = {
        r.conv_id: r for r in chat.format_chats(rows)
        .select("*", chat.read_chats(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
        .collect()
    }
    for conv in {r[0] for r in CHATS}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in turns]
        assert got[conv].loss == "".join(t[3] for t in turns if t[2] == "assistant")
        body = got[conv].formatted
        assert body.count("[TURN]") == body.count("[/TURN]") == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
    assert got[1].formatted == "<s>[TURN]user[TEXT]a[/TURN][TURN]assistant[TEXT]b[NEXT]c<~/s>[/TURN]</s>"
    assert chat.format_chats(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_odd_texts(encoder):
    rng = random.Random(5)
    texts = ["", " ", "  a", "a  \n\n b", "a\n \nb", "x" * 5000, " " * 3000 + "b", "ab" * 3000, "don't we'll I'M", "\x1c \x85　a",
             "漢字かな🙂🙂 ñandú", "1234 5678,,,;;;", "<|endoftext|>", "\n \t\n  x  ", "the" * 4000]
    texts += ["".join(rng.choice("aab  \n'stve1.🙂é") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text in texts:
        ids = bpe.encode_text(text, RANKS, public_pattern()).tolist()
        assert ids == encoder.encode_ordinary(text)
        assert bpe.load(RANKS).decode(ids) == text.encode()


def test_bpe_joins_of_any_halves_are_the_whole(encoder):
    own, rng = bpe.load(RANKS), random.Random(6)
    for _ in range(300):
        data = bytes(rng.choice(b"aaaabtheing \xc3\xa9") for _ in range(rng.randint(2, 80)))
        cut = rng.randint(0, len(data))
        assert own.join(own.direct(data[:cut]), own.direct(data[cut:])) == own.direct(data)


def test_every_token_encodes_to_itself():
    own = bpe.load(RANKS)
    assert all(own.direct(token) == (rank,) for token, rank in own.ranks.items())


def test_bpe_over_a_table(messy, messy_rows, nothing, encoder):
    encoded = bpe.encode(messy, RANKS, public_pattern())
    got = bpe.decode(encoded, RANKS).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((r[0], encoder.encode_ordinary(r[1] or "")) for r in messy_rows), key=key)
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in messy_rows)
    assert bpe.decode(bpe.encode(nothing, RANKS, public_pattern()), RANKS).count() == 0


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    syllables = {"aa": "ka lo mi tu".split(), "bb": "sch ung ein ver".split(), "cc": "ção que ões las".split()}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(1, 60))).upper() if i % 7 == 0
             else " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(3, 60))), lang)
            for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.filter(~held_out("doc_id", 5, 0)))
    got = {r.doc_id: r for r in langid.predict(docs, model, keep={"held_out": held_out("doc_id", 5, 0)}).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows)
    assert any(r.held_out for r in got.values())


def test_languages_of_odd_texts(messy, messy_rows, nothing):
    got = langid.predict(messy, langid.learn(messy))
    texts = {r[0]: r[1] for r in messy_rows if r[0] is not None and r[0] != 5}
    for r in got.collect():
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert got.count() == len(messy_rows)
    assert langid.learn(nothing) == {} and langid.predict(nothing, {}).count() == 0
    assert {r.lang_pred for r in langid.predict(messy, {}).collect()} == {"und"}


def test_language_profiles_do_not_depend_on_blocks(monkeypatch):
    text = "".join(random.Random(1).choices("abc d,é", k=500))
    codes, counts = langid.Profiles(64).grams(text)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 1 << 20)
    again = langid.Profiles(64).grams(text)
    assert (codes == again[0]).all() and (counts == again[1]).all()
    table = {}
    padded = " " + re.sub(r"[^abcdé]+", " ", text) + " "
    padded = re.sub(" +", " ", padded)
    for i in range(len(padded) - 2):
        if padded[i + 1] != " ":
            table[padded[i : i + 3]] = table.get(padded[i : i + 3], 0) + 1
    assert sorted(counts.tolist()) == sorted(table.values())


def test_quality_learns_and_calibrates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(i, " ".join(word() + ("***" if i % 4 == 0 else "") for _ in range(rng.randint(20, 80))), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.learn(docs, docs, ~held_out("doc_id", 4, 2))
    got = {r.doc_id: r for r in quality.score(docs, model, keep={"held_out": held_out("doc_id", 4, 2)}).collect()}
    assert all(got[i].predicted == q and 0 <= got[i].score <= 1 for i, _, q in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, q in rows if q}


def test_quality_of_odd_tables(messy, nothing, messy_rows):
    labels = messy.select("doc_id", F.lit(1).alias("quality"))
    one_class = quality.learn(messy, labels)
    assert {r.score for r in quality.score(messy, one_class).collect()} == {1.0}
    unlearned = quality.learn(nothing, labels.limit(0))
    assert {r.score for r in quality.score(messy, unlearned).collect()} == {0.5}
    assert quality.score(nothing, unlearned).count() == 0
    mixed = quality.learn(messy, messy.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = quality.score(messy, mixed).collect()
    assert len(got) == len(messy_rows) and all(0 <= r.score <= 1 for r in got)


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_fingerprints_estimate_the_overlap():
    rng = random.Random(8)
    errors = []
    for _ in range(150):
        words = ["".join(rng.choices("abcde", k=4)) for _ in range(rng.randint(1, 400))]
        other = list(words)
        for _ in range(rng.randint(0, 20)):
            other[rng.randrange(len(other))] = "zz"
        a, b = " ".join(words), " ".join(other)
        x, y = shingles(a), shingles(b)
        errors.append(fingerprint.likeness(fingerprint.fingerprint(a.encode()), fingerprint.fingerprint(b.encode())) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert fingerprint.likeness(b"", b"") == 1.0 and fingerprint.likeness(b"", fingerprint.fingerprint(b"x")) == 0.0


def test_fingerprints_with_the_next_document(spark, messy, messy_rows, nothing):
    got = fingerprint.against_next(messy).collect()
    assert len(got) == len(messy_rows)
    alone = {(r.doc_id, bytes(r.fingerprint)) for r in fingerprint.fingerprints(messy).collect()}
    assert {(r.doc_id, bytes(r.fp)) for r in got} == alone
    unique = {r[0]: r[1] or "" for r in messy_rows if r[0] is not None and [x[0] for x in messy_rows].count(r[0]) == 1}
    by_id = {r.doc_id: r for r in got}
    checked = 0
    for i in unique:
        if i - 1 in unique:
            text, following = unique[i], unique[i - 1]
            n = len(text) // 3
            assert by_id[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
            assert by_id[i].near_next == fingerprint.likeness(
                fingerprint.fingerprint(text.encode()), fingerprint.fingerprint(following.encode()))
            checked += 1
    assert checked > 20
    assert fingerprint.against_next(nothing).count() == 0
    single = fingerprint.against_next(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert single.near_next == 1.0


def test_lattice_sums_over_all_spellings():
    import math

    logs = {"▁a": -1.0, "▁": -2.0, "a": -1.5, "b": -1.2, "ab": -0.7, "▁ab": -3.0, "<0xC3>": -4.0, "<0xA9>": -5.0}
    found = lattice.Lattice(logs).log_probability("ab")
    ways = [-1.0 - 1.2, -2.0 - 1.5 - 1.2, -2.0 - 0.7, -3.0]
    assert math.isclose(found, math.log(sum(map(math.exp, ways))))
    assert math.isclose(lattice.Lattice(logs).log_probability("é"), -2.0 - 9.0)
    counts = {}
    lattice.Lattice(logs).add_expected("ab", 2.0, counts)
    assert math.isclose(counts["▁ab"], 2 * math.exp(-3.0 - found)) and math.isclose(counts["ab"], 2 * math.exp(-2.7 - found))


def spellings(text, logs):
    """All ways to write ``text`` as pieces; a character that is no piece is its bytes."""
    if not text:
        yield [], 0.0
    for n in range(1, len(text) + 1):
        names = [text[:n]] if text[:n] in logs else [f"<0x{b:02X}>" for b in text[0].encode()] if n == 1 else []
        for rest, value in spellings(text[n:], logs) if names else ():
            yield names + rest, sum(logs[x] for x in names) + value


def test_lattice_shares_beginnings_without_changing_sums():
    import math

    rng = random.Random(3)
    logs = {"".join(p): -rng.random() * 4 for n in (1, 2, 3) for p in product("▁ab", repeat=n)}
    logs |= {f"<0x{b:02X}>": -6.0 - b / 256 for b in range(256)}
    del logs["▁▁a"], logs["bab"]
    known = lattice.Lattice(logs)
    words = sorted({"".join(rng.choices("abé", [5, 4, 1], k=rng.randint(1, 6))) for _ in range(150)})
    for order in (words, rng.sample(words, len(words))):  # sorted order saves work, any order is right
        counts, wanted = {}, {}
        walk, plain = lattice.Walk(known), lattice.Walk(known)
        for times, word in enumerate(order, 1):
            ways = list(spellings(lattice.START + word, logs))
            whole = math.log(sum(math.exp(v) for _, v in ways))
            assert math.isclose(plain.forward(word), whole) and math.isclose(known.log_probability(word), whole)
            walk.add(word, times, counts)
            for names, value in ways:
                for name in names:
                    wanted[name] = wanted.get(name, 0.0) + times * math.exp(value - whole)
        walk.close(0, counts)
        assert counts.keys() == wanted.keys() and all(math.isclose(counts[p], wanted[p], rel_tol=1e-9) for p in wanted)


def test_lattice_query_like_plain_python(spark):
    import math
    from collections import Counter

    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    count = Counter(w for i, words in rows if not out[i] for w in words)
    ends = sum(not x for x in out.values())
    tokens, kinds = sum(count.values()) + ends, len(count) + 1
    base = {i: sum(math.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1))) for c in [ends, *(count[w] for w in words)]) for i, words in rows}
    got = {r.doc_id: r for r in queries.op7_lattice(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, words in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(words) + 1, tokens)
        assert r.n_known == 1 + sum(count[w] > 0 for w in words) and math.isclose(r.base_score, base[i], rel_tol=1e-9)
        assert r.score < 0


def test_long_frequent_words_are_known_by_their_digest(spark, monkeypatch):
    long = "x" * 100
    docs = spark.createDataFrame([(i, f"{long} {long} rare{i}") for i in range(30)], "doc_id long, text string")
    model = lattice.learn(docs, public_path("piece_bpe_32k.model"), F.lit(True))
    monkeypatch.setattr(lattice, "FREQUENT", 1)  # only the long word is sent to all tasks
    few = sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lattice.score(docs, model).collect())
    monkeypatch.setattr(lattice, "FREQUENT", 100)
    assert few == sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lattice.score(docs, model).collect())
    assert {x[1] for x in few} == {4}


def test_lattice_over_odd_tables(messy, messy_rows, nothing, monkeypatch):
    trained = ~held_out("doc_id", 5, 1)
    path = public_path("piece_bpe_32k.model")
    got = lattice.score(messy, lattice.learn(messy, path, trained)).collect()
    assert len(got) == len(messy_rows) and all(r.score < 0 and r.base_score < 0 for r in got)
    by_text = sorted((len((r[1] or "").encode().split()) + 1) for r in messy_rows)
    assert sorted(r.n_tokens for r in got) == by_text
    assert lattice.score(nothing, lattice.learn(nothing, path, trained)).count() == 0
    model = lattice.learn(messy, path, trained)
    monkeypatch.setattr(lattice, "FREQUENT", 3)  # nearly all words are joined
    joined = lattice.score(messy, model).collect()
    key = lambda r: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, joined)) == sorted(map(key, got))
    untrained = lattice.score(messy, lattice.learn(messy, path, F.lit(False))).collect()
    assert {r.n_known for r in untrained} == {0} and all(r.score < 0 for r in untrained)


def test_registered_queries_have_sql_where_it_can_be_said():
    assert set(queries.oracle_sql()) == {"op9_rules", "op10_chat", "op13_prefix_trie"} and len(queries.queries()) == 14
