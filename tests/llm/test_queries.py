"""The registered queries and the pipeline's stages over tables of odd rows, against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from placelab.llm import langid, queries
from placelab.llm.common import public_path, public_pattern
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_groups import plain_components, plain_print, repeated


@pytest.fixture(scope="module")
def folder(spark, messy_rows, tmp_path_factory):
    """A folder with documents (unique ids, otherwise as odd as they come) and labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, *r[1:]) for i, r in enumerate(messy_rows)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(rows))], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}


def answers(query, spark, folder):
    path, rows = folder
    got = {r.doc_id: r for r in query(spark, path).collect()}
    assert set(got) == set(rows)
    return [(got[i], rows[i][1] or "", rows[i]) for i in rows]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_language_query(spark, folder):
    """Letters, trigrams, sums and cosines from the definition, one trigram at a time."""
    letters = {}

    def letter(c):
        if c not in letters:
            letters[c] = np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, langid.DIMENSIONS) * 2 - 1
        return letters[c]

    def vector(text):
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        total = np.zeros(langid.DIMENSIONS, np.int64)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b != " ":
                total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return total

    found = [(r, vector(text), row[2]) for r, text, row in answers(queries.op1_language, spark, folder) if len(text) < 5000]
    long = [(vector(row[1]), row[2]) for row in folder[1].values() if len(row[1] or "") >= 5000 and crc(row[0]) % 5]
    sums = {}
    for v, lang in [(v, lang) for r, v, lang in found if crc(r.doc_id) % 5] + long:
        if lang is not None:
            sums[lang] = sums.get(lang, 0) + v
    for r, v, _ in found:
        assert r.held_out == (crc(r.doc_id) % 5 == 0)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = {lang: float(v @ s) / np.linalg.norm(v) / np.linalg.norm(s) for lang, s in sums.items()}
        best = max(cosines.values())
        assert cosines[r.lang_pred] == pytest.approx(best, abs=1e-6) and r.score == pytest.approx(max(best, 0), abs=1e-6)


def test_encoding_query(spark, folder):
    plain = tiktoken.Encoding("plain", pat_str=public_pattern(), mergeable_ranks=load_tiktoken_bpe(public_path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r, text, _ in answers(queries.op2_bpe, spark, folder):
        ids = plain.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_quality_query(spark, folder):
    for r, _, _ in answers(queries.op3_quality, spark, folder):
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_fingerprint_query(spark, folder):
    found = answers(queries.op4_fingerprint, spark, folder)
    texts = {r.doc_id: text for r, text, _ in found}
    prints = {}
    for r, text, _ in found:
        after = texts[r.doc_id - 1 if r.doc_id else len(texts) - 1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited.encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert edited != text or r.edited_fingerprint == r.fingerprint and r.near_edited == 1


def test_passage_query(spark, folder):
    found = answers(queries.op6_suffixes, spark, folder)
    short = [(r, text.encode()) for r, text, _ in found]
    for (r, _), (size, gone, runs, kept) in zip(short, repeated([t for _, t in short], 200)):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, gone, runs, sha(kept))


def test_simhash_query(spark, folder):
    found = answers(queries.op8_simhash, spark, folder)
    prints = [plain_print(text) for _, text, _ in found]
    groups = plain_components(prints, 2)
    for (r, _, _), fp, group in zip(found, prints, groups):
        assert (r.fingerprint, r.component_id) == (f"{fp:016x}", found[group][0].doc_id)


def test_stages_on_odd_tables(spark, messy, nothing, folder):
    """Every stage takes nulls, empty and long texts, repeated rows, an empty table and clashing names, and keeps the columns."""
    import corpus_pipeline as pipeline

    clashing = messy.withColumnsRenamed({"row": "_row", "text2": "_spans", "score": "n"}).selectExpr("*", "lang AS first", "doc_id AS node", "source AS body")
    for name, stage in pipeline.STAGES:
        before = clashing.count()
        after = stage(spark, clashing, folder[0])
        if name == "pack":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in clashing.collect()}
        else:
            assert after.columns == clashing.columns and after.count() <= before
        assert stage(spark, clashing.limit(0), folder[0]).count() == 0


def test_near_duplicate_stage_on_repeated_rows(spark, folder):
    import corpus_pipeline as pipeline

    rng = random.Random(6)
    texts = [prose(rng, 120) for _ in range(6)]
    rows = [(i, texts[i % 6], None, None, len(texts[i % 6]), 0.0, i, None) for i in range(60)] + [(0, texts[0], None, None, len(texts[0]), 0.0, 0, None)] * 3
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder[0]).collect()
    assert sorted(r.doc_id for r in kept) == list(range(6))
