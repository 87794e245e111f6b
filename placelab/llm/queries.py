"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelab.llm import (
    bpe, chat, fingerprint, langid, lattice, licenses, packing, prefix_trie, quality, rules, simhash, suffixes, whitening,
)
from placelab.llm.common import documents, held_out, public_path, public_pattern
from placelab.session import materialize

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 5, 0)
    return langid.predict(docs, langid.learn(docs.filter(~out)), keep={"held_out": out})


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(documents(spark, sf_dir), path, public_pattern())
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 4, 2)
    model = quality.learn(docs, documents(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, model, keep={"held_out": out})


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.against_next(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_path("byte_bpe_50k.json"), public_pattern())


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 5, 1)
    model = lattice.learn(docs, public_path("piece_bpe_32k.model"), ~out)
    return lattice.score(docs, model, keep={"held_out": out})


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measured(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = rules.once(
        chat.format_chats(rows), ["conv_id"], formatted_chars=F.length("formatted").cast("long"),
        turns=chat.read_chats(F.col("formatted")), loss=chat.read_loss(F.col("formatted"), F.col("loss_spans")),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir)).withColumn("said", licenses.base(F.col("detections")))
    starts = F.transform("said", lambda d: d["first_word"])
    return found.select(
        "doc_id", "n_words", F.size("said").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), licenses.labels(F.col("said")).alias("base_labels"),
        licenses.labels(F.concat("said", licenses.accepted(F.col("detections")))).alias("labels"),
        licenses.score(F.col("detections")).alias("score"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = materialize(whitening.transform(vectors, model, k=8).drop("embedding"))
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained(8)]).cast("array<double>")
    error = F.lit(whitening.identity_error(rows)).cast("double")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), error.alias("identity_error"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    placed = prefix_trie.turns(documents(spark, sf_dir, "conversations"))
    heads = F.crc32(conv_id.cast("string").cast("binary")) % 4
    return prefix_trie.trie(*prefix_trie.with_shared_heads(materialize(placed), heads, conv_id - conv_id % 20))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language, "op2_bpe": op2_bpe, "op3_quality": op3_quality, "op4_fingerprint": op4_fingerprint,
        "op5_packing": op5_packing, "op6_suffixes": op6_suffixes, "op7_lattice": op7_lattice, "op8_simhash": op8_simhash,
        "op9_rules": op9_rules, "op10_chat": op10_chat, "op11_licenses": op11_licenses, "op12_whitening": op12_whitening,
        "op13_prefix_trie": op13_prefix_trie, "pipeline": pipeline,
    }


_CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(text, '([<\[])(~*(/?s>|/?TURN\]|TEXT\]|NEXT\]|/?INST\]))', '\1~\2', 'g')) AS body,
    length(regexp_replace(role, '([<\[])(~*(/?s>|/?TURN\]|TEXT\]|NEXT\]|/?INST\]))', '\1~\2', 'g')) AS name,
    lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(7 + sum(body + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 12 + name END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


_TRIE_SQL = r"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
      lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), parts AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.donor AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h
), rebuilt AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY part, pos) AS all_turns FROM parts GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(all_turns, []) AS all_turns FROM convs LEFT JOIN rebuilt USING (conv_id)
), paths AS (
  SELECT conv_id, d AS depth, sha256(CAST(all_turns[1:d] AS VARCHAR)) AS node, len(all_turns) = d AS ends,
    CASE WHEN d > 0 THEN sha256(CAST(all_turns[1:d - 1] AS VARCHAR)) END AS above,
    CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(all_turns[d].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ELSE 0 END
      AS words
  FROM (SELECT conv_id, all_turns, unnest(range(0, len(all_turns) + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, node, any_value(above) AS above, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, node
), families AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes c WHERE c.above = n.node AND c.depth = n.depth + 1) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1
), below AS (
  SELECT p.depth, p.node, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM families f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.node
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM families JOIN below USING (depth, node)
"""


def _rules_sql() -> str:
    """The rules in SQL; the word lists and limits are those of the operator."""
    lists = " UNION ALL ".join(
        f"SELECT '{lang}' AS l, [{', '.join(repr(w) for w in words)}] AS wanted" for lang, words in rules.COMMON_WORDS.items())
    classes = ", ".join(
        f"CAST(length(bare) - length(regexp_replace(bare, '{p.replace(chr(39), chr(39) * 2)}+', '', 'g')) AS BIGINT) AS {k}"
        for k, p in rules.OTHER_CLASSES.items())
    distance = """sqrt(greatest(0, list_sum(list_transform(list_zip({c}, {r}), lambda x:
      CASE WHEN x[1] > 0 THEN x[1] / {t} * log2(2 * (x[1] / {t}) / (x[1] / {t} + x[2])) ELSE 0 END
      + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] / {t} + x[2])) ELSE 0 END)) / 2))"""
    return rf"""
WITH lists AS ({lists}), split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(coalesce(text, ''), '\p{{L}}+', '', 'g') AS bare
  FROM documents
), runs AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n
  FROM (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS w
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split))
), repeated AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words
  FROM runs, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r
), counted AS (
  SELECT s.r, doc_id, lang, len(words) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS n_chars, length(bare) AS bare_chars,
    length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS upper, {classes},
    list_transform(wanted, lambda q: len(list_filter(words, lambda w: w = q))) AS each
  FROM split s LEFT JOIN repeated USING (r) LEFT JOIN lists ON l = lang
), shaped AS (
  SELECT *, [upper, n_chars - bare_chars - upper, digits, spaces, marks, bare_chars - digits - spaces - marks] AS chars,
    CASE WHEN each IS NOT NULL THEN list_append(each, n_words - CAST(list_sum(each) AS BIGINT)) END AS common
  FROM counted
), char_sums AS (
  SELECT lang AS l, i, sum(chars[i]) AS s FROM shaped, (SELECT unnest(range(1, 7)) AS i)
  WHERE each IS NOT NULL GROUP BY ALL
  UNION ALL SELECT '*', i, sum(chars[i]) FROM shaped, (SELECT unnest(range(1, 7)) AS i) GROUP BY ALL
), char_refs AS (
  SELECT l, list(CAST(s AS DOUBLE) / t ORDER BY i) AS cref
  FROM (SELECT l, i, s, sum(s) OVER (PARTITION BY l) AS t FROM char_sums) WHERE t > 0 GROUP BY l
), word_refs AS (
  SELECT l, list(CAST(s AS DOUBLE) / t ORDER BY i) AS wref
  FROM (SELECT l, i, s, sum(s) OVER (PARTITION BY l) AS t
        FROM (SELECT lang AS l, i, sum(common[i]) AS s FROM shaped, (SELECT unnest(range(1, 18)) AS i)
              WHERE each IS NOT NULL GROUP BY ALL)) WHERE t > 0 GROUP BY l
), measured AS (
  SELECT s.*, CASE WHEN n_chars > 0 THEN {distance.format(c='chars', r='coalesce(c.cref, a.cref)', t='n_chars')} ELSE 0 END AS cd,
    CASE WHEN each IS NULL THEN NULL WHEN n_words > 0 THEN {distance.format(c='common', r='wref', t='n_words')} ELSE 0 END AS wd,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM shaped s LEFT JOIN char_refs c ON c.l = lang LEFT JOIN word_refs w ON w.l = lang
    LEFT JOIN char_refs a ON a.l = '*'
)
SELECT doc_id, n_words, n_chars - spaces AS word_chars, symbols AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {rules.MIN_CHARS} AND cd > {rules.MAX_CHAR_DISTANCE}, false)
    AND NOT coalesce(n_words >= {rules.MIN_WORDS} AND wd > {rules.MAX_WORD_DISTANCE}, false) AS kept
FROM measured
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_rules": _rules_sql(), "op10_chat": _CHAT_SQL, "op13_prefix_trie": _TRIE_SQL}
