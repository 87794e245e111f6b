"""Quality rules from counts and from the distance of a document's distributions to its language's.

Counts come from the whole text. The verdict compares two histograms with the totals
of all documents of the same language by Jensen-Shannon distance (0 to 1): character
classes, and the language's most common words. Texts below the minimum lengths are
not compared. Only Spark expressions.

Null text counts as empty. A document whose language is null, or has no word list, is
compared with the totals of all documents, by characters only. Input columns are
kept by ``keep_good``; ``measured`` returns the id and its own columns, so other
columns cannot clash. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import SPACE_PATTERN, SPACES
from placelab.session import materialize

# The common words of each language that the histograms count.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.26
ANY = "*"


def words_of(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES.decode()))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by runs of ``width`` at the sorted ``starts``."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a run of ``width`` words found twice or more; ``words`` has to be a plain column.

    Runs are compared by hash; sorting brings equal ones together, so long texts cost n log n.
    """
    runs = F.size(words) - width + 1
    keyed = F.when(runs > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(runs, F.lit(1)) - 1),
        lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + j) for j in range(width)]).alias("k"), i.alias("at")
        ),
    )).otherwise(F.array().cast("array<struct<k:bigint,at:int>>"))
    starts = bound(F.sort_array(keyed), lambda s: F.transform(
        F.filter(s, lambda x, i: x["k"].eqNullSafe(F.get(s, i - 1)["k"]) | x["k"].eqNullSafe(F.get(s, i + 1)["k"])),
        lambda x: x["at"],
    ))
    return bound(F.sort_array(starts), lambda s: _covered(s, width))


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of an array of counts to an array of shares; 0 for an empty text."""
    def term(x: Column, other: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + other))).otherwise(0.0)

    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(F.array(total), lambda t: F.transform(counts, lambda c: c / t))
    parts = F.zip_with(F.get(shares, F.lit(0)), reference, lambda p, q: term(p, q) + term(q, p))
    divergence = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence / 2, F.lit(0.0)))).otherwise(0.0)


#: Counted characters of a text without its letters.
OTHER_CLASSES = {"digits": "[0-9]", "spaces": r"[\x20\x09-\x0D]", "marks": r"""[.,;:!?'"()\-]""", "symbols": "[#*$%&|<>]"}


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def char_counts(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``n_chars``, ``spaces``, ``symbols`` and ``chars`` of ``text``.

    ``chars``: capital letters, other letters, digits, white space, sentence marks, and the rest.
    """
    n = F.length("text")
    first = once(
        df, keep, n_chars=n, upper=F.length(F.regexp_replace("text", r"\P{Lu}+", "")),
        bare=F.regexp_replace("text", r"\p{L}+", ""),
    )
    second = once(first, [*keep, "n_chars", "upper"], bare=F.length("bare"), **{
        k: _length_without(F.col("bare"), v) for k, v in OTHER_CLASSES.items()})
    shares = (F.col("upper"), F.col("n_chars") - F.col("bare") - F.col("upper"), F.col("digits"), F.col("spaces"),
              F.col("marks"), F.col("bare") - F.col("digits") - F.col("spaces") - F.col("marks"))
    return second.select(*keep, "n_chars", "spaces", "symbols", F.array(*[x.cast("double") for x in shares]).alias("chars"))


def _list_of(lang: Column) -> Column:
    chosen = F.lit(None).cast("array<string>")
    for name, words in COMMON_WORDS.items():
        chosen = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(chosen)
    return F.coalesce(chosen, F.array().cast("array<string>"))


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that later steps read instead of computing them again.

    The optimizer copies an expression into every place that uses it, but not the output of a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def _histograms(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``char_counts`` and ``common``: the language's common words and all others; empty without a list.

    Of ``text``, ``words`` and ``lang``.
    """
    typed = char_counts(df, [*keep, "words", "lang"])
    kept = [*keep, "n_chars", "spaces", "symbols", "chars"]
    listed = once(typed, [*kept, "words"], wanted=_list_of(F.col("lang")))
    found = once(listed, [*kept, "wanted"], n=F.size("words"), known=F.filter(
        "words", lambda w: F.array_contains("wanted", w)))
    counted = once(found, [*kept, "n", "known"], each=F.transform(
        "wanted", lambda r: (F.size("known") - F.size(F.array_remove("known", r))).cast("double")))
    return once(counted, kept, common=F.when(
        F.size("each") > 0, F.concat("each", F.array((F.col("n") - F.size("known")).cast("double")))
    ).otherwise(F.array().cast("array<double>")))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Shares of character classes and common words by language, over all documents; ``*`` is their sum.

    One row per language that has a word list, and one for the rest: a handful of rows.
    """
    base = once(docs, [], l=_listed_lang(F.col(lang)), lang=F.col(lang), text=F.coalesce(F.col(text), F.lit("")), words=words_of(F.col(text)))
    return _shares(_histograms(base, ["l"]))


def _listed_lang(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(ANY)


def _shares(histograms: DataFrame) -> dict[str, dict[str, list[float]]]:
    """References from the histograms of all documents, by ``l``."""
    width = len(next(iter(COMMON_WORDS.values()))) + 1
    sums = histograms.groupBy("l").agg(
        F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(6)]).alias("c"),
        F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(width)]).alias("w"),
    ).collect()
    found = {}
    totals = [sum(x) for x in zip(*[r.c for r in sums])] if sums else []
    for key, chars, words in [(r.l, r.c, r.w) for r in sums if r.l != ANY] + [(ANY, totals, None)]:
        shares = {"chars": chars, "words": words}
        found[key] = {
            k: [x / sum(v) for x in v] for k, v in shares.items() if v and all(x is not None for x in v) and sum(v)
        }
    return found


def _reference(refs: dict, kind: str, lang: Column, size: int) -> Column:
    def literal(values: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])

    chosen = literal(refs[ANY][kind]) if refs.get(ANY, {}).get(kind) else F.lit(None).cast("array<double>")
    for name in COMMON_WORDS:
        if refs.get(name, {}).get(kind):
            chosen = F.when(lang == name, literal(refs[name][kind])).otherwise(chosen)
    return chosen


SIMPLE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _shaped(docs: DataFrame, keep: str) -> DataFrame:
    """``keep``, ``lang``, all counts and histograms of every row of ``docs(keep, text, lang)``."""
    texts = once(docs, [keep, "lang"], text=F.coalesce("text", F.lit("")))
    split = once(
        texts, [keep, "lang", "text"], words=words_of(F.col("text")),
        lines=F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
    )
    first = once(
        split, [keep, "lang", "text", "words"], n_words=F.size("words").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("words")),
    )
    return _histograms(first, [keep, "lang", "n_words", "n_dup_lines", "n_repeat_words"]).select(
        "*", (F.col("n_chars") - F.col("spaces")).cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"))


def _judged(shaped: DataFrame, refs: dict, keep: str) -> DataFrame:
    """``keep`` with all counts and verdicts."""
    lang = F.col("lang")
    far = once(
        shaped, [keep, "n_chars", *SIMPLE],
        char_distance=_distance(F.col("chars"), _reference(refs, "chars", lang, 6)),
        word_distance=F.when(F.size("common") > 0, _distance(F.col("common"), _reference(refs, "words", lang, 17))),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    off = (
        ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE))
        | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    )
    return once(
        far, [keep, *SIMPLE, "char_distance", "word_distance"],
        base_failed=failed, kept=~failed & ~F.coalesce(off, F.lit(False)),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The id, all counts, both distances, ``base_failed`` and ``kept`` of every row; none for an empty table.

    Texts are read once: the counts of all rows, without their texts, are written out, and
    both the references and the verdicts come from them.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = materialize(_shaped(rows, "_key"))
    refs = _shares(counted.withColumn("l", _listed_lang(F.col("lang"))))
    return _judged(counted, refs, "_key").withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with all their columns; narrow, nothing is shuffled."""
    refs = references(docs, text, lang)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(text).alias("text"), F.col(lang).alias("lang"))
    return _judged(_shaped(rows, "_row"), refs, "_row").filter("kept").select("_row.*")
