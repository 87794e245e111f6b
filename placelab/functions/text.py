"""Text cleaning and number parsing as native column expressions.

Patterns carry ``(?U)`` so that ``\\s``, ``\\d`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later projections and filters refer to instead of repeating.

    The optimizer copies an expression into every place that uses it, and a filter
    on it below the projection. For long text expressions that multiplies the
    work; a generator of one row is not copied. Existing columns are replaced.
    """
    row = F.struct(*[value.alias(f"_new_{name}") for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    added = df.select("*", F.inline(F.array(row)))
    renamed = {n: F.col(f"_new_{n}").alias(n) for n in columns}
    if len(kept) == len(df.columns):
        return added.select(*kept, *renamed.values())
    return added.select(*[renamed.pop(c) if c in renamed else F.col(c) for c in df.columns], *renamed.values())


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``; null when there is none."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def clean_text(text: Column) -> Column:
    """Null for empty input; otherwise stripped, on one line. Blank input gives ''."""
    one_line = F.replace(F.replace(strip(text), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(text != "", one_line)


def parse_rating(text: Column) -> Column:
    """First decimal number within 0..5, else the first integer within 0..5."""
    dotted = F.replace(strip(text), F.lit(","), F.lit("."))

    def in_range(pattern: str) -> Column:
        value = F.regexp_extract(dotted, pattern, 0).try_cast("double")
        return F.when(value.between(0.0, 5.0), value)

    return F.coalesce(in_range(r"(?U)\d+\.\d+"), in_range(r"(?U)\d+"))


def parse_reviews_count(text: Column) -> Column:
    """Digits of a count such as ``1,234 reviews`` or ``(1.234)``; null if other space is inside."""
    words_gone = F.replace(F.replace(F.lower(strip(text)), F.lit("reviews"), F.lit("")), F.lit("review"), F.lit(""))
    bare = strip(F.translate(strip(words_gone), "()", ""))
    number = F.translate(F.regexp_replace(bare, r"(?U)[^\d,.\s]", ""), ",. ", "")
    return F.when(number.rlike(r"^[0-9]+\z"), number.try_cast("bigint"))


def after_colon(label: Column) -> Column:
    """Text after the first ':' of an accessibility label, stripped; null without a colon."""
    at = F.instr(label, ":")
    return F.when(at > 0, strip(F.substring(label, at + 1, F.length(label))))


def text_or_label(text: Column, label: Column) -> Column:
    return F.coalesce(blank_to_null(text), after_colon(label))


def text_or_first_label(text: Column, labels: Column) -> Column:
    """As ``text_or_label`` with the first of several labels that holds a colon."""
    with_colon = F.filter(labels, lambda x: F.contains(x, F.lit(":")))
    return F.coalesce(blank_to_null(text), after_colon(F.try_element_at(with_colon, F.lit(1))))


def rating_text(box: Column, alternate: Column) -> Column:
    found = F.replace(first_match(box, r"(?U)\d+[.,]\d+"), F.lit(","), F.lit("."))
    return F.coalesce(found, alternate)


def reviews_text(box: Column) -> Column:
    return first_match(box, r"(?U)\(([0-9.,\s]+)\)", 1)


def star_count(bars: Column, star: int) -> Column:
    """Bars run from five stars down to one; the count is the first integer of the bar."""
    bar = F.try_element_at(bars, F.lit(6 - star))
    return F.regexp_extract(bar, r"(?U)\d+", 0).try_cast("int")


def safe_keyword(keyword: Column) -> Column:
    return F.translate(keyword, " /", "__")


def safe_location(location: Column) -> Column:
    # translate drops the characters that have no counterpart, here the comma
    return F.translate(location, " /,", "__")


def task_slug(task_id: Column, keyword: Column, location: Column) -> Column:
    return F.concat(
        F.lit("task_"), F.format_string("%03d", task_id), F.lit("_"),
        safe_keyword(keyword), F.lit("_"), safe_location(location),
    )
