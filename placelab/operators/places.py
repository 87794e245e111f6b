"""Captured text to typed places, validity, identity and deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelab.functions import text as X
from placelab.functions.address import PARTS, with_address_parts
from placelab.functions.coords import link_coordinates
from placelab.operators.rows import with_running_total
from placelab.schemas import PLACE, PLACE_COLUMNS
from placelab.session import materialize

# Headings of the result list that are not place names.
PANEL_HEADINGS = ["Hasil", "Results"]


def named_captures(captures: DataFrame) -> DataFrame:
    """Captures whose name is there and is not a heading of the result list."""
    name = F.col("name_text")
    return captures.filter(name.isNotNull() & ~name.isin("", *PANEL_HEADINGS))


def is_valid_place(name: Column, link: Column) -> Column:
    return name.isNotNull() & link.isNotNull() & (F.length(name) > 0)


def valid_places(places: DataFrame) -> DataFrame:
    return places.filter(is_valid_place(F.col("name"), F.col("link")))


# Which helper steps a result column is read from; the others come straight from the capture.
HELPERS = {
    "latitude": "_at", "longitude": "_at", "rating": "_rating", "reviews_count": "_reviews", "phone": "_phone",
    "address": "address", **{part: "address" for part in PARTS},
}


def assemble(captures: DataFrame, keep: tuple[str, ...] = ("task_id", "rank"),
             columns: tuple[str, ...] = tuple(PLACE_COLUMNS)) -> DataFrame:
    """CAPTURE rows to PLACE rows in one narrow stage; ``keep`` columns are carried along.

    Only the steps that ``columns`` depend on are planned. Name and link are
    always looked at, since they decide whether a place is valid. Captures may
    lack optional columns: they then count as null.
    """
    strings = ["category_text", "address_text", "rating_box_text", "rating_alt_text", "phone_text", "phone_aria",
               "website", "hours_text", "search_keyword", "search_location"]
    defaults = {c: F.lit(None).cast("string") for c in strings}
    defaults |= {c: F.lit(None).cast("array<string>") for c in ("address_aria", "star_bar_texts")}
    defaults["captured_at"] = F.lit(None).cast("timestamp")
    absent = {c: value for c, value in defaults.items() if c not in captures.columns}
    rows = named_captures(captures.withColumns(absent) if absent else captures)

    box = F.col("rating_box_text")
    helpers = {
        "address": X.text_or_first_label(F.col("address_text"), F.col("address_aria")),
        "_at": link_coordinates(F.col("link")),
        "_rating": X.rating_text(box, F.col("rating_alt_text")),
        "_reviews": X.reviews_text(box),
        "_phone": X.text_or_label(F.col("phone_text"), F.col("phone_aria")),
    }
    needed = {HELPERS.get(c) for c in columns}
    wanted_helpers = {name: step for name, step in helpers.items() if name in needed}
    if wanted_helpers:
        rows = X.computed_once(rows, wanted_helpers)
    if parts := tuple(p for p in PARTS if p in columns):
        rows = with_address_parts(rows, "address", parts)
    fields = {
        "name": X.clean_text(F.col("name_text")),
        "category": X.clean_text(F.col("category_text")),
        "address": X.clean_text(F.col("address")),
        **{part: X.clean_text(F.col(part)) for part in PARTS},
        "latitude": F.col("_at.latitude"),
        "longitude": F.col("_at.longitude"),
        "rating": X.parse_rating(F.col("_rating")),
        "reviews_count": X.parse_reviews_count(F.col("_reviews")),
        "phone": X.clean_text(F.col("_phone")),
        "website": X.clean_text(F.col("website")),
        "link": F.col("link"),
        "opening_hours": X.clean_text(F.col("hours_text")),
        **{f"star_{s}": X.star_count(F.col("star_bar_texts"), s) for s in range(1, 6)},
        "search_keyword": F.col("search_keyword"),
        "search_location": F.col("search_location"),
        "scraped_at": F.col("captured_at"),
    }
    carried = [c for c in keep if c in rows.columns]
    asked = [c for c in PLACE_COLUMNS if c in columns]
    known = rows.select(*carried, *[fields[c].alias(c) for c in PLACE_COLUMNS if c in {*columns, "name", "link"}])
    return valid_places(known).select(*carried, *asked)


def first_per_link(places: DataFrame) -> DataFrame:
    """The first valid place of each link inside a task (by ``rank``)."""
    order = Window.partitionBy("task_id", "link").orderBy("rank")
    return valid_places(places).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def places_from_captures(captures: DataFrame) -> DataFrame:
    return first_per_link(assemble(captures))


def with_identity(places: DataFrame) -> DataFrame:
    """Add ``key_lat``/``key_lon``: the position, or nulls when either part is missing or zero."""
    lat, lon = (F.col(c) if c in places.columns else F.lit(None).cast("double") for c in ("latitude", "longitude"))
    placed = (lat != 0) & (lon != 0)
    return places.withColumn("key_lat", F.when(placed, lat)).withColumn("key_lon", F.when(placed, lon))


IDENTITY = ("name", "key_lat", "key_lon")


def dedup_global(places: DataFrame, *order: str) -> DataFrame:
    """One row per identity, the first by ``order`` (default task_id, rank).

    Spark limits each map task to one row per identity before the shuffle, so a
    place with very many copies does not load one reducer.
    """
    first = Window.partitionBy(*IDENTITY).orderBy(*(order or ("task_id", "rank")))
    ranked = with_identity(places).withColumn("_rn", F.row_number().over(first))
    return ranked.filter("_rn = 1").drop("_rn", "key_lat", "key_lon")


def duplicates(places: DataFrame) -> DataFrame:
    """Identities seen more than once, with their number of copies."""
    return with_identity(places).groupBy(*IDENTITY).agg(F.count("*").alias("copies")).filter("copies > 1")


def duplicate_searches(places: DataFrame) -> DataFrame:
    """(search_keyword, search_location) pairs that produced duplicated places: input of a re-run.

    The input is evaluated once, into counts per identity and search; only these are
    written out, summed per identity and joined, so copies do not weigh on the join.
    """
    searches = materialize(
        with_identity(places).groupBy(*IDENTITY, "search_keyword", "search_location").agg(F.count("*").alias("copies")))
    repeated = searches.groupBy(*IDENTITY).agg(F.sum("copies").alias("all_copies")).filter("all_copies > 1")
    same = reduce(lambda a, b: a & b, [searches[c].eqNullSafe(repeated[c]) for c in IDENTITY])
    return searches.join(repeated, same, "left_semi").select("search_keyword", "search_location").distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables, duplicates kept, by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def result_columns(places: DataFrame) -> DataFrame:
    """Known result columns in their published order, leaving out absent ones."""
    return places.select(*[c for c in PLACE_COLUMNS if c in places.columns])


def empty_places(spark) -> DataFrame:
    return spark.createDataFrame([], PLACE)


def task_outcomes(tasks: DataFrame, places: DataFrame) -> DataFrame:
    """Per task: places found, whether it gave none, and the running total in task order."""
    found = places.groupBy("task_id").agg(F.count("*").alias("places_found"))
    counted = tasks.join(found, "task_id", "left").withColumn(
        "places_found", F.coalesce("places_found", F.lit(0).cast("long"))
    )
    outcome = counted.withColumn("empty", F.col("places_found") == 0)
    return with_running_total(outcome, "places_found", "task_id")


def of_completed_tasks(places: DataFrame, errors: DataFrame) -> DataFrame:
    """Places of the tasks that did not fail; a failed task gives no result, whatever it had collected."""
    return places.join(errors.select("task_id").distinct(), "task_id", "left_anti")


def task_states(tasks: DataFrame, places: DataFrame, errors: DataFrame) -> DataFrame:
    """Outcome of every task with its ``status``: ``failed`` if it is in ``errors`` (task_id, error), else ``empty`` or ``found``.

    A failed task counts no places; ``error`` is the smallest of its errors, null for the others.
    """
    failed = errors.groupBy("task_id").agg(F.min("error").alias("error"), F.lit(True).alias("_failed"))
    outcome = task_outcomes(tasks, of_completed_tasks(places, errors)).join(failed, "task_id", "left")
    status = F.when(F.col("_failed"), "failed").when(F.col("empty"), "empty").otherwise("found")
    return outcome.withColumn("status", status).drop("_failed", "empty")
