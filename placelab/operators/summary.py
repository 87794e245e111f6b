"""Counts and rates over a place table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelab.operators.places import with_identity


def value_counts(places: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value; nulls excluded.

    A blank value takes part in the cut to ``limit`` rows and is hidden afterwards.
    """
    counts = places.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("places"))
    if limit is not None:
        counts = counts.orderBy(F.desc("places"), F.col(column)).limit(limit)
    return counts.filter(F.col(column) != "")


def top_categories(places: DataFrame, limit: int = 10) -> DataFrame:
    return value_counts(places, "category", limit)


def city_counts(places: DataFrame) -> DataFrame:
    return value_counts(places, "city")


def top_districts(places: DataFrame, limit: int = 10) -> DataFrame:
    return value_counts(places, "district", limit)


def overview(places: DataFrame) -> DataFrame:
    """One row: totals, ratings, contact data and coordinate success, in a single pass."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    total, with_coords = F.count("*"), F.count_if(located)
    return places.agg(
        total.alias("total_places"),
        F.avg("rating").alias("avg_rating"),
        F.count("rating").alias("rated_places"),
        F.count("phone").alias("with_phone"),
        F.count("website").alias("with_website"),
        with_coords.alias("with_coords"),
        F.when(total > 0, with_coords * 100.0 / total).alias("coords_pct"),
    )


def file_counts(merged: DataFrame, file: str = "source_file") -> DataFrame:
    return merged.groupBy(file).agg(F.count("*").alias("places"))


def merge_totals(merged: DataFrame, file: str = "source_file") -> DataFrame:
    """One row: files, rows and true distinct places of a merge.

    Copies collapse before the last step, so no row carries a set.
    """
    files = merged.agg(F.countDistinct(file).alias("files"), F.count("*").alias("total_places"))
    unique = with_identity(merged).select("name", "key_lat", "key_lon").distinct()
    return files.crossJoin(F.broadcast(unique.agg(F.count("*").alias("unique_places"))))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
