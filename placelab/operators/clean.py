"""Diagnosis and repair of coordinate columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelab.functions.coords import repair_coordinate, to_number
from placelab.functions.text import computed_once, strip
from placelab.schemas import ISSUE

LAT, LON = "latitude", "longitude"

# Valid ranges, and the text length above which a value looks joined.
BOUNDS = {"lat": 90.0, "lon": 180.0}
LONGEST_PLAIN_VALUE = 15

SUGGESTIONS = {
    "missing_column": "Provide the column or name the right one.",
    "string_type": "Convert the text column to numbers.",
    "nulls": "Drop rows without a coordinate.",
    "concatenated": "Repair joined values; choose a separator and first, last, middle or average.",
    "invalid_range": "Drop rows outside the valid coordinate range.",
}


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _number(df: DataFrame, column: str) -> Column:
    """The value as a double; NaN counts as missing."""
    if _is_text(df, column):
        return to_number(strip(F.col(column)))
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _missing(df: DataFrame, column: str) -> Column:
    return F.col(column).isNull() if _is_text(df, column) else _number(df, column).isNull()


def profile(df: DataFrame, lat: str = LAT, lon: str = LON, order_col: str | None = None) -> DataFrame:
    """One row per coordinate column: nulls, numeric range, longest or first text. One pass."""
    aggregates = []
    for kind, column in (("lat", lat), ("lon", lon)):
        value, number = F.col(column), _number(df, column)
        size = F.length(value.cast("string"))
        if order_col:
            width = F.min_by(size, F.when(value.isNotNull(), F.col(order_col)))
        else:
            width = F.max(size)
        aggregates += [
            F.count_if(_missing(df, column)).alias(f"{kind}_nulls"),
            F.count(number).alias(f"{kind}_numbers"),
            F.min(number).alias(f"{kind}_min"),
            F.max(number).alias(f"{kind}_max"),
            F.coalesce(width, F.lit(0)).cast("long").alias(f"{kind}_width"),
            # a long plain number is not two joined ones
            F.coalesce(width if order_col else F.max(F.when(number.isNull(), size)), F.lit(0)).cast("long").alias(f"{kind}_joined"),
        ]
    wide = df.agg(F.count("*").alias("rows"), *aggregates)
    stats = F.array(*[
        F.struct(
            F.lit(column).alias("column"), F.lit(kind).alias("kind"), F.lit(_is_text(df, column)).alias("is_text"),
            F.col("rows"),
            *[F.col(f"{kind}_{s}").alias(s) for s in ("nulls", "numbers", "min", "max", "width", "joined")],
        )
        for kind, column in (("lat", lat), ("lon", lon))
    ])
    return wide.select(F.inline(stats))


def diagnose(df: DataFrame, lat: str = LAT, lon: str = LON, order_col: str | None = None) -> DataFrame:
    """ISSUE rows in a fixed order; none when the columns are fine.

    Joined values are suspected when *any* value is longer than 15 characters.
    With ``order_col`` only the first non-null value in that order is looked at.
    """
    spark = df.sparkSession
    missing = [c for c in (lat, lon) if c not in df.columns]
    if missing:
        rows = [(i, "missing_column", c, None, f"missing column {c}", SUGGESTIONS["missing_column"])
                for i, c in enumerate(missing)]
        return spark.createDataFrame(rows, ISSUE)

    stats = profile(df, lat, lon, order_col)
    column, bound = F.col("column"), F.when(F.col("kind") == "lat", BOUNDS["lat"]).otherwise(BOUNDS["lon"])
    in_range = F.col("min").between(-bound, bound) & F.col("max").between(-bound, bound)
    tests = [
        ("string_type", F.col("is_text"), F.lit(None).cast("long"), F.concat(column, F.lit(" holds text"))),
        ("nulls", F.col("nulls") > 0, F.col("nulls"),
         F.concat(F.col("nulls").cast("string"), F.lit(" null values in "), column)),
        ("concatenated", F.col("is_text") & (F.col("joined") > LONGEST_PLAIN_VALUE), F.col("joined"),
         F.concat(F.lit("suspected concatenated values in "), column, F.lit(" (length "),
                  F.col("joined").cast("string"), F.lit(")"))),
        ("invalid_range", ~F.coalesce(in_range, F.lit(False)), F.lit(None).cast("long"),
         F.concat(F.lit("invalid range of "), column, F.lit(": "),
                  F.coalesce(F.col("min").cast("string"), F.lit("none")), F.lit(" to "),
                  F.coalesce(F.col("max").cast("string"), F.lit("none")))),
    ]
    found = F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(
            (F.lit(2 * i) + F.when(F.col("kind") == "lat", 0).otherwise(1)).cast("int").alias("ord"),
            F.lit(code).alias("code"), column.alias("column"), n.alias("n"), detail.alias("detail"),
            F.lit(SUGGESTIONS[code]).alias("suggestion"),
        ))
        for i, (code, test, n, detail) in enumerate(tests)
    ])
    return stats.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def suggest_fixes(df: DataFrame, lat: str = LAT, lon: str = LON) -> DataFrame:
    """One suggestion per issue, in issue order."""
    return diagnose(df, lat, lon).select("ord", "code", "column", "suggestion")


def repair(df: DataFrame, lat: str = LAT, lon: str = LON, separator: str = "-", method: str = "first",
           keep_sign: bool = False) -> DataFrame:
    """Replace text coordinates by one number each; numeric columns stay as they are."""
    fixed = {c: repair_coordinate(F.col(c), method, separator, keep_sign) for c in (lat, lon) if _is_text(df, c)}
    return computed_once(df, fixed) if fixed else df


def _require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def classified(df: DataFrame, lat: str = LAT, lon: str = LON, joined: bool = True, separator: str = "-",
               method: str = "first", keep_sign: bool = False) -> DataFrame:
    """All rows with numeric coordinates and ``reject_reason`` (null for rows to keep).

    Reasons follow the cleaning order: ``null`` (missing, or lost in the repair),
    ``not_numeric``, ``out_of_range``. One projection, no shuffle.
    """
    _require(df, lat, lon)
    source = repair(df, lat, lon, separator, method, keep_sign) if joined else df
    numbers = computed_once(source, {
        "_absent": _missing(source, lat) | _missing(source, lon), "_lat": _number(source, lat), "_lon": _number(source, lon)
    })
    in_range = F.col("_lat").between(-BOUNDS["lat"], BOUNDS["lat"]) & F.col("_lon").between(
        -BOUNDS["lon"], BOUNDS["lon"]
    )
    reason = (
        F.when(F.col("_absent"), "null")
        .when(F.col("_lat").isNull() | F.col("_lon").isNull(), "not_numeric")
        .when(~in_range, "out_of_range")
    )
    return numbers.withColumns({lat: F.col("_lat"), lon: F.col("_lon"), "reject_reason": reason}).drop(
        "_absent", "_lat", "_lon"
    )


@dataclass(frozen=True)
class Cleaned:
    rows: DataFrame
    issues: DataFrame
    rejected: DataFrame


def clean(df: DataFrame, lat: str = LAT, lon: str = LON, auto_fix: bool = True, separator: str = "-",
          method: str = "first", keep_sign: bool = False) -> Cleaned:
    """Diagnose, repair when joined values are suspected, and drop unusable rows.

    ``rejected`` holds the true number of removed rows per reason. Without
    issues, or with ``auto_fix=False``, the rows come back unchanged.
    """
    _require(df, lat, lon)
    issues = diagnose(df, lat, lon)
    codes = {row.code for row in issues.select("code").collect()}  # at most eight issues
    nothing = df.sparkSession.createDataFrame([], "reject_reason string, n long")
    if not codes or not auto_fix:
        return Cleaned(df, issues, nothing)
    marked = classified(df, lat, lon, "concatenated" in codes, separator, method, keep_sign)
    return Cleaned(marked.filter("reject_reason IS NULL").drop("reject_reason"), issues, reject_counts(marked))


def reject_counts(marked: DataFrame) -> DataFrame:
    return marked.filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def quick_fix(df: DataFrame, lat: str = LAT, lon: str = LON) -> DataFrame:
    """Full clean with '-' and the first value."""
    return clean(df, lat, lon).rows


def repair_only(df: DataFrame, lat: str = LAT, lon: str = LON) -> DataFrame:
    """Repair with '-' and the first value, drop what is no number, keep any range."""
    fixed = repair(df, lat, lon)
    numbers = computed_once(fixed, {lat: _number(fixed, lat), lon: _number(fixed, lon)})
    return numbers.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
