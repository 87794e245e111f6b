"""Search planning: keywords crossed with locations.

The cross product is the result here, so its size is the size of the output.
The location side is broadcast when its row count allows it; otherwise Spark
tiles the product over both inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelab import gazetteer
from placelab.functions.text import blank_to_null, strip, task_slug
from placelab.operators.rows import broadcast_if_small, with_row_id
from placelab.schemas import RERUN_FULL, RERUN_SHORT, TASK

DEFAULT_MAX_RESULTS = 1000
RERUN_MAX_RESULTS = 50


@dataclass(frozen=True)
class Check:
    ok: bool
    message: str


def validate_keywords(df: DataFrame) -> Check:
    if "keyword" not in df.columns:
        return Check(False, "a 'keyword' column is needed")
    if df.isEmpty():
        return Check(False, "the keyword table is empty")
    return Check(True, "Valid")


def validate_locations(df: DataFrame) -> Check:
    missing = [c for c in ("district", "city") if c not in df.columns]
    if missing:
        return Check(False, f"columns district and city are needed; missing: {', '.join(missing)}")
    if df.isEmpty():
        return Check(False, "the location table is empty")
    if "subdistrict" in df.columns:
        return Check(True, "Valid (with subdistrict column)")
    return Check(True, "Valid (without subdistrict, district only)")


def query_text(keyword: Column, location: Column) -> Column:
    return F.concat_ws(" ", keyword, location)


def task_label(keyword: Column, location: Column) -> Column:
    return F.concat_ws(" in ", keyword, location)


def from_list(spark: SparkSession, values: list[str], column: str) -> DataFrame:
    """A one-column table with the list position, for callers that hold plain lists."""
    return spark.createDataFrame(list(enumerate(values)), f"pos long, {column} string")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Give ``df`` a dense ``pos`` by ``order`` unless it already has one."""
    return df if "pos" in df.columns else with_row_id(df, *order, name="pos")


def _present(df: DataFrame, column: str) -> Column:
    """Stripped text of an optional column; blank and the text 'nan' count as missing."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    text = strip(F.col(column))
    return F.when(F.lower(text) != "nan", blank_to_null(text))


def located(df: DataFrame) -> DataFrame:
    """Location text from the filled parts; else the single ``location`` column; else ''."""
    subdistrict, district, city = (_present(df, c) for c in ("subdistrict", "district", "city"))
    single = strip(F.col("location")) if "location" in df.columns else F.lit(None).cast("string")
    joined = blank_to_null(F.concat_ws(", ", subdistrict, district, city))
    empty = F.lit("")
    return df.select(
        "pos",
        F.coalesce(joined, single, empty).alias("location"),
        F.coalesce(subdistrict, empty).alias("subdistrict"),
        F.coalesce(district, empty).alias("district"),
        F.coalesce(city, empty).alias("city"),
    )


def form_locations(df: DataFrame) -> DataFrame:
    """Location text the way the form builds it: raw parts, subdistrict only when not null."""
    short = F.concat_ws(", ", "district", "city")
    if "subdistrict" not in df.columns:
        return df.withColumn("location", short)
    full = F.concat_ws(", ", "subdistrict", "district", "city")
    return df.withColumn("location", F.when(F.col("subdistrict").isNotNull(), full).otherwise(short))


def cross_tasks(keywords: DataFrame, locations: DataFrame, max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    """TASK rows in keyword-major order; both inputs need a dense ``pos``.

    ``task_id`` comes from the two positions, so no sort over the product is needed.
    """
    for part in ("subdistrict", "district", "city"):
        if part not in locations.columns:
            locations = locations.withColumn(part, F.lit(""))
    width = locations.agg(F.count("*").alias("_width"))
    left = keywords.select(F.col("pos").alias("_kpos"), "keyword").crossJoin(F.broadcast(width))
    right = locations.select(F.col("pos").alias("_lpos"), "location", "subdistrict", "district", "city")
    tasks = left.crossJoin(broadcast_if_small(right))
    return tasks.select(
        (F.col("_kpos") * F.col("_width") + F.col("_lpos")).alias("task_id"),
        "keyword", "location", "subdistrict", "district", "city",
        F.lit(max_results).cast("int").alias("max_results"),
        query_text(F.col("keyword"), F.col("location")).alias("query"),
    ).select(*TASK.fieldNames())


def tasks_from_tables(keywords: DataFrame, locations: DataFrame, max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    """Cross product of a keyword table and a location table with optional parts."""
    return cross_tasks(keywords, located(locations), max_results)


def district_tasks(keywords: DataFrame, city: str, districts: DataFrame | None = None,
                   max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    """Keywords × districts of ``city``, by default those of the gazetteer."""
    if districts is None:
        districts = gazetteer.districts_of(keywords.sparkSession, city)
    places = districts.select(
        "pos", F.concat_ws(", ", F.col("district"), F.lit(city)).alias("location"), "district", F.lit(city).alias("city")
    )
    return cross_tasks(keywords, places, max_results)


def subdistrict_tasks(keywords: DataFrame, city: str, district: str, subdistricts: DataFrame | None = None,
                      max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    """Keywords × subdistricts of one district."""
    if subdistricts is None:
        subdistricts = gazetteer.subdistricts_of(keywords.sparkSession, city, district)
    places = subdistricts.select(
        "pos",
        F.concat_ws(", ", F.col("subdistrict"), F.lit(district), F.lit(city)).alias("location"),
        "subdistrict", F.lit(district).alias("district"), F.lit(city).alias("city"),
    )
    return cross_tasks(keywords, places, max_results)


def estimate(tasks: DataFrame, workers: int = 4, sec_per_task: float = 10.0) -> DataFrame:
    """One row: keywords, locations, tasks, expected seconds and the most places to expect."""
    return tasks.agg(
        F.countDistinct("keyword").alias("keywords"),
        F.countDistinct("location").alias("locations"),
        F.count("*").alias("tasks"),
        (F.count("*") * float(sec_per_task) / int(workers)).alias("est_seconds"),
        F.coalesce(F.sum(F.col("max_results").cast("long")), F.lit(0)).alias("max_places"),
    )


def slugs(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("task_slug", task_slug(F.col("task_id"), F.col("keyword"), F.col("location")))


def rerun_pairs(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Distinct (keyword, location) pairs per source file of a re-run table.

    Takes the four-column layout (missing parts drop out of the location) or the
    two-column one, and raises ``ValueError`` for any other.
    """
    columns = set(df.columns)
    if columns.issuperset(RERUN_FULL):
        wanted = RERUN_FULL
    elif columns.issuperset(RERUN_SHORT):
        wanted = RERUN_SHORT
    else:
        raise ValueError(f"need the columns {RERUN_FULL} or {RERUN_SHORT}")
    file = F.col(source) if source in columns else F.lit("")
    stripped = df.select(file.alias("source_file"), *[strip(F.col(c)).alias(c) for c in wanted]).dropDuplicates()
    if wanted is RERUN_FULL:
        parts = [blank_to_null(F.col(c)) for c in RERUN_FULL[1:]]
        location = F.concat_ws(", ", *parts)
    else:
        location = F.col("search_location")
    return stripped.select("source_file", F.col("search_keyword").alias("keyword"), location.alias("location"))


def rerun_tasks(tables: DataFrame | list[DataFrame], max_results: int = RERUN_MAX_RESULTS,
                source: str = "source_file") -> DataFrame:
    """TASK rows of re-run tables, numbered by file, keyword and location.

    Tables of a list may differ in layout; those of neither layout are left out.
    """
    pairs = None
    for table in tables if isinstance(tables, list) else [tables]:
        try:
            found = rerun_pairs(table, source)
        except ValueError:
            if not isinstance(tables, list):
                raise
            continue
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        raise ValueError("no table has the columns of a re-run list")
    empty = F.lit("")
    return with_row_id(pairs, "source_file", "keyword", "location", name="task_id").select(
        "task_id", "keyword", "location",
        empty.alias("subdistrict"), empty.alias("district"), empty.alias("city"),
        F.lit(max_results).cast("int").alias("max_results"),
        query_text(F.col("keyword"), F.col("location")).alias("query"),
    )
