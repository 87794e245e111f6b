"""Explicit schemas; no reader infers types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


KEYWORDS = _struct(keyword=_S)

TASK = _struct(
    task_id=_L, keyword=_S, location=_S, subdistrict=_S, district=_S, city=_S, max_results=_I, query=_S
)

OBSERVATION = _struct(task_id=_L, scroll_no=_I, pos=_I, href=_S)

CAPTURE = _struct(
    task_id=_L, rank=_I, link=_S, name_text=_S, category_text=_S, address_text=_S,
    address_aria=T.ArrayType(_S), rating_box_text=_S, rating_alt_text=_S, phone_text=_S, phone_aria=_S,
    website=_S, hours_text=_S, star_bar_texts=T.ArrayType(_S), search_keyword=_S, search_location=_S,
    captured_at=T.TimestampType(),
)

# The result columns in their published order.
PLACE = _struct(
    name=_S, category=_S, address=_S, subdistrict=_S, district=_S, city=_S, province=_S, zip_code=_S,
    latitude=_D, longitude=_D, rating=_D, reviews_count=_L,
    phone=_S, website=_S, link=_S, opening_hours=_S,
    star_1=_I, star_2=_I, star_3=_I, star_4=_I, star_5=_I,
    search_keyword=_S, search_location=_S, scraped_at=T.TimestampType(),
)

PLACE_COLUMNS = PLACE.fieldNames()

ISSUE = _struct(ord=_I, code=_S, column=_S, n=_L, detail=_S, suggestion=_S)

RERUN_FULL = ["search_keyword", "search_subdistrict", "search_district", "search_region"]
RERUN_SHORT = ["search_keyword", "search_location"]


def all_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _S) for f in schema.fields])
