"""Readers for delimited inputs; text in, types by explicit casts, never inferred."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelab.operators.rows import with_row_id
from placelab.schemas import PLACE
from placelab.session import materialize
from placelab.sources.task_reader import read_records

LOCATION_COLUMNS = ("subdistrict", "district", "city", "location")
TASK_FILES = "task_*.csv"
# Names under which result files carry the link of a place.
LINK_COLUMNS = ("link", "google_maps_link")
MAX_COLUMNS = 10_000


def read_text_table(spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = False,
                    **options) -> DataFrame:
    """A delimited file with header, every column as text.

    With ``multi_line`` quoted fields may span lines; each file is then read by one task.
    """
    return spark.read.options(header=True, sep=sep, multiLine=multi_line, escape='"', **options).csv(path)


def read_keywords(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return read_text_table(spark, path, sep)


def read_locations(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Location table; columns of the known set that the file lacks come as nulls."""
    df = read_text_table(spark, path, sep)
    absent = {c: F.lit(None).cast("string") for c in LOCATION_COLUMNS if c not in df.columns}
    return df.withColumns(absent) if absent else df


def in_file_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """Rows of a file reader with a dense 0-based number in the order of the file (of files: by path)."""
    at = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    placed = materialize(df.select("*", *[c.alias(n) for n, c in at.items()]))  # the order inside a split is fixed once
    return with_row_id(placed, *at, name=name).drop(*at)


def _typed(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        # counts may have been written as 123.0
        return column.try_cast("double").try_cast(dtype)
    return column if isinstance(dtype, T.StringType) else column.try_cast(dtype)


def as_places(df: DataFrame) -> DataFrame:
    """Typed PLACE columns of a text table; other columns are kept as they are."""
    known = {f.name: _typed(F.col(f.name), f.dataType) for f in PLACE.fields if f.name in df.columns}
    return df.withColumns(known)


@dataclass(frozen=True)
class TaskFiles:
    """``rows`` of all readable files; ``skipped``: (source_file, reason) of the others."""

    rows: DataFrame
    skipped: DataFrame


def read_task_files(spark: SparkSession, folder: str, sep: str = "|", link_columns: tuple[str, ...] = LINK_COLUMNS,
                    glob: str = TASK_FILES) -> TaskFiles:
    """All task result files of a folder: an outer union by column name, with ``source_file``.

    Every file brings its own header; a file that cannot be read as a whole is listed
    in ``skipped`` with the reason and adds no rows (Spark does not list files of no bytes). The columns are those of PLACE
    (null where a file lacks them), then all others by name. Files of any size are read
    in splits. The parsed rows are written out once; the names of the columns are the
    only thing that is collected.
    """
    found = read_records(spark, f"{folder.rstrip('/')}/{glob}", sep)
    like = "^" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    source = F.element_at(F.filter(F.split("path", "/"), lambda part: part.rlike(like)), -1).alias("source_file")
    listed = found.headers.select(F.explode("names").alias("name")).distinct()
    names = [r.name for r in listed.orderBy("name").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"the task files have more than {MAX_COLUMNS} different columns")
    renamed = {c: "link" for c in link_columns}
    sources: dict[str, list[str]] = {c: [] for c in PLACE.fieldNames()}
    for name in names:
        sources.setdefault(renamed.get(name, name), []).append(name)
    by_name = F.map_from_arrays(F.slice("names", 1, F.size("fields")), "fields")
    rows = found.rows.select(by_name.alias("fields"), source).select(
        *[F.coalesce(F.lit(None).cast("string"), *[F.nullif(F.col("fields")[s], F.lit("")) for s in from_]).alias(c) for c, from_ in sources.items()],
        "source_file",
    )
    return TaskFiles(as_places(rows), found.skipped.select(source, "reason"))


def read_rerun(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Re-run table with ``source_file``; header names are stripped, either layout is accepted."""
    df = read_text_table(spark, path, sep)
    named = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns],
                      F.col("_metadata.file_name").alias("source_file"))
    return named


def read_merchants(spark: SparkSession, path: str, *order: str, fmt: str = "csv", sep: str = ",",
                   schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Merchant table of any columns with a dense ``row_id`` by the unique key ``order``.

    Delimited files come as text (coordinates are typed by the cleaning step)
    unless a schema is given.
    """
    if fmt == "csv":
        reader = spark.read.options(header=True, sep=sep, multiLine=multi_line, escape='"')
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema else reader).load(path)
    return with_row_id(df, *order)
