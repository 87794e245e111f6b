"""Result writers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelab.functions.text import task_slug
from placelab.operators.places import result_columns

DEFAULT_SEP = "~"
RESULT_SEP = "|"
ROWS_PER_FILE = 5_000_000


@dataclass(frozen=True)
class OutputOptions:
    """Data options of a run."""

    sep: str = DEFAULT_SEP
    output_dir: str = "results"
    max_results: int = 50
    max_scrolls: int = 10
    patience: int = 3


def write_delimited(df: DataFrame, path: str, sep: str = DEFAULT_SEP, mode: str = "errorifexists") -> str:
    """Delimited files with header; nulls and empty text are both written as nothing."""
    df.write.mode(mode).options(
        sep=sep, header=True, escape='"', emptyValue="", nullValue="", encoding="UTF-8",
        timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS", maxRecordsPerFile=ROWS_PER_FILE,
    ).csv(path)
    return path


def write_per_task(places: DataFrame, path: str, sep: str = RESULT_SEP, mode: str = "errorifexists") -> str:
    """One folder per task, named by its slug; tasks without places leave none.

    Rows are rebalanced by task: small tasks share writers, a very large one is
    split over several.
    """
    named = places.withColumn(
        "task_slug", task_slug(F.col("task_id"), F.col("search_keyword"), F.col("search_location"))
    )
    rows = named.select(*result_columns(named).columns, "task_slug").hint("rebalance", "task_slug")
    rows.write.mode(mode).partitionBy("task_slug").options(
        sep=sep, header=True, escape='"', emptyValue="", nullValue="", maxRecordsPerFile=ROWS_PER_FILE,
        timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    ).csv(path)
    return path


def final_name(prefix: str = "final_results", at: datetime | None = None) -> str:
    return f"{prefix}_{(at or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_final(places: DataFrame, folder: str, prefix: str = "final_results", sep: str = RESULT_SEP,
                at: datetime | None = None) -> tuple[str, str] | None:
    """Time-stamped parquet and delimited output; nothing is written for an empty table."""
    if places.isEmpty():
        return None
    base = f"{folder}/{final_name(prefix, at)}"
    rows = result_columns(places)
    rows.write.parquet(f"{base}.parquet")
    written = places.sparkSession.read.schema(rows.schema).parquet(f"{base}.parquet")
    return f"{base}.parquet", write_delimited(written, f"{base}.csv", sep)
