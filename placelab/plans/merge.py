"""Joining result files, and what to search again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from placelab.operators import places as P
from placelab.operators import summary
from placelab.operators.rows import with_row_id
from placelab.operators.tasks import RERUN_MAX_RESULTS, rerun_tasks
from placelab.sources.readers import read_task_files
from placelab.sources.sinks import RESULT_SEP, write_delimited


@dataclass(frozen=True)
class Merged:
    places: DataFrame
    per_file: DataFrame
    totals: DataFrame
    skipped: DataFrame


def merge_task_files(spark: SparkSession, folder: str, output: str | None = None, sep: str = RESULT_SEP) -> Merged:
    """All task files of a folder as one table, with counts; duplicates are kept, unreadable files are listed."""
    files = read_task_files(spark, folder, sep)
    if output:
        write_delimited(P.result_columns(files.rows), output, sep)
    return Merged(files.rows, summary.file_counts(files.rows), summary.merge_totals(files.rows), files.skipped)


def deduplicated(merged: DataFrame, *order: str) -> DataFrame:
    """One row per place identity, the first by ``order`` (default: file, then all result columns)."""
    keys = order or tuple(c for c in ("source_file", *P.PLACE_COLUMNS) if c in merged.columns)
    return P.dedup_global(merged, *keys)


def searches_to_repeat(merged: DataFrame, max_results: int = RERUN_MAX_RESULTS) -> DataFrame:
    """Tasks for the searches that produced duplicated places."""
    return rerun_tasks(P.duplicate_searches(merged), max_results)


def combined_results(places: list[DataFrame], *order: str) -> DataFrame:
    """Union of task results with a dense row number."""
    return with_row_id(P.union_all(places), *(order or ("task_id", "rank")))

